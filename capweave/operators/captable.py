"""Cap-table arithmetic: price of a round, shares to issue, ownership before and after.

Amounts are DECIMAL(20,0), counts BIGINT; a total of 0 gives a null price, a price of 0 null new shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import is_valid_request
from ..functions.words import COMMON
from ..plans.stages import written

FIRST_ROW = 14
MONEY = "decimal(38,0)"
DEFAULT_INVESTOR_TYPE = "RCPS"


def share_price(pre_money: Column, pre_total: Column) -> Column:
    return F.round(F.try_divide(pre_money.cast("decimal(20,0)"), pre_total.cast("decimal(20,0)")), 0).cast("decimal(20,0)")


def new_shares(amount: Column, price: Column) -> Column:
    """Rounded up, so the investor holds at least the amount's worth."""
    return F.ceil(F.try_divide(amount.cast("decimal(20,0)"), price.cast("decimal(20,0)"))).cast("bigint")


def share_of(n: Column, total: Column) -> Column:
    return F.try_divide(n.cast("double"), total.cast("double"))


def holders(requests: DataFrame) -> DataFrame:
    return requests.select("doc_id", F.posexplode("shareholders").alias("ord", "h")).select("doc_id", "ord", "h.name", "h.share_type", F.coalesce("h.share_count", F.lit(0)).alias("shares"))


def investors(requests: DataFrame) -> DataFrame:
    """The lead first, then the others; a type that isn't given is the default."""
    i = requests.select("doc_id", F.posexplode("investors").alias("ord", "i"))
    return i.select("doc_id", "ord", "i.name", F.coalesce("i.share_type", F.lit(DEFAULT_INVESTOR_TYPE)).alias("share_type"), F.col("i.amount").cast("decimal(20,0)").alias("amount"))


def price_round(held: DataFrame, invested: DataFrame, pre_money: DataFrame, key: str) -> DataFrame:
    """Rows after the round. held: key, ord, name, share_type, shares; invested: key, ord, name, share_type, amount; pre_money: key, pre_money.

    kind is holder or investor. The totals come from one aggregate a key, not from a window over its rows. Terms (a row a key) and issued
    rows (one an investment) are stage tables, so `held` is read twice and the others once.
    """
    total = held.groupBy(key).agg(F.sum("shares").cast("bigint").alias("pre_total"))
    terms = written(pre_money.join(total, key).withColumn("price", share_price(F.col("pre_money"), F.col("pre_total"))))
    issued = written(invested.join(terms.select(key, "price"), key).withColumn("shares", new_shares(F.col("amount"), F.col("price"))))
    added = issued.groupBy(key).agg(F.sum("shares").cast("bigint").alias("added"))
    terms = terms.join(added, key, "left").withColumn("post_total", F.col("pre_total") + F.coalesce("added", F.lit(0)))
    old = held.select(key, F.lit("holder").alias("kind"), "ord", "name", "share_type", "shares", F.lit(None).cast("decimal(20,0)").alias("amount"))
    new = issued.select(key, F.lit("investor").alias("kind"), "ord", "name", "share_type", "shares", "amount")
    rows = old.unionByName(new).join(terms.select(key, "price", "pre_total", "post_total"), key)
    pre = F.when(F.col("kind") == "holder", share_of(F.col("shares"), F.col("pre_total")))
    return rows.withColumns({"pre_ownership": pre, "post_ownership": share_of(F.col("shares"), F.col("post_total")), "value": F.col("shares") * F.col("price")})


def round_totals(held: DataFrame, invested: DataFrame, pre_money: DataFrame, key: str) -> DataFrame:
    """By key: price, totals and values before and after."""
    rows = price_round(held, invested, pre_money, key)
    out = rows.groupBy(key).agg(
        F.first("price").alias("price"), F.first("pre_total").alias("pre_total"), F.first("post_total").alias("post_total"),
        F.sum(F.when(F.col("kind") == "investor", F.col("value"))).alias("invested_value"),
    )
    return out.withColumns({"pre_value": F.col("price") * F.col("pre_total"), "post_value": F.col("price") * F.col("post_total")})


def cap_table(requests: DataFrame, valid_only: bool = True) -> DataFrame:
    """price_round() of requests (doc_id, pre_money, shareholders, investors), invalid ones left out if valid_only."""
    valid = requests.where(is_valid_request(F.col("shareholders"), F.col("pre_money"), F.get("investors", F.lit(0))["amount"])) if valid_only else requests
    return price_round(holders(valid), investors(valid), valid.select("doc_id", F.col("pre_money").cast("decimal(20,0)").alias("pre_money")), "doc_id")


# The sheet's number formats (of amounts, shares of a total, counts) and the widths of its columns.
MONEY_FORMAT = '_-* #,##0_-;\\-* #,##0_-;_-* "-"_-;_-@_-'
SHARE_FORMAT = "0.00%"
COUNT_FORMAT = "#,##0"
WIDTHS = {"A": 5.125, "B": 3.5, "C": 38.25, "D": 15.75, "E": 14.625, "F": 17.125, "G": 4.875, "H": 15.625, "I": 4.25}


def cells(requests: DataFrame, valid_only: bool = True) -> DataFrame:
    """The sheet as a table: doc_id, row_no, section, name, share_type, shares, ownership, value, price, amount, number_format (of ownership; of the amount and the
    count in their own lines), merged (the columns of the row that are one cell: C:D of totals, G:H of investors' lines). Column widths are WIDTHS. Invalid requests have no sheet if valid_only.

    The round is computed once: each of its rows turns into its lines, and each document into its two lines of totals.
    """
    rows = cap_table(requests, valid_only)
    n = rows.groupBy("doc_id").agg(
        F.count_if(F.col("kind") == "holder").alias("n"), F.count_if(F.col("kind") == "investor").alias("m"),
        F.first("pre_total").alias("pre_total"), F.first("post_total").alias("post_total"), F.first("price").alias("price"),
        F.sum("pre_ownership").alias("pre_sum"), F.sum("post_ownership").alias("post_sum"),
    )
    section_two = F.lit(FIRST_ROW + 4) + F.col("n")
    post = section_two + 2 * F.col("m") + 2
    at = lambda section, row, own: F.struct(F.lit(section).alias("section"), row.cast("int").alias("row_no"), own.cast("double").alias("ownership"))
    nothing, ord_ = F.lit(None), F.col("ord")
    holder = F.array(at("pre", F.lit(FIRST_ROW) + ord_, F.col("pre_ownership")), at("post", post + ord_, F.col("post_ownership")))
    investor = F.array(at("amount", section_two + 2 * ord_, nothing), at("issue", section_two + 2 * ord_ + 1, nothing), at("post", post + F.col("n") + ord_, F.col("post_ownership")))
    lines = rows.join(n.select("doc_id", "n", "m"), "doc_id").withColumn("l", F.explode(F.when(F.col("kind") == "holder", holder).otherwise(investor)))
    out = lines.select("doc_id", "l.row_no", "l.section", "name", "share_type", "shares", "l.ownership", F.col("value").cast("decimal(38,0)").alias("value"), "price", "amount", (F.col("kind") == "holder").alias("holder"))
    total = lambda section, row, shares, own: F.struct(at(section, row, F.col(own)).alias("l"), F.col(shares).cast("bigint").alias("shares"))
    totals = n.withColumn("t", F.explode(F.array(total("pre_total", F.lit(FIRST_ROW) + F.col("n"), "pre_total", "pre_sum"), total("post_total", post + F.col("n") + F.col("m"), "post_total", "post_sum"))))
    totals = totals.select("doc_id", "t.l.row_no", "t.l.section", F.lit("total").alias("name"), F.lit("").alias("share_type"), "t.shares", "t.l.ownership", (F.col("t.shares") * F.col("price")).cast("decimal(38,0)").alias("value"), "price", F.lit(None).cast("decimal(20,0)").alias("amount"), F.lit(False).alias("holder"))
    out = out.unionByName(totals)
    # By the line's place, not by its values: an investor whose shares are unknown (a price of 0) has a line of the same shape.
    kind = F.col("section")
    merged = F.when(kind.isin("pre_total", "post_total"), "C:D").when(kind.isin("amount", "issue") | ((kind == "post") & ~F.col("holder")), "G:H")
    shape = F.when(kind == "amount", MONEY_FORMAT).when(kind == "issue", COUNT_FORMAT).otherwise(SHARE_FORMAT)
    return out.withColumns({"number_format": shape, "merged": merged}).drop("holder")


#: The sheet's labels.
TITLE, PRICE, PRE_VALUE, POST_VALUE = "Cap Table", "Purchasing Value", "Pre Value", "Post Value"
BEFORE, AFTER, TOTAL, PAID, ISSUED = "투자 전", "투자 후", "합계", "매입자금", "거래주식수"
HEADINGS = ("주주명", "주식종류", "주식 수", "지분율")
FORMATS = (COUNT_FORMAT, SHARE_FORMAT, MONEY_FORMAT)


def sheet_lines(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """The whole sheet, a line a row: doc_id, row_no, merged, cells (col, text, number, formula, number_format), with the formulas that a reader of
    the file can change numbers under. lines: cells(), best written first, as they are read twice; requests: doc_id, pre_money, and
    company and round if there are such columns."""
    kind, row = F.col("section"), F.col("row_no")
    at = lambda s: F.max(F.when(kind == s, row))
    value = lambda s: F.max(F.when(kind == s, F.col("value")))
    places = lines.groupBy("doc_id").agg(at("pre_total").alias("pre"), at("post_total").alias("post"), F.count_if(kind == "amount").cast("int").alias("m"), F.max("price").alias("p"), value("pre_total").alias("pre_value"), value("post_total").alias("post_value"))
    given = [F.col(c).cast("string").alias(c) if c in requests.columns else F.lit(None).cast("string").alias(c) for c in ("company", "round")]
    places = places.join(requests.select("doc_id", F.col("pre_money").cast("decimal(20,0)").alias("pre_money"), *given), "doc_id")

    number_of = lambda x: F.when(x.isNotNull(), x.cast("string"))
    nothing = F.lit(None).cast("string")

    def cell(col: str, text=nothing, number=nothing, formula=nothing, shape=None):
        return F.struct(F.lit(col).alias("col"), text.alias("text"), number.alias("number"), formula.alias("formula"), F.lit(shape).cast("string").alias("number_format"))

    join = lambda *parts: F.concat(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in parts])
    label = lambda col, x: cell(col, F.lit(x))
    pre, post, m = F.col("pre"), F.col("post"), F.col("m")
    first_post, second = pre + 4 + 2 * m + 2, pre + 4
    share = cell("F", number=number_of(F.col("ownership")), formula=join("E", row, "/$E$", F.when(kind == "pre", pre).otherwise(post)), shape=SHARE_FORMAT)
    count = lambda formula: cell("E", number=number_of(F.col("shares")), formula=formula, shape=COUNT_FORMAT)
    sums = lambda col, first, shape, number: cell(col, number=number, formula=join(f"SUM({col}", first, f":{col}", row - 1, ")"), shape=shape)
    total = lambda first: F.array(label("C", TOTAL), sums("E", first, COUNT_FORMAT, number_of(F.col("shares"))), sums("F", first, SHARE_FORMAT, number_of(F.col("ownership"))))
    named = [cell("C", F.col("name")), cell("D", F.col("share_type"))]
    bought = second + 2 * (row - (post - m)) + 1  # the line that says how many shares this investor gets
    investor = F.array(*named, count(join("F", bought)), share, cell("G", number=number_of(F.col("value")), formula=join("E", row, "*D6"), shape=MONEY_FORMAT))
    paid = [label("E", PAID), cell("F", number=number_of(F.col("amount")), shape=MONEY_FORMAT)]
    held = F.array(*named, count(nothing), share)
    own = (
        F.when(kind == "pre_total", total(F.lit(FIRST_ROW))).when(kind == "post_total", total(first_post))
        .when((kind == "amount") & (row == second), F.array(label("B", "2)"), label("C", AFTER), *paid)).when(kind == "amount", F.array(*paid))
        .when(kind == "issue", F.array(label("E", ISSUED), cell("F", number=number_of(F.col("shares")), formula=join("ROUNDUP(F", row - 1, "/D6,0)"), shape=COUNT_FORMAT)))
        .when((kind == "post") & (row >= post - m), investor).otherwise(held)
    )
    body = lines.join(places, "doc_id").select("doc_id", row.alias("row_no"), "merged", own.alias("cells"))
    money = lambda col, number, formula=nothing: cell(col, number=number_of(number), formula=formula, shape=MONEY_FORMAT)
    headings = F.array(*[label(c, h) for c, h in zip("CDEF", HEADINGS)])
    head = [
        (F.lit(2), F.array(label("B", TITLE))),
        (F.lit(4), F.array(cell("B", F.col("company")))),
        (F.lit(5), F.array(cell("C", F.col("round")))),
        (F.lit(6), F.array(label("C", PRICE), money("D", F.col("p"), join("ROUND(E7/E", pre, ",0)")))),
        (F.lit(7), F.array(label("C", PRE_VALUE), money("D", F.col("pre_value"), join("D6*E", pre)), money("E", F.col("pre_money")))),
        (F.lit(8), F.array(label("C", POST_VALUE), money("D", F.col("post_value"), join("D6*E", post)))),
        (F.lit(11), F.array(label("B", "1)"), label("C", BEFORE))),
        (F.lit(FIRST_ROW - 1), headings),
        (first_post - 1, headings),
    ]
    head = places.select("doc_id", F.explode(F.array(*[F.struct(r.cast("int").alias("row_no"), c.alias("cells")) for r, c in head])).alias("h"))
    return body.unionByName(head.select("doc_id", "h.row_no", F.lit(None).cast("string").alias("merged"), "h.cells"))


def fill_missing_types(rows: DataFrame, has_text: DataFrame) -> DataFrame:
    """Where no row of a document has a type and the document has a text layer (doc_id, has_text), all become common stock."""
    none = F.bool_and(F.coalesce(F.col("share_type"), F.lit("")) == "").over(Window.partitionBy("doc_id"))
    out = rows.withColumn("__none", none).join(has_text.select("doc_id", F.col("has_text").alias("__text")), "doc_id", "left")
    return out.withColumn("share_type", F.when(F.col("__none") & F.coalesce("__text", F.lit(False)), COMMON).otherwise(F.col("share_type"))).drop("__none", "__text")
