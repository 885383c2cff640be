"""From words with boxes to table rows, by document and page.

Words: doc_id, page_num, word_idx, text, conf, x1, x2, y1, y2, yc. A page is the partition: every rule is a window,
an equi-join on (doc_id, page_num) with a range test inside, or a fold over one page's words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.rules import is_aggregate_label, is_digit_heavy, name_has_address, usable_name
from ..functions.text import hint_line, name_prefix, normal_share_type, parse_count, safe_dpi, stripped, totals_in
from ..plans.stages import written
from .relational import anchored_groups, in_band, islands, midpoint_bands, nearest

PAGE = ["doc_id", "page_num"]
# Share counts with grouped digits, small ones, counts inside a longer word, and face values.
_COUNT = "^\\d{1,3}(?:,\\d{3})+주?$|^\\d{3,}주$"
_SMALL = r"^\d{2,4}$"
_EMBEDDED = "(\\d{1,3}(?:,\\d{3})+)주"
_FACE = r"^\d{1,2}(?:,\d{3})?$|^\d{2,5}$"


def ocr_words(replies: DataFrame) -> DataFrame:
    """Words of OCR replies (doc_id, page_num, fields: array<text, conf, vertices: array<x, y>>)."""
    f = replies.select(*PAGE, F.posexplode("fields").alias("word_idx", "f"))
    f = f.where((stripped(F.coalesce("f.text", F.lit(""))) != "") & (F.size("f.vertices") >= 4))
    corner = lambda axis, pick: pick(F.transform(F.slice("f.vertices", 1, 4), lambda v: v[axis].cast("double")))
    f = f.select(*PAGE, "word_idx", F.col("f.text").alias("text"), F.col("f.conf").cast("double").alias("conf"), corner("x", F.array_min).alias("x1"), corner("x", F.array_max).alias("x2"), corner("y", F.array_min).alias("y1"), corner("y", F.array_max).alias("y2"))
    return f.withColumn("yc", (F.col("y1") + F.col("y2")) / 2)


def break_lines(words: DataFrame) -> DataFrame:
    """words (with line_break: the last of its line, null counts as yes) with `line`, numbered in reading order."""
    w = Window.partitionBy(*PAGE).orderBy("word_idx")
    ended = F.lag(F.coalesce("line_break", F.lit(True)).cast("int"), 1, 0).over(w)
    return words.withColumn("__e", ended).withColumn("line", F.sum("__e").over(w)).drop("__e")


def ocr_cells(words: DataFrame, gap: float = 1.5) -> DataFrame:
    """Cells of lines (doc_id, page_num, line, word_idx, text, conf, x1..y2): words merge while the gap is at most `gap` mean heights of the page."""
    keys = [*PAGE, "line"]
    w = words.withColumn("__h", F.avg(F.col("y2") - F.col("y1")).over(Window.partitionBy(*PAGE)))
    order = Window.partitionBy(*keys).orderBy("x1", "word_idx")
    w = w.withColumn("__new", (F.col("x1") - F.lag("x2").over(order) > gap * F.col("__h")).cast("int"))
    w = w.withColumn("cell", F.coalesce(F.sum("__new").over(order), F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x1", "word_idx", "text"))), lambda s: s["text"]), " ")
    return w.groupBy(*keys, "cell").agg(text.alias("text"), F.min("conf").alias("conf"), F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.min("y1").alias("y1"), F.max("y2").alias("y2"))


def _anchored(words: DataFrame, gap: float) -> DataFrame:
    """words with `line`: numbered by distance from the first word of a line."""
    own = F.array_sort(F.collect_list(F.struct("yc", "word_idx")))
    page = words.groupBy(*PAGE).agg(own.alias("w"), F.avg(F.col("y2") - F.col("y1")).alias("h"))
    page = page.withColumn("line", anchored_groups(F.transform("w", lambda s: s["yc"].cast("double")), F.col("h") * gap))
    lines = page.select(*PAGE, F.explode(F.arrays_zip(F.transform("w", lambda s: s["word_idx"]).alias("word_idx"), F.col("line").alias("line"))).alias("z")).select(*PAGE, "z.word_idx", "z.line")
    return words.join(lines, [*PAGE, "word_idx"])


def ocr_lines(words: DataFrame, gap: float = 0.5) -> DataFrame:
    """doc_id, page_num, line, cells (texts by x)."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("x1", "word_idx", "text"))), lambda s: s["text"])
    return _anchored(words, gap).groupBy(*PAGE, "line").agg(cells.alias("cells"))


def page_totals(words: DataFrame) -> DataFrame:
    """doc_id, page_num, ocr_total: the greatest number on a line of totals; pages without one are left out. A page's words meet once, with what is asked of
    them only, and stay together for its lines."""
    page = words.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("yc", "word_idx", "text"))).alias("w"), F.avg(F.col("y2") - F.col("y1")).alias("h"))
    lines = page.select(*PAGE, "w", anchored_groups(F.transform("w", lambda s: s["yc"].cast("double")), F.col("h") * 0.8).alias("line"))
    own = lines.select(*PAGE, F.posexplode(F.arrays_zip(F.transform("w", lambda s: s["text"]).alias("text"), F.col("line").alias("line"))).alias("at", "z"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "z.text"))), lambda s: s["text"]), " ")
    lines = own.groupBy(*PAGE, F.col("z.line").alias("line")).agg(text.alias("t"), F.bool_or(is_aggregate_label(F.col("z.text"))).alias("label"))
    named = F.col("label")
    for w in W.TOTAL_LABELS:
        named = named | F.contains("t", F.lit(w))
    return lines.where(named).select(*PAGE, F.array_max(totals_in(F.col("t"))).alias("n")).where("n IS NOT NULL").groupBy(*PAGE).agg(F.max("n").alias("ocr_total"))


def line_totals(lines: DataFrame) -> DataFrame:
    """The same from lines of cells (as ocr_lines() makes them): only a cell that is a label makes a line one of totals."""
    numbers = totals_in(F.array_join("cells", " "))
    found = lines.where(F.exists("cells", is_aggregate_label)).select(*PAGE, F.array_max(numbers).alias("n"))
    return found.where("n IS NOT NULL").groupBy(*PAGE).agg(F.max("n").alias("ocr_total"))


def document_totals(page_texts: DataFrame) -> DataFrame:
    """doc_id, text_total: the first number within bounds on the first line of totals that has one (doc_id, page_num, text)."""
    lines = page_texts.select(*PAGE, F.posexplode(F.split("text", "\n")).alias("line", "t"))
    named = F.lit(False)
    for w in W.TOTAL_LABELS:
        named = named | F.contains("t", F.lit(w))
    numbers = F.filter(totals_in(F.col("t")), lambda n: n < W.COUNT_LIMIT)
    found = lines.where(named).select(*PAGE, "line", F.try_element_at(numbers, F.lit(1)).alias("n")).where("n IS NOT NULL")
    return found.groupBy("doc_id").agg(F.min_by("n", F.struct("page_num", "line")).alias("text_total"))


def document_dpi(page_sizes: DataFrame) -> DataFrame:
    """doc_id, dpi, from the largest page (the first of equals): doc_id, page_num, w_pt, h_pt."""
    big = page_sizes.groupBy("doc_id").agg(F.max_by(F.struct("w_pt", "h_pt"), F.struct(F.col("w_pt") * F.col("h_pt"), -F.col("page_num"))).alias("s"))
    return big.select("doc_id", safe_dpi(F.col("s.w_pt"), F.col("s.h_pt")).alias("dpi"))


def text_layers(page_texts: DataFrame) -> DataFrame:
    return page_texts.groupBy("doc_id").agg(F.coalesce(F.bool_or(F.length(stripped(F.col("text"))) > 20), F.lit(False)).alias("has_text"))


def _flagged_near(flag, reach):
    """Whether a flagged word of the page is within `reach` of a word, in y. Windows over one table: no self-join."""
    at = F.when(flag, F.col("yc"))
    w = Window.partitionBy(*PAGE).orderBy("yc")
    before = F.last_value(at, True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first_value(at, True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    return F.coalesce(F.col("yc") - before <= reach, F.lit(False)) | F.coalesce(after - F.col("yc") <= reach, F.lit(False))


def marked_words(words: DataFrame) -> DataFrame:
    """Words with `pass` (share counts: 1 grouped digits, 2 small numbers in the column, 3 inside a longer word; else null), `n` (the
    digits), h (the page's mean word height), sc (left edge of the counts), limit (right edge of the names)."""
    page = Window.partitionBy(*PAGE)
    c = F.col
    w = words.withColumns({"h": F.avg(c("y2") - c("y1")).over(page), "t": stripped(c("text")), "label": is_aggregate_label(c("text"))})
    w = w.withColumn("free", ~_flagged_near(c("label"), c("h") * 1.5))
    w = w.withColumn("f1", c("free") & c("t").rlike(_COUNT))
    w = w.withColumns({"k1": F.count_if("f1").over(page), "m1": F.max(F.when(c("f1"), c("x1"))).over(page)})
    w = w.withColumn("f1", c("f1") & ((c("k1") < 2) | (c("x1") >= c("m1") * 0.75)))
    w = w.withColumns({"lo": F.min(F.when(c("f1"), c("x1"))).over(page), "hi": F.max(F.when(c("f1"), c("x2"))).over(page), "near1": _flagged_near(c("f1"), c("h") * 0.5)})
    w = w.withColumn("f2", F.coalesce(c("free") & c("t").rlike(_SMALL) & (c("x1") >= c("lo") * 0.85) & (c("x2") <= c("hi") * 1.15) & ~c("near1"), F.lit(False)))
    w = w.withColumns({"sc": F.min(F.when(c("f1") | c("f2"), c("x1"))).over(page), "near2": _flagged_near(c("f1") | c("f2"), c("h") * 0.5), "inner": F.regexp_extract("t", _EMBEDDED, 1)})
    f3 = c("free") & c("sc").isNotNull() & ~c("t").rlike(_COUNT) & ~c("t").rlike(_SMALL) & F.coalesce(parse_count(c("inner")) >= 100, F.lit(False)) & ~c("near2")
    w = w.withColumn("pass", F.when(c("f1"), 1).when(c("f2"), 2).when(f3, 3))
    n = F.when(c("pass") == 3, c("inner")).when(c("pass").isNotNull(), F.regexp_replace("t", "주+$", ""))
    typed = normal_share_type(c("text")).isin(*W.SHARE_TYPES)
    has_type = F.coalesce(F.bool_or(typed & (c("x1") < c("sc"))).over(page), F.lit(False))
    w = w.withColumns({"n": n, "typed": typed, "limit": c("sc") * F.when(has_type, 0.45).otherwise(0.80)})
    return w.select(*words.columns, "pass", "n", "h", "sc", "limit", "typed", "label", "t")


def rows_from_words(words: DataFrame) -> DataFrame:
    """Row candidates: doc_id, page_num, row_index, name, share_type, share_count, source, confidence, flags, raw_cells. Words are marked once, as a stage table."""
    return rows_from_marked(written(marked_words(words)))


def rows_from_marked(w: DataFrame) -> DataFrame:
    """The same from marked_words()."""
    groups = islands(w.where(F.col("pass").isNotNull()), PAGE, "yc", F.col("h"), ["yc", "word_idx"], "grp")
    value = F.coalesce(parse_count(F.col("n")), F.lit(0))
    best = F.max_by(F.struct("n", "pass"), F.struct(value, -F.col("yc"), -F.col("word_idx")))
    anchors = groups.groupBy(*PAGE, "grp").agg(F.avg("yc").alias("anchor"), best.alias("best"), F.first("h").alias("ah"))
    anchors = midpoint_bands(anchors, PAGE, "anchor", F.col("ah") * 2.0)
    in_rows = in_band(w, anchors.drop("ah"), PAGE, "yc")
    in_name = ((F.col("x2") <= F.col("limit")) | ((F.col("x1") < F.col("limit")) & (F.col("x2") < F.col("sc")))) & ~F.col("label")
    in_name = in_name & ~F.lower("t").isin(*W.HEADINGS) & ~is_digit_heavy(F.col("text")) & ~F.col("typed")
    at = F.struct(F.bround(F.col("yc") / (F.col("h") * 0.5)).alias("y"), "x1", "word_idx", "text")
    names = in_rows.groupBy(*PAGE, "grp").agg(F.first("best").alias("best"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(in_name, at))), lambda s: s["text"]), " ").alias("name"))
    # An anchor's type is that of the nearest type word within reach.
    typed = w.where(F.col("typed") & (F.col("x1") > F.col("limit")) & (F.col("x1") < F.col("sc"))).select(*PAGE, "word_idx", F.col("yc").alias("anchor"), normal_share_type(F.col("text")).alias("type"))
    types = nearest(anchors.select(*PAGE, "grp", "anchor", "ah"), typed, PAGE, "anchor", "word_idx", "type", F.col("ah") * 1.5).select(*PAGE, "grp", F.col("nearest_type").alias("share_type"))
    out = names.where(stripped(F.col("name")) != "").join(types, [*PAGE, "grp"], "left")
    kind, n = F.coalesce("share_type", F.lit("")), F.col("best.n")
    flags = F.when(F.col("best.pass") == 2, F.array(F.lit("small_sc_2nd_pass"))).when(F.col("best.pass") == 3, F.array(F.lit("embedded_sc_3rd_pass"))).otherwise(F.array().cast("array<string>"))
    return out.select(
        *PAGE,
        (F.row_number().over(Window.partitionBy(*PAGE).orderBy("grp")) - 1).cast("int").alias("row_index"),
        stripped(F.col("name")).alias("name"),
        kind.alias("share_type"),
        parse_count(n).alias("share_count"),
        F.lit("ocr").alias("source"),
        F.lit(1.0).alias("confidence"),
        flags.alias("flags"),
        F.when(kind != "", F.array(stripped(F.col("name")), kind, n)).otherwise(F.array(stripped(F.col("name")), n)).alias("raw_cells"),
    )


def face_values(words: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, page_num, face_value: a small number at one x in most of the page's rows; the first in word order of several."""
    n = rows.groupBy(*PAGE).agg(F.count("*").alias("n")).where("n >= 2")
    t = stripped(F.col("text"))
    w = words.where(t.rlike(_FACE)).withColumn("v", F.replace(t, F.lit(","), F.lit("")).cast("bigint")).where(F.col("v").between(W.FACE_LOW, W.FACE_HIGH))
    w = w.withColumn("__mean", F.avg("x1").over(Window.partitionBy(*PAGE, "v")))
    v = w.groupBy(*PAGE, "v").agg(F.count("*").alias("k"), F.bool_and(F.abs(F.col("x1") - F.col("__mean")) < W.FACE_SPREAD * F.greatest(F.col("__mean"), F.lit(1.0))).alias("even"), F.min("word_idx").alias("at"))
    v = v.join(n, PAGE).where(F.col("even") & (F.col("k") >= F.col("n") * W.FACE_COVERAGE))
    return v.groupBy(*PAGE).agg(F.min_by("v", "at").alias("face_value"))


def prompt_hints(rows: DataFrame) -> DataFrame:
    """doc_id, page_num, hint: the page's rows as numbered lines. A name with an address in it is cut to its prefix and marked `...`;
    a row without a usable name is left out."""
    name = F.element_at("raw_cells", 1)
    cut = name_has_address(name)
    cells = F.when(cut, F.concat(F.array(F.concat(name_prefix(name), F.lit("..."))), F.slice("raw_cells", 2, F.greatest(F.size("raw_cells"), F.lit(1))))).otherwise(F.col("raw_cells"))
    r = rows.where(usable_name(name)).select(*PAGE, "row_index", cells.alias("cells"))
    r = r.withColumn("line", hint_line(F.col("cells"), F.row_number().over(Window.partitionBy(*PAGE).orderBy("row_index"))))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row_index", "line"))), lambda x: x["line"])
    return r.groupBy(*PAGE).agg(F.array_join(lines, "\n").alias("hint"))
