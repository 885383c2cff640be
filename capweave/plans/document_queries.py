"""Queries of the document plans: words, replies and drafts made from the driver's tables by expressions that Spark and DuckDB
read alike, run through the operators, and compared with the rows that the rules give for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import captable, evaluate, layout, reconcile
from ..operators import relational as R
from ..sources import readers, sinks
from . import documents
from .queries import _t, query
from .stages import cleared, scratch, spread, written

PAGE = ["doc_id", "page_num"]
def _kept(spark, path: str, df: DataFrame) -> DataFrame:
    """df as a stage table; the files at path, from which it was read, go."""
    out = written(df)
    cleared(spark, path)
    return out


def _part(spark, d, *expressions: str) -> DataFrame:
    return spread(_t(spark, d, "part").selectExpr("p_partkey AS k", "p_size AS s"), "k").selectExpr("k", "s", *expressions)


# ---------------------------------------------------------------- words of a page to rows

#: A page of up to twenty lines. By line: a name of two words, a type and a count; a misplaced number as well; an address in the
#: name; a small count; a count inside a longer word. Above and below stand headings and a total.
_M = "k % 5"
_GROUPED = "CAST(1 + s % 5 AS STRING) || ',' || lpad(CAST(k % 1000 AS STRING), 3, '0')"
_SMALL = "CAST(100 + k % 800 AS STRING)"
_COUNT = f"CASE WHEN {_M} = 3 THEN 100 + k % 800 ELSE 1000 * (1 + s % 5) + k % 1000 END"
_NAME = f"CASE WHEN {_M} = 2 THEN '박가나 서울시' ELSE '박 holding_' || CAST(k AS STRING) END"
_TYPE = f"CASE {_M} WHEN 0 THEN '보통주' WHEN 1 THEN '우선주' WHEN 4 THEN '우선주' ELSE '' END"
_DOC = "CAST(floor(k / 20) AS BIGINT)"


def _words(spark, d) -> DataFrame:
    w = lambda i, t, x, width, y, test: f"CASE WHEN {test} THEN struct({i} AS i, {t} AS text, {x}D AS x1, {x + width}D AS x2, CAST({y} AS DOUBLE) AS y1) END"
    y, first = "100 + 40 * (k % 20)", "k % 20 = 0"
    found = [
        w(0, "CASE WHEN k % 5 = 2 THEN '박가나' ELSE '박' END", 10, 30, y, "true"),
        w(1, "CASE WHEN k % 5 = 2 THEN '서울시' ELSE 'holding_' || CAST(k AS STRING) END", 42, 50, f"{y} + 1", "true"),
        w(2, "'12,345'", 60, 40, y, f"{_M} = 1"),
        w(3, f"CASE {_M} WHEN 0 THEN '보통' ELSE '우선주' END", 200, 40, y, f"{_M} < 2"),
        w(4, f"{_GROUPED} || CASE WHEN {_M} = 2 THEN '주' ELSE '' END", 300, 30, y, f"{_M} < 3"),
        w(5, _SMALL, 305, 20, y, f"{_M} = 3"),
        w(6, f"'우선주식 ' || {_GROUPED} || '주'", 250, 80, y, f"{_M} = 4"),
        w(7, "'성명'", 10, 30, "40", first),
        w(8, "'주식수'", 300, 30, "40", first),
        w(9, "'합계'", 10, 30, "900", first),
        w(10, "'9,999,999'", 300, 40, "900", first),
    ]
    p = _part(spark, d, f"{_DOC} AS doc_id", f"array_compact(array({', '.join(found)})) AS w").selectExpr("doc_id", "k", "inline(w)")
    return p.selectExpr("CAST(doc_id AS STRING) AS doc_id", "1 AS page_num", "CAST(k * 11 + i AS INT) AS word_idx", "text", "1.0D AS conf", "x1", "x2", "y1", "y1 + 10 AS y2", "y1 + 5 AS yc")


def _sql(x: str) -> str:
    return x.replace("STRING", "VARCHAR")


_LINES = f"""SELECT k, CAST({_sql(_DOC)} AS VARCHAR) AS doc_id, {_M} AS m, CAST(row_number() OVER (PARTITION BY {_DOC} ORDER BY k) - 1 AS BIGINT) AS i, {_sql(_NAME)} AS name, {_sql(_TYPE)} AS share_type,
CAST({_COUNT} AS BIGINT) AS n, CASE WHEN {_M} = 3 THEN {_sql(_SMALL)} ELSE {_sql(_GROUPED)} END AS shown FROM (SELECT p_partkey AS k, p_size AS s FROM part)"""


@query(f"""SELECT doc_id, i AS row_index, name, share_type, n AS share_count, CASE m WHEN 3 THEN 'small_sc_2nd_pass' WHEN 4 THEN 'embedded_sc_3rd_pass' ELSE '' END AS flags,
name || CASE WHEN share_type <> '' THEN '|' || share_type ELSE '' END || '|' || shown AS cells FROM ({_LINES})""")  # fmt: skip
def words_to_rows(spark, d):
    out = layout.rows_from_words(_words(spark, d))
    return out.select("doc_id", F.col("row_index").cast("long").alias("row_index"), "name", "share_type", "share_count", F.array_join("flags", ",").alias("flags"), F.array_join("raw_cells", "|").alias("cells"))


@query(f"""SELECT doc_id, string_agg(CAST(i + 1 AS VARCHAR) || ': ' || CASE WHEN m = 2 THEN '박가나...' ELSE name END || CASE WHEN share_type <> '' THEN ' | ' || share_type ELSE '' END || ' | ' || shown, chr(10) ORDER BY i) AS hint FROM ({_LINES}) GROUP BY 1""")
def page_hints(spark, d):
    return layout.prompt_hints(layout.rows_from_words(_words(spark, d))).select("doc_id", "hint")


@query(f"SELECT DISTINCT CAST({_sql(_DOC)} AS VARCHAR) AS doc_id, CAST(9999999 AS BIGINT) AS ocr_total FROM (SELECT p_partkey AS k FROM part) WHERE k % 20 = 0")
def word_totals(spark, d):
    return layout.page_totals(_words(spark, d)).select("doc_id", "ocr_total")


@query("""WITH p AS (SELECT p_partkey AS k, CAST(p_partkey // 10 AS VARCHAR) AS doc_id FROM part), n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (k % 10 < 8) AS f FROM p GROUP BY 1)
SELECT doc_id, CAST(500 AS BIGINT) AS face_value FROM n WHERE n >= 2 AND f >= n * 0.7""")  # fmt: skip
def word_face_values(spark, d):
    p = _part(spark, d, "CAST(floor(k / 10) AS STRING) AS doc_id", "1 AS page_num")
    face = p.where("k % 10 < 8").selectExpr("doc_id", "page_num", "CAST(2 * k AS INT) AS word_idx", "'500' AS text", "150D + k % 3 AS x1")
    other = p.selectExpr("doc_id", "page_num", "CAST(2 * k + 1 AS INT) AS word_idx", "CAST(1000 + k % 3000 AS STRING) AS text", "300D AS x1")
    return layout.face_values(face.unionByName(other), p).select("doc_id", "face_value")


# ---------------------------------------------------------------- OCR replies as files


def _ocr_files(spark, d) -> DataFrame:
    """OCR replies of ten lines a document, written as JSON and read again."""
    vertices = lambda x: f"array(struct({x}D AS x, y), struct({x + 30}D AS x, y), struct({x + 30}D AS x, y + 10 AS y), struct({x}D AS x, y + 10 AS y))"
    field = lambda t, x: f"struct({t} AS inferText, struct({vertices(x)} AS vertices) AS boundingPoly)"
    k = "CAST(k AS STRING)"
    p = _part(spark, d, "CAST(floor(k / 10) AS STRING) AS doc_id", "CAST(30 * (k % 10) AS DOUBLE) AS y")
    p = p.selectExpr("doc_id", "k", f"array({field("'a' || " + k, 0)}, {field("' '", 31)}, {field("'b' || " + k, 35)}, {field("'c' || " + k, 200)}) AS f")
    p = p.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "f"))).alias("f"))  # ten lines
    path = scratch(spark)
    p.select("doc_id", F.lit(1).alias("page_num"), F.array(F.struct(F.flatten(F.transform("f", lambda x: x["f"])).alias("fields"))).alias("images")).write.json(path)
    return _kept(spark, path, layout.ocr_words(readers.ocr_replies(spark, path)))


_OCR = "SELECT p_partkey AS k, CAST(p_partkey // 10 AS VARCHAR) AS doc_id, 30 * (p_partkey % 10) AS y FROM part"


@query(f"""SELECT doc_id, c || k AS word, CAST(y + 5 AS DOUBLE) AS yc, CAST(x AS DOUBLE) AS x1, 1.0::DOUBLE AS conf FROM ({_OCR}), (VALUES ('a', 0), ('b', 35), ('c', 200)) t(c, x)""")
def ocr_words(spark, d):
    return _ocr_files(spark, d).select("doc_id", F.col("text").alias("word"), "yc", "x1", "conf")


@query(f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS line FROM ({_OCR}))
SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(0 AS BIGINT) AS cell, 'a' || k || ' b' || k AS text FROM l UNION ALL SELECT doc_id, line, 1, 'c' || k FROM l""")  # fmt: skip
def ocr_cells(spark, d):
    lines = layout.break_lines(_ocr_files(spark, d).withColumn("line_break", F.col("text").startswith("c")))
    return layout.ocr_cells(lines).select("doc_id", F.col("line").cast("long").alias("line"), F.col("cell").cast("long").alias("cell"), "text")


@query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS BIGINT) AS line, 'a' || k || '|b' || k || '|c' || k AS cells FROM ({_OCR})")
def ocr_lines(spark, d):
    return layout.ocr_lines(_ocr_files(spark, d)).select("doc_id", F.col("line").cast("long").alias("line"), F.array_join("cells", "|").alias("cells"))


# ---------------------------------------------------------------- the page plan


def _replies(spark, d) -> DataFrame:
    """First attempts lack two lines of five and are fenced; every second document has a repeated one with all lines."""
    kind = lambda w: f"CASE {_M} {w} ELSE NULL END"
    p = _part(spark, d, f"{_DOC} AS doc", f"{_M} AS m", f"CASE WHEN {_M} = 2 THEN '박가나 서울시 마포구' ELSE {_NAME} END AS name", f"CAST({_COUNT} AS STRING) AS shareCount", f"{kind("WHEN 1 THEN '보통'")} AS one", f"{kind("WHEN 0 THEN '보통주' WHEN 1 THEN '보통'")} AS two")

    def reply(rows, kind, attempt):
        item = F.struct("k", F.struct("name", F.col(kind).alias("shareType"), "shareCount").alias("x"))
        rows = rows.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["x"]).alias("shareholders"))  # twenty lines
        content = F.to_json(F.struct("shareholders"), {"ignoreNullFields": "false"})
        content = F.concat(F.lit("```json\n"), content, F.lit("\n```")) if attempt == 1 else content
        return rows.select(F.col("doc").cast("string").alias("doc_id"), F.lit(1).alias("page_num"), F.lit(attempt).alias("attempt"), content.alias("content"))

    return reply(p.where("m IN (0, 1, 3)"), "one", 1).unionByName(reply(p.where("doc % 2 = 0"), "two", 2))


def _page_texts(spark, d) -> DataFrame:
    return _part(spark, d, f"CAST({_DOC} AS STRING) AS doc_id").select("doc_id", F.lit(1).alias("page_num"), F.lit("a text layer of some length").alias("text")).distinct()


def _pages(spark, d) -> dict[str, DataFrame]:
    return documents.by_pages(_words(spark, d), _replies(spark, d), _page_texts(spark, d))


_PLAN = f"""SELECT *, CAST(doc_id AS BIGINT) % 2 = 0 AS again, CASE WHEN m = 2 THEN '박가나' ELSE name END AS final FROM ({_LINES})"""


@query(f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN NOT again AND m IN (2, 4) THEN 1 ELSE 0 END, k) - 1 AS BIGINT) AS ord, final AS name, share_type, n AS share_count FROM ({_PLAN})""")
def page_plan(spark, d):
    out = _pages(spark, d)["shareholders"]
    return out.select("doc_id", F.col("ord").cast("long").alias("ord"), "name", "share_type", "share_count")


@query(f"""SELECT doc_id, final AS name, CASE WHEN again THEN 'vlm_retry' WHEN m IN (2, 4) THEN 'ocr_fallback' ELSE 'vlm' END AS source, CASE WHEN again THEN CASE m WHEN 1 THEN 'type_ocr_override' WHEN 2 THEN 'address_trimmed' WHEN 4 THEN 'type_ocr_override' ELSE '' END
ELSE CASE m WHEN 2 THEN 'count_only_match,address_trimmed' WHEN 4 THEN 'count_only_match' WHEN 3 THEN '' ELSE 'type_ocr_override' END END AS flags, n AS share_count FROM ({_PLAN})""")  # fmt: skip
def page_trace(spark, d):
    """What each row of the page plan has been through."""
    out = _pages(spark, d)["page_rows"]
    return out.select("doc_id", "name", "source", F.array_join("flags", ",").alias("flags"), "share_count")


@query(f"""WITH r AS (SELECT doc_id, m, again, i, k, CASE WHEN again THEN CAST(i AS BIGINT) ELSE row_number() OVER (PARTITION BY doc_id, m IN (0, 1, 3) ORDER BY k) - 1 END AS place, count(*) FILTER (m IN (0, 1, 3)) OVER (PARTITION BY doc_id) AS firsts FROM ({_PLAN})),
o AS (SELECT doc_id, m, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS place FROM r WHERE m IN (0, 1, 3) AND again)
SELECT doc_id, 'vlm_retry' AS source, place AS row_index, 'validated' AS stage, 'changed' AS change, 'name' AS "column", '박가나 서울시 마포구' AS before, '박가나' AS after FROM r WHERE again AND m = 2
UNION ALL SELECT doc_id, 'vlm', place, 'picked', 'dropped', NULL, NULL, NULL FROM o
UNION ALL SELECT doc_id, 'ocr_fallback', firsts + place, 'inserted', 'added', NULL, NULL, NULL FROM r WHERE NOT again AND m IN (2, 4)
UNION ALL SELECT doc_id, CASE WHEN again THEN 'vlm_retry' ELSE 'vlm' END, place, 'typed', 'changed', 'share_type', CASE WHEN m = 1 THEN '보통주' ELSE '' END, CASE m WHEN 0 THEN '보통주' ELSE '우선주' END FROM r WHERE CASE WHEN again THEN m IN (1, 4) ELSE m IN (0, 1) END""")  # fmt: skip
def stage_trace(spark, d):
    """Which stage of the page plan changed what, and which one each lost row was lost in."""
    out = documents.page_trace(_pages(spark, d))
    return out.select("doc_id", "source", F.col("row_index").cast("long").alias("row_index"), "stage", "change", "column", "before", "after")


@query(f"""SELECT doc_id, CAST(coalesce(sum(n) FILTER (m IN (0, 1, 3)), 0) AS BIGINT) AS total, count(*) FILTER (m IN (0, 1, 3)) AS n, count(*) AS n_ocr, bool_or(k % 20 = 0) AS sum_deficit,
count(*) >= 2 AND count(*) FILTER (m IN (0, 1, 3)) < count(*) AS count_deficit FROM ({_PLAN}) GROUP BY 1""")  # fmt: skip
def page_deficits(spark, d):
    out = _pages(spark, d)["deficits"]
    return out.select("doc_id", "total", "n", "n_ocr", "sum_deficit", "count_deficit")


@query(f"SELECT doc_id, k, n AS share_count FROM ({_LINES}) WHERE m IN (2, 4)")
def missing_details(spark, d):
    """OCR rows that no first reply has; k from the row's place."""
    rows = readers.model_rows(_replies(spark, d).where("attempt = 1"))
    out = reconcile.missing_details(rows, layout.rows_from_words(_words(spark, d)))
    return out.select("doc_id", (F.col("doc_id").cast("long") * 20 + F.col("row_index")).alias("k"), F.col("n").alias("share_count"))


# ---------------------------------------------------------------- the reading plan

_READ = "'[데이터 행]' || chr(10) || '1. 가나다라마바사 ' || CAST(k AS STRING) || ' / 보통 / ' || CAST(1000 + k % 1000 AS STRING)"
_AGGREGATE = "CASE WHEN k % 5 = 0 THEN chr(10) || '2. 합계 / 9,999' ELSE '' END"
_SECOND = "chr(10) || '3. 사바마라다나가 ' || CAST(k AS STRING) || ' / ' || CAST(2000 + k % 1000 AS STRING) || '주'"


def _reading(spark, d) -> dict[str, DataFrame]:
    p = _part(spark, d, "CAST(k AS STRING) AS doc_id")
    read = p.selectExpr("doc_id", f"{_READ} || {_AGGREGATE} || CASE WHEN k % 3 = 0 THEN '' ELSE {_SECOND} END AS text")
    repaired = p.where("k % 3 = 0 AND k % 2 = 0").selectExpr("doc_id", f"{_READ} || {_AGGREGATE} || {_SECOND} AS text")
    texts = p.selectExpr("doc_id", "1 AS page_num", "'주주명부' || chr(10) || '합계 ' || CAST(3000 + 2 * (k % 1000) AS STRING) AS text")
    return documents.by_reading(read, repaired, texts)


_READ_ROWS = "SELECT k, a, b, k % 3 <> 0 OR (k % 2 = 0 AND k % 5 <> 0) AS whole, k % 5 = 0 AS shifted FROM (SELECT p_partkey AS k, 1000 + p_partkey % 1000 AS a, 2000 + p_partkey % 1000 AS b FROM part)"


@query(f"""SELECT CAST(k AS VARCHAR) AS doc_id, CAST(0 AS BIGINT) AS ord, '가나다라마바사 ' || k AS name, '보통주' AS share_type, CAST(a AS BIGINT) AS share_count FROM ({_READ_ROWS}) WHERE whole OR a >= (a + b) * 0.85
UNION ALL SELECT CAST(k AS VARCHAR), 1, '사바마라다나가 ' || k, '', CASE WHEN shifted THEN 9999 ELSE b END FROM ({_READ_ROWS}) WHERE whole""")  # fmt: skip
def reading_plan(spark, d):
    """A dropped line of totals shifts the draft's counts, which is part of the result; counted as a row, it also hides that a draft is
    incomplete, which is then neither repaired nor trusted."""
    return _reading(spark, d)["shareholders"].select("doc_id", F.col("ord").cast("long").alias("ord"), "name", "share_type", "share_count")


@query("""WITH p AS (SELECT p_partkey AS k, 1000 + p_partkey % 1000 AS a, 2000 + p_partkey % 1000 AS b FROM part), c AS (SELECT *, k % 3 <> 0 AS two, CASE WHEN k % 5 = 0 THEN 9999 ELSE 0 END AS extra FROM p),
s AS (SELECT *, a + extra + CASE WHEN two THEN b ELSE 0 END AS total FROM c)
SELECT CAST(k AS VARCHAR) AS doc_id, CAST(1 + CAST(two AS INT) + CAST(extra > 0 AS INT) AS BIGINT) AS draft_count, CAST(total AS BIGINT) AS draft_sum, CAST(a + b AS BIGINT) AS text_total,
CASE WHEN total < (a + b) * 0.85 THEN 'sum_deficit: draft=' || total || ', expected=' || (a + b) ELSE '' END AS issues, total >= (a + b) * 0.85 AS passed FROM s""")  # fmt: skip
def draft_checks(spark, d):
    out = _reading(spark, d)["checked"]
    return out.select("doc_id", F.col("draft_count").cast("long").alias("draft_count"), "draft_sum", "text_total", F.array_join("issues", ";").alias("issues"), "passed")


@query("""SELECT CAST(k AS VARCHAR) AS doc_id, low AND k % 3 > 0 AS reading, CASE WHEN low AND k % 3 > 0 THEN 2 WHEN k % 4 = 0 THEN 0 ELSE 1 END::BIGINT AS n, NOT (k % 4 = 0 AND k % 3 = 0) AS success FROM (SELECT p_partkey AS k, p_partkey % 4 = 0 AS low FROM part)""")
def chosen_plan(spark, d):
    """Every fourth document has no OCR row and no row of the page plan; of these, two thirds have been read as a whole."""
    p = _part(spark, d, "CAST(k AS STRING) AS doc_id", "1 AS page_num")
    row = lambda df, name, n: df.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("ord"), F.lit(name).alias("name"), F.lit("").alias("share_type"), F.lit(5).cast("long").alias("share_count"))
    pages = {"ocr": p.where("k % 4 <> 0").select(*PAGE), "shareholders": row(p.where("k % 4 <> 0"), "page", 1)}
    out = documents.chosen(pages, {"shareholders": row(p.where("k % 3 > 0"), "reading", 2)}, p.select(*PAGE))
    n = documents.results(out, p)
    read = out.groupBy("doc_id").agg(F.bool_or(F.col("name") == "reading").alias("reading"))
    return n.join(read, "doc_id", "left").select("doc_id", F.coalesce("reading", F.lit(False)).alias("reading"), "n", "success")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber * 10000000 + l_partkey AS p, CASE WHEN l_linenumber % 2 = 0 THEN NULL WHEN l_partkey % 4 = 0 THEN 50 + l_partkey % 50 ELSE 1000 + l_partkey END AS n FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(arg_min(n, p) AS BIGINT) AS text_total FROM l WHERE n >= 1000 GROUP BY 1""")  # fmt: skip
def document_totals(spark, d):
    """The first line of totals with a number within bounds: even pages have no label, some numbers are too small."""
    li = _t(spark, d, "lineitem").selectExpr("CAST(l_orderkey AS STRING) AS doc_id", "l_linenumber * 10000000 + l_partkey AS page_num", "'주주명부' || char(10) || CASE WHEN l_linenumber % 2 = 0 THEN 'x ' || CAST(l_partkey + 5000 AS STRING) WHEN l_partkey % 4 = 0 THEN '합계 ' || CAST(50 + l_partkey % 50 AS STRING) ELSE '총계: ' || CAST(1000 + l_partkey AS STRING) || ' 77777' END AS text")
    return layout.document_totals(li)


#: Replies from every row of part. A row's name and count are of every JSON type; texts, numbers (whole, with a point or an exponent, negative), true, null, a
#: list, or absent. Around them: no fence, fences in three spellings, broken JSON, JSON of another shape, blanks, nothing.
_NAMES = ("'\"' || k || ') 홀더  ' || s || '\"'", "'\"가 나\"'", "'\" \"'", "CAST(s AS {string})", "s || '.0'", "'true'", "'null'", "'\"' || p || '\"'")
_COUNTS = ("CAST(k + 1 AS {string})", "k || '.75'", "s || 'e3'", "'-' || k", "'true'", "'false'", "'\"1,' || lpad(CAST(k % 1000 AS {string}), 3, '0') || '주\"'", "'null'", "'[' || k || ']'", "'\"-\"'", "'0.5'")
_TYPES = ("'null'", "'\" 보통 \"'", "'\"우선\"'", "'\"\"'", "'\"' || p || '\"'")


def _pick(options, at: str, string: str) -> str:
    return f"CASE CAST({at} AS INT) % {len(options)} " + " ".join(f"WHEN {i} THEN {o.format(string=string)}" for i, o in enumerate(options)) + " END"


def _body(string: str) -> str:
    """The SQL of a reply: three rows, each with a name, a type and a count of its own; the fourth has no type and no count."""
    line = lambda i: f"""'{{"name": ' || {_pick(_NAMES, f"k + {3 * i}", string)} || ', "shareType": ' || {_pick(_TYPES, f"k * 3 + {i}", string)} || ', "shareCount": ' || {_pick(_COUNTS, f"k * 7 + {5 * i}", string)} || '}}'"""
    return f"""'{{"shareholders": [' || {line(0)} || ', ' || {line(1)} || ', ' || {line(2)} || ', {{"name": "x"}}]}}'"""


def _around(fifth: str) -> str:
    around = ("b", "'```json' || chr(10) || b || chr(10) || '```'", "'```JSON ' || b || '```'", "' ``` ' || b || ' ``` '", "b", "'[' || b || ']'", "'{\"shareholders\": ' || k || '}'", "'{\"shareholders\": [' || k || ']}'", "'{broken'", "' '", "NULL", "'{\"other\": 1}'")
    return f"CASE CAST({fifth} AS INT) % {len(around)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(around)) + " END"


_REPLIES = f"""WITH t AS (SELECT p_partkey AS k, p_size AS s, p_type AS p FROM part), b AS (SELECT k, {_body("VARCHAR")} AS b FROM t), r AS (SELECT CAST(k AS VARCHAR) AS doc_id, {_around("k // 5")} AS x FROM b),
u AS (SELECT doc_id, x, trim(regexp_replace(regexp_replace(trim(x, chr(32) || chr(10)), '^```(?:json)?\\s*', '', 'i'), '\\s*```$', ''), chr(32) || chr(10)) AS y FROM r),
v AS (SELECT *, CASE WHEN x IS NULL OR trim(x) = '' THEN 'failed' WHEN NOT json_valid(y) THEN 'broken' WHEN json_type(CAST(y AS JSON)) <> 'OBJECT' THEN 'shape' END AS bad FROM u),
j AS (SELECT doc_id, x, bad, CASE WHEN bad IS NULL AND json_type(CAST(y AS JSON), '$.shareholders') = 'ARRAY' THEN CAST(CAST(y AS JSON) -> '$.shareholders' AS JSON[]) ELSE [] END AS items FROM v),
w AS (SELECT doc_id, x, CASE WHEN bad IS NOT NULL THEN bad WHEN len(list_filter(items, lambda i: json_type(i) <> 'OBJECT')) > 0 THEN 'shape' ELSE 'read' END AS state, items FROM j),
c AS (SELECT doc_id, i - 1 AS row_index, items[i] -> 'name' AS n, items[i] ->> 'name' AS ns, items[i] -> 'shareType' AS t, items[i] ->> 'shareType' AS ts, items[i] -> 'shareCount' AS c, items[i] ->> 'shareCount' AS cs FROM w, unnest(range(1, len(items) + 1)) g(i) WHERE state = 'read'),
f AS (SELECT doc_id, row_index, CASE json_type(n) WHEN 'NULL' THEN 'None' WHEN 'BOOLEAN' THEN upper(ns[1]) || ns[2:] ELSE coalesce(ns, '') END AS name, CASE WHEN t IS NULL OR json_type(t) = 'NULL' THEN NULL ELSE trim(ts) END AS t,
CASE json_type(c) WHEN 'VARCHAR' THEN CAST(trunc(TRY_CAST(regexp_replace(cs, '[^0-9.]', '', 'g') AS DOUBLE)) AS BIGINT) WHEN 'BOOLEAN' THEN CAST(cs = 'true' AS BIGINT) WHEN 'NULL' THEN 0 WHEN 'ARRAY' THEN 0 ELSE CAST(trunc(CAST(cs AS DOUBLE)) AS BIGINT) END AS n FROM c),
g AS (SELECT doc_id, row_index, regexp_replace(regexp_replace(trim(regexp_replace(name, '\\s+', ' ', 'g')), '^\\d+[.)]\\s*', ''), '^가 나$', '가나') AS name, CASE WHEN t IS NULL THEN '' WHEN t = '' OR contains(t, '보통') THEN '보통주' WHEN contains(t, '우선') THEN '우선주' ELSE t END AS share_type, n FROM f)"""


def _varied_replies(spark, d) -> DataFrame:
    p = spread(_t(spark, d, "part").selectExpr("p_partkey AS k", "p_size AS s", "p_type AS p"), "k")
    p = p.selectExpr("k", f"{_body('STRING')} AS b")
    return p.selectExpr("CAST(k AS STRING) AS doc_id", "1 AS page_num", "1 AS attempt", f"{_around('floor(k / 5)')} AS content")


@query(f"{_REPLIES} SELECT doc_id, CAST(row_index AS BIGINT) AS row_index, name, share_type, n AS share_count FROM g WHERE name <> '' AND n > 0")
def reply_rows(spark, d):
    return readers.model_rows(_varied_replies(spark, d)).select("doc_id", F.col("row_index").cast("long").alias("row_index"), "name", "share_type", "share_count")


@query(f"{_REPLIES} SELECT doc_id, state, x AS content FROM w WHERE state <> 'read'")
def unread_replies(spark, d):
    return readers.unread_replies(_varied_replies(spark, d)).select("doc_id", "state", "content")


# ---------------------------------------------------------------- rules of rows and pages


@query("""SELECT k, m = 0 AS signature, m IN (4, 5) AS keeps, m IN (1, 2) AS address, m IN (1, 2) AS name_address, CASE m WHEN 1 THEN '홍길순' WHEN 2 THEN '박가' WHEN 0 THEN '서기 김' WHEN 3 THEN '소계' WHEN 4 THEN '가 나 다펀드 10' WHEN 5 THEN 'holder 10' END AS prefix,
CASE m WHEN 4 THEN '가나 다펀드 10' WHEN 1 THEN '홍길순 서울시 마포구' WHEN 2 THEN '부산 해운대구 1동 박가' WHEN 0 THEN '서기 김' WHEN 3 THEN '소계' WHEN 5 THEN 'holder 10' END AS joined,
CASE m WHEN 5 THEN 'holder 10' ELSE 'A' END AS bare, CAST(k * 1000000 AS BIGINT) AS krw, CASE WHEN k % 2 = 0 THEN 'b' ELSE '' END AS given FROM (SELECT p_partkey AS k, p_partkey % 6 AS m FROM part)""")  # fmt: skip
def row_rules(spark, d):
    x = "CASE k % 6 WHEN 0 THEN '서기 김' WHEN 1 THEN '홍길순 서울시 마포구' WHEN 2 THEN '부산 해운대구 1동 박가' WHEN 3 THEN '소계' WHEN 4 THEN '가 나 다펀드 10' ELSE 'holder 10' END AS x"
    p = _part(spark, d, x, "CASE k % 6 WHEN 5 THEN 'holder 10' ELSE 'A' || repeat(' (주식회사 가)', CAST(1 + k % 12 AS INT)) END AS nested", "CASE WHEN k % 3 = 0 THEN NULL ELSE '' END AS none", "CASE WHEN k % 2 = 0 THEN 'b' END AS some")
    c = F.col
    return p.select(
        "k",
        rules.is_signature_row(c("x")).alias("signature"),
        (rules.keeps_line(F.array("x", F.lit("9"))) & ~rules.is_address(c("x"))).alias("keeps"),
        rules.is_address(c("x")).alias("address"),
        rules.name_has_address(c("x")).alias("name_address"),
        text.name_prefix(c("x")).alias("prefix"),
        text.join_single_syllables(c("x")).alias("joined"),
        text.strip_parentheses(c("nested"), business_number=False).alias("bare"),
        text.from_millions(c("k")).cast("long").alias("krw"),
        text.first_given(c("none"), c("some")).alias("given"),
    )


@query("""SELECT k, m = 0 AS may FROM (SELECT p_partkey AS k, p_partkey % 8 AS m FROM part)""")
def insert_rules(spark, d):
    """A good row; words that no row may hold, an address, a number in front, a date, a count far above the median, one beyond the limit, a known total."""
    x = "CASE k % 8 WHEN 1 THEN '주권 번호' WHEN 2 THEN 'a@b' WHEN 3 THEN '12 박가' WHEN 4 THEN '2020년 김' ELSE '홍길동' END AS x"
    p = _part(spark, d, x, "CAST(CASE k % 8 WHEN 5 THEN 50001 WHEN 6 THEN 100000000 WHEN 7 THEN 777 ELSE 300 END AS BIGINT) AS n", "CASE WHEN k % 8 = 6 THEN NULL ELSE 500 END AS median")
    return p.select("k", rules.may_insert(F.col("x"), F.col("n"), F.col("median"), F.lit(777)).alias("may"))


@query("""SELECT CAST(k AS VARCHAR) AS doc_id, CASE m WHEN 3 THEN '홍길순' ELSE '박가나' END AS name, CASE m WHEN 3 THEN 'address_trimmed' ELSE '' END AS flags FROM (SELECT p_partkey AS k, p_partkey % 8 AS m FROM part) WHERE m IN (3, 7)""")
def validated_rows(spark, d):
    x = "CASE k % 8 WHEN 0 THEN '대표 이사 홍' WHEN 1 THEN '별지 1' WHEN 2 THEN '합 계' WHEN 3 THEN '홍길순 서울시 마포구' WHEN 4 THEN '서울시 마포구' ELSE '박가나' END AS name"
    n = "CAST(CASE k % 8 WHEN 3 THEN 0 WHEN 5 THEN 0 WHEN 6 THEN 20000000000 ELSE 7 END AS BIGINT) AS share_count"
    p = _part(spark, d, "CAST(k AS STRING) AS doc_id", "1 AS page_num", x, n).withColumn("flags", F.array().cast("array<string>"))
    return reconcile.validated(p).select("doc_id", "name", F.array_join("flags", ",").alias("flags"))


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey // 20 AS doc, p_partkey // 10 % 2 AS page FROM part), n AS (SELECT doc, count(DISTINCT page) AS pages FROM p GROUP BY 1),
g AS (SELECT doc, page, pages > 1 AND CASE doc % 4 WHEN 0 THEN page = 0 WHEN 1 THEN page = 1 AND avg(CAST(k % 3 = 0 AS INT)) >= 0.3 ELSE false END AS form FROM p JOIN n USING (doc) GROUP BY doc, page, pages)
SELECT CAST(doc AS VARCHAR) AS doc_id, CAST(page AS BIGINT) AS page_num, CAST(k AS BIGINT) AS k FROM p JOIN g USING (doc, page) WHERE NOT form""")  # fmt: skip
def form_pages(spark, d):
    """Documents of two pages: three form words on the first; two on the second, where names are long and types are missing; two on pages with types; none."""
    p = _part(spark, d, "CAST(floor(k / 20) AS STRING) AS doc_id", "CAST(floor(k / 10) % 2 AS INT) AS page_num", "CASE WHEN k % 3 = 0 THEN 'a name of over fifteen characters' ELSE 'short' END AS name", "floor(k / 20) % 4 AS m")
    p = p.withColumn("share_type", F.when(F.col("m") == 2, "보통주").otherwise(""))
    words = "CASE WHEN m = 0 AND page_num = 0 THEN '법인 세법 별지 시행규칙' WHEN m IN (1, 2) AND page_num = 1 THEN '별지 무액면 주식' ELSE '주주명부' END"
    ocr = p.selectExpr("doc_id", "page_num", f"array({words}) AS raw_cells")
    return reconcile.reject_forms(p, ocr).select("doc_id", F.col("page_num").cast("long").alias("page_num"), F.col("k").cast("long").alias("k"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(o_orderkey AS BIGINT) AS share_count FROM (SELECT *, sum(o_orderkey) OVER w - o_orderkey AS rest, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey)) WHERE NOT (n > 2 AND rest > 0 AND abs(o_orderkey - rest) < rest * 0.02)""")
def document_aggregates(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderkey").cast("long").alias("share_count"))
    return reconcile.drop_document_aggregates(o)


@query("""WITH d AS (SELECT p_partkey AS k, CASE WHEN p_partkey // 10 % 2 = 0 OR p_partkey % 4 > 0 THEN '' ELSE 'RCPS' END AS t, p_partkey // 10 AS doc FROM part)
SELECT CAST(doc AS VARCHAR) AS doc_id, CAST(k AS BIGINT) AS ord, CASE WHEN bool_and(t = '') OVER (PARTITION BY doc) AND doc % 3 > 0 THEN '보통주' ELSE t END AS share_type FROM d""")  # fmt: skip
def filled_types(spark, d):
    p = _part(spark, d, "CAST(floor(k / 10) AS STRING) AS doc_id", "CAST(k AS BIGINT) AS ord", "CASE WHEN floor(k / 10) % 2 = 0 OR k % 4 > 0 THEN '' ELSE 'RCPS' END AS share_type", "floor(k / 10) % 3 > 0 AS has_text")
    return captable.fill_missing_types(p.select("doc_id", "ord", "share_type"), p.select("doc_id", "has_text").distinct())


# ---------------------------------------------------------------- scoring


def _misread(spark, d) -> tuple[DataFrame, DataFrame]:
    """Ten rows a document; even documents have another column in the place of the counts, odd ones have counts doubled and tripled."""
    p = _part(spark, d, "CAST(floor(k / 10) AS STRING) AS doc_id", "CAST(k AS BIGINT) AS ord", "'holder ' || CAST(k AS STRING) AS name", "'보통주' AS share_type", "CAST(1000000 + k AS BIGINT) AS share_count")
    read = p.withColumn("share_count", F.expr("share_count * CASE WHEN floor(k / 10) % 2 = 0 THEN 10 ELSE 1 + k % 3 END"))
    keep = ["doc_id", "ord", "name", "share_type", "share_count"]
    return p.select(keep), read.select(keep)


_MISREAD = """SELECT p_partkey // 10 AS doc, p_partkey // 10 % 2 = 0 AS even, count(*) AS n, count(*) FILTER (p_partkey // 10 % 2 = 0 OR p_partkey % 3 > 0) AS wrong,
count(DISTINCT CASE WHEN p_partkey // 10 % 2 = 0 THEN 10 WHEN p_partkey % 3 > 0 THEN p_partkey % 3 END) = 1 AS uniform FROM part GROUP BY ALL"""


@query(f"""SELECT CAST(doc AS VARCHAR) AS doc_id, wrong AS share_count_mismatch, wrong AS total, uniform, CASE WHEN wrong >= 3 AND uniform THEN 'amount column read as counts' WHEN wrong >= 3 THEN 'count column misread' ELSE 'several' END AS cause,
CASE WHEN wrong >= 3 THEN 'counts' ELSE 'hard' END AS buckets FROM ({_MISREAD}) WHERE wrong > 0""")  # fmt: skip
def root_causes(spark, d):
    out = evaluate.root_causes(evaluate.error_profile(*_misread(spark, d)))
    return out.select("doc_id", "share_count_mismatch", "total", "uniform", "cause", F.array_join("buckets", ",").alias("buckets"))


@query(f"SELECT CAST(doc AS VARCHAR) AS doc_id FROM ({_MISREAD}) WHERE wrong = n")
def unresolved_documents(spark, d):
    sides = _misread(spark, d)
    return evaluate.unresolved(evaluate.error_profile(*sides), evaluate.accuracy(evaluate.classified(*sides)))


@query(f"SELECT count(*) AS documents, count(*) FILTER (wrong = 0) AS passed, count(*) FILTER (wrong = 0) / count(*) AS pass_rate FROM ({_MISREAD})")
def review_summary(spark, d):
    return evaluate.summary(evaluate.passed(*_misread(spark, d)))


@query(f"""WITH m AS ({_MISREAD}), l AS (SELECT 1 AS part, 0 AS line, '# Documents' AS value UNION ALL SELECT 1, doc + 1, doc || ' | ' || CASE WHEN wrong = 0 THEN 'PASS' ELSE 'FAIL' END || ' | ' || (n - wrong) || '/' || n FROM m
UNION ALL SELECT 2, 0, '# Errors' UNION ALL SELECT 2, 1, 'share_count_mismatch | ' || sum(wrong) || ' | ' || count(*) FILTER (wrong > 0) FROM m
UNION ALL SELECT 3, 0, '# Causes' UNION ALL SELECT 3, row_number() OVER (ORDER BY cause), cause || ' | ' || n FROM (SELECT CASE WHEN wrong >= 3 AND uniform THEN 'amount column read as counts' WHEN wrong >= 3 THEN 'count column misread' ELSE 'several' END AS cause, count(*) AS n FROM m WHERE wrong > 0 GROUP BY 1))
SELECT CAST(part AS BIGINT) AS part, CAST(line AS BIGINT) AS line, value FROM l""")  # fmt: skip
def report_sections(spark, d):
    sides = _misread(spark, d)
    profile = written(evaluate.error_profile(*sides))
    return sinks.report_sections(evaluate.accuracy(evaluate.classified(*sides)), evaluate.passed(*sides), evaluate.error_report(evaluate.errors(*sides)), evaluate.root_causes(profile))


@query("SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(o_orderkey AS BIGINT) AS ord, o_orderpriority AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'RCPS' ELSE '' END AS share_type, CAST(o_orderkey AS BIGINT) AS share_count FROM orders")
def register_files(spark, d):
    """Registers written as JSON lines and read again; ordinals come from the order in a register."""
    rows = _t(spark, d, "orders").selectExpr("CAST(o_custkey AS STRING) AS doc_id", "CAST(o_orderkey AS BIGINT) AS ord", "o_orderpriority AS name", "CASE WHEN o_orderkey % 3 = 0 THEN 'RCPS' ELSE '' END AS share_type", "CAST(o_orderkey AS BIGINT) AS share_count")
    path = scratch(spark)
    sinks.write_registers(rows, path)
    return _kept(spark, path, readers.registers(spark, path)).select("doc_id", F.col("share_count").alias("ord"), "name", "share_type", "share_count")


@query("SELECT unnest(['benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier']) AS doc_id")
def file_listing(spark, d):
    return readers.numbered_files(spark, d, "*.parquet").select("doc_id")


@query("""WITH e AS (SELECT p_partkey // 10 AS doc, row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) - 1 AS ord, 'h' || p_partkey AS name FROM part)
SELECT CAST(doc AS VARCHAR) AS doc_id, CAST(CASE WHEN ord > 2 THEN ord - 1 ELSE ord END AS BIGINT) AS ord, CASE WHEN ord = 1 THEN 'edited' ELSE name END AS name FROM e WHERE ord <> 2
UNION ALL SELECT CAST(doc AS VARCHAR), max(CASE WHEN ord > 2 THEN ord - 1 WHEN ord = 2 THEN -1 ELSE ord END) + 1, 'added' FROM e GROUP BY doc""")  # fmt: skip
def row_edits(spark, d):
    """A form's edits: the second row changes, the third goes, one comes behind the last."""
    rows = readers.positions(_part(spark, d, "CAST(floor(k / 10) AS STRING) AS doc_id", "'h' || CAST(k AS STRING) AS name"), "doc_id", "k").select("doc_id", "ord", "name")
    rows = R.appended(R.removed(R.edited(rows, "ord", 1, name="edited"), ["doc_id"], "ord", 2), ["doc_id"], "ord", name="added")
    return rows.withColumn("ord", F.col("ord").cast("long"))


@query("SELECT DISTINCT s_name AS name, CAST(s_suppkey AS BIGINT) AS share_count FROM supplier WHERE s_suppkey % 3 = 0")
def expected_rows(spark, d):
    s = _t(spark, d, "supplier").selectExpr("s_name AS name", "CAST(s_suppkey AS BIGINT) AS share_count")
    return evaluate.has_expected(s.where("share_count % 3 = 0"), s)


@query("""SELECT CAST(doc AS VARCHAR) AS doc_id, CAST(max(9000 + k % 1000) AS BIGINT) AS ocr_total FROM (SELECT p_partkey AS k, p_partkey // 10 AS doc FROM part) WHERE k % 5 = 0 GROUP BY doc""")
def line_totals(spark, d):
    """Lines of cells: totals beside a number that is too long, labels without a number, and numbers without a label."""
    cells = "CASE k % 5 WHEN 0 THEN array('합 계', CAST(9000 + k % 1000 AS STRING), '1234567890123456') WHEN 1 THEN array('소계', '77') ELSE array('가나', '99,999,999') END AS cells"
    return layout.line_totals(_part(spark, d, "CAST(floor(k / 10) AS STRING) AS doc_id", "1 AS page_num", "k % 10 AS line", cells)).select("doc_id", "ocr_total")


@query("SELECT p_partkey AS k, p_partkey % 4 = 0 AS rows_ready, p_partkey % 3 > 0 AND p_partkey % 5 > 0 AS terms_ready, p_partkey % 6 = 0 AS investors_ready FROM part")
def form_steps(spark, d):
    """A form's steps: rows without a name, without a count, or none; terms without a company or an amount; investors without an amount."""
    rows = ["CASE k % 4 WHEN 3 THEN array() WHEN 1 THEN array('a', ' ') ELSE array('a', 'b') END AS names", "CASE k % 4 WHEN 3 THEN array() WHEN 2 THEN array(1, 0) ELSE array(1, 5) END AS counts"]
    p = _part(spark, d, *rows, "CASE WHEN k % 3 = 0 THEN ' ' ELSE 'company' END AS company", "k % 5 AS pre", "array('lead', CASE WHEN k % 2 = 0 THEN 'other' END) AS who", "array(7, CASE WHEN k % 3 = 0 THEN 5 END) AS amounts")
    c = F.col
    return p.select("k", rules.ready_rows(c("names"), c("counts")).alias("rows_ready"), rules.ready_terms(c("company"), F.lit("A"), c("pre")).alias("terms_ready"), rules.ready_investors(c("who"), c("amounts")).alias("investors_ready"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS doc_id, 'holder' AS kind, CAST(10 AS BIGINT) AS shares FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'investor', 2 FROM part WHERE p_partkey % 4 = 0")
def valid_requests(spark, d):
    """Requests without holders, with no valuation, and with a lead that pays nothing are left out."""
    kind = "array<struct<name:string,share_type:string,share_count:bigint>>"
    holders = f"CASE WHEN k % 4 = 1 THEN CAST(array() AS {kind}) ELSE CAST(array(struct('a', '', 10)) AS {kind}) END AS shareholders"
    lead = "CAST(array(struct('lead', CAST(NULL AS STRING), CASE WHEN k % 4 = 3 THEN 0 ELSE 15 END)) AS array<struct<name:string,share_type:string,amount:decimal(20,0)>>) AS investors"
    p = _part(spark, d, "CAST(k AS STRING) AS doc_id", holders, lead, "CAST(CASE WHEN k % 4 = 2 THEN 0 ELSE 100 END AS DECIMAL(20,0)) AS pre_money")
    return captable.cap_table(p).select("doc_id", "kind", "shares")


@query("SELECT '4' AS doc_id, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS ord, o_orderpriority AS name, CAST(o_orderkey AS BIGINT) AS share_count FROM orders WHERE o_custkey = 4")
def register_lookup(spark, d):
    """One document of a register file."""
    rows = _t(spark, d, "orders").selectExpr("CAST(o_custkey AS STRING) AS doc_id", "CAST(o_orderkey AS BIGINT) AS ord", "o_orderpriority AS name", "'' AS share_type", "CAST(o_orderkey AS BIGINT) AS share_count")
    path = scratch(spark)
    sinks.write_registers(rows, path)
    return _kept(spark, path, readers.register_of(spark, path, "4")).select("doc_id", F.col("ord").cast("long").alias("ord"), "name", "share_count")


@query("SELECT p_partkey AS k FROM part WHERE NOT (p_partkey = 1 OR p_partkey = 3 OR p_partkey BETWEEN 7 AND 13)")
def remaining_tests(spark, d):
    """Tests that a list of ranges doesn't name."""
    p = _part(spark, d).select("k")
    return R.missing_from(p, R.in_ranges(p, F.col("k"), "1,3,7-13"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 5")
def first_documents(spark, d):
    """A preview: the limit is what is asked for."""
    return _t(spark, d, "documents").select("doc_id", "n_chars").orderBy("doc_id").limit(5)
