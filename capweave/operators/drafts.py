"""Semi-structured drafts of a register: sections of numbered lines, read from recorded replies.

drafts: doc_id, text. A line's section is the last marker before it; a page heading resets it for structuring, but
not for the counting helpers, which also look at unstripped lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.rules import is_aggregate_label
from ..functions.text import contains_any, draft_line, parse_count, stripped
from .relational import carried

DATA, EXCLUDED, UNKNOWN = "data", "excluded", "unknown"
_NUMBERED = r"^\d+\.\s*(.+)"


def lines(drafts: DataFrame) -> DataFrame:
    return drafts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))


def _sections(df: DataFrame, reset: bool) -> DataFrame:
    t = stripped(F.col("raw")) if reset else F.col("raw")
    heading = t.rlike("^===\\s*페이지\\s*\\d+") if reset else F.lit(False)
    marker = F.when(heading, UNKNOWN).when(F.contains(t, F.lit("[데이터")), DATA).when(F.contains(t, F.lit("[제외")), EXCLUDED)
    out = carried(df.withColumn("__m", marker), ["doc_id"], ["line"], F.col("__m"), "section")
    return out.where(F.col("__m").isNull()).drop("__m")


def structured(drafts: DataFrame) -> DataFrame:
    """Row candidates of the data sections: doc_id, row_index (of kept rows), name, share_type, share_count, source, flags."""
    rows = _sections(lines(drafts), reset=True).where(F.col("section") == DATA)
    rows = rows.select("doc_id", "line", draft_line(stripped(F.col("raw"))).alias("r")).select("doc_id", "line", "r.*")
    rows = rows.where((F.col("name") != "") & ~is_aggregate_label(F.col("name")) & (F.col("share_count") > 0))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("line")) - 1
    return rows.select("doc_id", index.cast("int").alias("row_index"), "name", "share_type", "share_count", F.lit("direct_pdf").alias("source"), F.array().cast("array<string>").alias("flags"))


def _numbered(drafts: DataFrame) -> DataFrame:
    """Numbered lines of data sections as the helpers see them, with parts and idx (of every numbered line, kept or not)."""
    rows = _sections(lines(drafts), reset=False).where((F.col("section") == DATA) & F.col("raw").rlike(_NUMBERED))
    rows = rows.withColumn("parts", F.transform(F.split(F.regexp_extract("raw", _NUMBERED, 1), "/"), stripped))
    return rows.withColumn("idx", (F.row_number().over(Window.partitionBy("doc_id").orderBy("line")) - 1).cast("int"))


def verified_counts(rows: DataFrame, drafts: DataFrame) -> DataFrame:
    """The draft's count where it differs. Its lines are numbered with dropped ones, rows without: after a dropped line they shift."""
    n = parse_count(F.element_at("parts", -1))
    d = _numbered(drafts).where(F.size("parts") >= 2).select("doc_id", F.col("idx").alias("row_index"), n.alias("n")).where(F.col("n") < W.COUNT_LIMIT)
    out = rows.join(d, ["doc_id", "row_index"], "left")
    other = F.coalesce(F.col("n") != F.col("share_count"), F.lit(False))
    return out.withColumns({"flags": F.when(other, F.array_append("flags", F.lit("count_mismatch_with_draft"))).otherwise(F.col("flags")), "share_count": F.when(other, F.col("n")).otherwise(F.col("share_count"))}).drop("n")


def completeness(drafts: DataFrame, totals: DataFrame) -> DataFrame:
    """doc_id, draft_count, draft_sum, text_total, issues, passed; totals: doc_id, text_total."""
    rows = _numbered(drafts)
    last = F.regexp_replace(F.element_at("parts", -1), "[,주]", "")
    n = F.when((F.size("parts") >= 2) & stripped(last).rlike(r"^\d+$"), stripped(last).try_cast("decimal(30,0)"))
    n = F.when((n > 1) & (n < W.COUNT_LIMIT), n.cast("bigint"))
    short = contains_any(F.col("parts")[0], W.ENTITY_WORDS) & (F.length(F.col("parts")[0]) <= 6)
    # A number with a space after it is a row; helpers that sum take it without.
    agg = rows.groupBy("doc_id").agg(F.count_if(F.col("raw").rlike(r"^\d+\.\s")).alias("draft_count"), F.sum(n).alias("draft_sum"), F.array_sort(F.collect_list(F.when(short, F.struct("line", F.col("parts")[0].alias("name"))))).alias("short"))
    out = drafts.select("doc_id").distinct().join(agg, "doc_id", "left").join(totals, "doc_id", "left").na.fill(0, ["draft_count", "draft_sum"])
    deficit = F.coalesce((F.col("text_total") != 0) & (F.col("draft_sum") < F.col("text_total") * W.SUM_DEFICIT_TEXT), F.lit(False))
    issues = F.concat(
        F.when(F.col("draft_count") == 0, F.array(F.lit("no_data_rows"))).otherwise(F.array().cast("array<string>")),
        F.when(deficit, F.array(F.format_string("sum_deficit: draft=%d, expected=%d", "draft_sum", "text_total"))).otherwise(F.array().cast("array<string>")),
        F.coalesce(F.transform("short", lambda s: F.concat(F.lit("truncation_suspect: "), s["name"])), F.array().cast("array<string>")),
    )
    out = out.withColumn("issues", issues)
    return out.select("doc_id", "draft_count", "draft_sum", "text_total", "issues", (F.size("issues") == 0).alias("passed"))


def trusted(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """doc_id of the documents whose direct rows can be used."""
    agg = rows.groupBy("doc_id").agg(F.bool_and(~is_aggregate_label(F.col("name")) & (F.coalesce("share_count", F.lit(0)) < W.COUNT_LIMIT)).alias("clean"), F.sum(F.coalesce("share_count", F.lit(0))).alias("s"))
    agg = agg.join(totals, "doc_id", "left")
    return agg.where(F.col("clean") & F.coalesce(F.col("s") >= F.col("text_total") * W.SUM_DEFICIT_TEXT, F.lit(True))).select("doc_id")
