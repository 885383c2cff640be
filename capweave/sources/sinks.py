"""Sinks: registers as JSON lines, reports as text, stage tables as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import natural_key, thousands


def register_lines(rows: DataFrame) -> DataFrame:
    """document_id, shareholders (by ord; '' as null), total_shares."""
    item = F.struct("ord", F.col("name"), F.nullif("share_type", F.lit("")).alias("share_type"), F.coalesce("share_count", F.lit(0)).alias("share_count"))
    out = rows.groupBy(F.col("doc_id").alias("document_id")).agg(F.array_sort(F.collect_list(item)).alias("s"), F.sum(F.coalesce("share_count", F.lit(0))).alias("total_shares"))
    bare = F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["share_type"].alias("share_type"), x["share_count"].alias("share_count")))
    return out.select("document_id", bare.alias("shareholders"), "total_shares")


def write_registers(rows: DataFrame, path: str, mode: str = "error") -> None:
    register_lines(rows).write.mode(mode).option("ignoreNullFields", "false").json(path)


def report_lines(scores: DataFrame, results: DataFrame) -> DataFrame:
    """A line a document: its id, verdict and accuracy."""
    r = results.join(scores, "doc_id", "left").withColumn("key", natural_key(F.col("doc_id")))
    verdict = F.when(F.col("passed"), "PASS").otherwise("FAIL")
    return r.select("key", F.concat_ws(" | ", "doc_id", verdict, F.format_string("%d/%d", "n_correct", "n_truth"), F.format_string("%.0f%%", F.col("accuracy") * 100)).alias("value"))


def report_sections(scores: DataFrame, results: DataFrame, errors: DataFrame, causes: DataFrame) -> DataFrame:
    """A report's lines as part, line, value: a heading and then the documents in natural order, the errors (number, documents) and
    the root causes (documents) by name. Lines of documents are numbered by their key, so no task sorts all of them."""
    head = lambda part, title: scores.sparkSession.range(1).select(F.lit(part).alias("part"), F.lit(0).cast("long").alias("line"), F.lit(f"# {title}").alias("value"))
    by_name = lambda c: F.row_number().over(Window.orderBy(c)).cast("long").alias("line")  # noqa: E731  a few kinds
    docs = results.join(scores, "doc_id", "left")
    docs = docs.select(F.lit(1).alias("part"), (F.coalesce(natural_key(F.col("doc_id")), F.lit(0)) + 1).alias("line"), F.concat_ws(" | ", "doc_id", F.when(F.col("passed"), "PASS").otherwise("FAIL"), F.format_string("%d/%d", "n_correct", "n_truth")).alias("value"))
    kinds = errors.select(F.lit(2).alias("part"), by_name("error"), F.concat_ws(" | ", "error", F.col("n").cast("string"), F.col("documents").cast("string")).alias("value"))
    why = causes.groupBy("cause").agg(F.count("*").alias("n")).select(F.lit(3).alias("part"), by_name("cause"), F.concat_ws(" | ", "cause", F.col("n").cast("string")).alias("value"))
    out = head(1, "Documents").unionByName(docs).unionByName(head(2, "Errors")).unionByName(kinds).unionByName(head(3, "Causes")).unionByName(why)
    return out.select(F.col("part").cast("long").alias("part"), "line", "value")


def discrepancy_lines(found: DataFrame, truth: DataFrame, rows: DataFrame) -> DataFrame:
    """A line a discrepancy, with both rows as name / type / count."""
    text = lambda d, c, n: d.select("doc_id", F.col("ord").cast("long").alias(c), F.concat_ws(" / ", "name", F.coalesce(F.nullif("share_type", F.lit("")), F.lit("(null)")), thousands(F.col("share_count"))).alias(n))
    out = found.join(text(truth, "g", "t"), ["doc_id", "g"], "left").join(text(rows, "e", "x"), ["doc_id", "e"], "left")
    return out.select(F.concat_ws(" | ", "doc_id", found.columns[-1], F.coalesce("t", F.lit("-")), F.coalesce("x", F.lit("-"))).alias("value"))


def read_report(spark, path: str) -> DataFrame:
    """The lines of a report, as written."""
    return spark.read.text(path)


def write_report(lines: DataFrame, path: str, mode: str = "error") -> None:
    lines.select("value").write.mode(mode).text(path)


def write_stage(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)
