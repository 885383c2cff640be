"""Sources: uploads, recorded OCR and model replies, JSON and JSONL registers, page texts and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import is_pdf_upload
from ..functions.text import first_given, natural_key, parse_count, parsed_reply, reply_rows
from ..operators.relational import in_ranges, latest

_ROW = "name string, shareType string, share_type string, shareCount string, share_count string"
REGISTER = f"document_id string, shareholders array<struct<{_ROW.replace(' string', ':string')}>>, total_shares bigint"
OCR_REPLY = "doc_id string, page_num int, images array<struct<fields:array<struct<inferText:string,inferConfidence:double,boundingPoly:struct<vertices:array<struct<x:double,y:double>>>>>>>"
MODEL_REPLY = "doc_id string, page_num int, attempt int, content string"
DRAFT = "doc_id string, kind string, text string"
PAGE_TEXT = "doc_id string, page_num int, text string"
PAGE_SIZE = "doc_id string, page_num int, w_pt double, h_pt double"


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of the PDF files that aren't empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(is_pdf_upload(F.col("path"), F.col("length"))).select("path", "length", "content")


def numbered_files(spark: SparkSession, path: str, pattern: str = "Test*.pdf", subset: str | None = None) -> DataFrame:
    """doc_id, path, number of what lies in a folder by name, a file or a folder of parts that stands for one; sorted by number when shown, cut to ranges such
    as 1,3,7-13."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/") + "/"
    inside, name = F.col("path").startswith(root), F.regexp_extract("path", "[^/]+$", 0)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    # Parts lie below the folder; where the path is a pattern of its own, files go by their own names.
    files = files.withColumn("name", F.when(inside, F.substring_index(F.substring("path", len(root) + 1, 1 << 20), "/", 1)).otherwise(name))
    files = files.where(F.col("name").rlike(f"^(?:{hadoop.GlobPattern(pattern).compiled().pattern()})$"))
    files = files.select(F.when(inside, F.concat(F.lit(root), "name")).otherwise(F.col("path")).alias("path"), F.regexp_extract("name", r"(.+)\.[^.]+$", 1).alias("doc_id")).distinct()
    files = files.withColumn("number", natural_key(F.col("doc_id")))
    return in_ranges(files, F.col("number"), subset) if subset else files


def _rows(items: DataFrame) -> DataFrame:
    rows = items.select(F.col("document_id").alias("doc_id"), F.posexplode("shareholders").alias("ord", "s"))
    count = F.coalesce(parse_count(first_given(F.col("s.shareCount"), F.col("s.share_count"))), F.lit(0))
    return rows.select("doc_id", "ord", F.coalesce("s.name", F.lit("")).alias("name"), first_given(F.col("s.shareType"), F.col("s.share_type")).alias("share_type"), count.alias("share_count"))


def registers(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSONL register: doc_id, ord, name, share_type ('' unknown), share_count. Of a repeated id the last line holds
    (within a file; between files, the last by file name). Blank and broken lines are left out."""
    lines = spark.read.schema(REGISTER).json(path).select("*", "_metadata.file_path", "_metadata.file_block_start")
    lines = lines.where("document_id IS NOT NULL").withColumn("__at", F.struct("file_path", "file_block_start", F.monotonically_increasing_id()))
    return _rows(latest(lines, ["document_id"], "__at"))


def register_of(spark: SparkSession, path: str, document_id: str) -> DataFrame:
    """One document's rows: of a .json file its only register, of a JSONL file the first line with the id."""
    if path.endswith(".json"):
        one = spark.read.schema(REGISTER).option("multiLine", "true").json(path).withColumn("document_id", F.lit(document_id))
    else:
        one = spark.read.schema(REGISTER).json(path).where(F.col("document_id") == document_id)
    return _rows(one.limit(1))


def ocr_replies(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, page_num, fields of recorded OCR replies, for layout.ocr_words()."""
    r = spark.read.schema(OCR_REPLY).json(path)
    fields = F.flatten(F.transform("images", lambda i: i["fields"]))
    return r.select("doc_id", "page_num", F.transform(fields, lambda f: F.struct(f["inferText"].alias("text"), F.coalesce(f["inferConfidence"], F.lit(1.0)).alias("conf"), f["boundingPoly"]["vertices"].alias("vertices"))).alias("fields"))


def model_replies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL_REPLY).json(path)


def model_rows(replies: DataFrame) -> DataFrame:
    """Row candidates of recorded replies (doc_id, page_num, attempt, content). A failed call (null) and an empty list give none."""
    # First the list as the one row of a list: Spark would else read each reply a second time, to see whether it has rows.
    lists = replies.select("doc_id", "page_num", "attempt", F.explode(F.array(reply_rows(F.col("content")))).alias("rows"))
    rows = lists.select("doc_id", "page_num", "attempt", F.explode("rows").alias("r"))
    source = F.when(F.col("attempt") > 1, "vlm_retry").otherwise("vlm")
    return rows.select("doc_id", "page_num", "attempt", "r.*", source.alias("source"), F.lit(1.0).alias("confidence"), F.array().cast("array<string>").alias("flags"), F.array().cast("array<string>").alias("raw_cells"))


def unread_replies(replies: DataFrame) -> DataFrame:
    """doc_id, page_num, attempt, state (failed, broken, shape), content of the replies that give no rows because they can't be read."""
    return replies.select("doc_id", "page_num", "attempt", F.explode(F.array(parsed_reply(F.col("content"))["state"])).alias("state"), "content").where("state <> 'read'")  # read once, as above


def drafts(spark: SparkSession, path: str, kind: str = "draft") -> DataFrame:
    return spark.read.schema(DRAFT).json(path).where(F.col("kind") == kind).select("doc_id", "text")


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE_TEXT).json(path)


def page_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE_SIZE).json(path)


def in_natural_order(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(natural_key(F.col(column)).asc_nulls_last(), column)


def positions(df: DataFrame, key: str, order: str) -> DataFrame:
    """ord from 0 within a key."""
    return df.withColumn("ord", (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("int"))
