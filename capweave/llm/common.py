"""What several operators share: shared-folder tables, checked broadcasts, row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import stages
from ..plans.stages import dropped  # noqa: F401

#: Words between ASCII white space, as a Java or DuckDB regular expression.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Words of ASCII letters, digits and everything beyond ASCII; applied to lower-cased text.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A side of at most this many slim rows may be broadcast (some 100 MB as a hash table).
BROADCAST_ROWS = 1_000_000

#: Rows of an Arrow batch.
BATCH_ROWS = 1_000


def fitted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count proves it small enough; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def by_batches(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow with batches cut to BATCH_ROWS rows, so that what is made from a batch has some megabytes."""
    return df.mapInArrow(lambda batches: function(b.slice(i, BATCH_ROWS) for b in batches for i in range(0, b.num_rows, BATCH_ROWS)), schema)


def written(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """stages.written(), meanwhile with Arrow batches of that many rows at most, so that executors hold few megabytes of text beside the heap."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    try:
        if not 0 < int(before) <= rows:
            conf.set(name, rows)
        return stages.written(df)
    finally:
        conf.set(name, before)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
