"""The batch plans over a stream of files, and event windows with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import MODEL_REPLY


def reply_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(MODEL_REPLY).option("maxFilesPerTrigger", files_per_batch).json(path)


def each_batch(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """The batch transform on every micro-batch; a batch that runs again overwrites its own folder, so each counts once."""

    def sink(df: DataFrame, number: int) -> None:
        transform(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events (ts, event_type, value) by window and type; a stream drops what is later than `late`. Batch tables work alike."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if events.isStreaming else e
    out = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", F.col("total").cast("double").alias("total"))


def live_jobs(jobs: DataFrame, now, ttl_seconds: int = 1800) -> DataFrame:
    """Jobs (job_id, created: epoch seconds) that haven't run out at `now`."""
    return jobs.where(F.lit(now) - F.col("created") <= ttl_seconds)
