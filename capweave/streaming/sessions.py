"""Sessions of events, and a gate that puts rows which come too late into a table of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """key, session_start, session_end (the last event's time), n, total by session: events (key, ts, value) less than `gap` apart. On a table all sessions; on a
    stream each once the watermark has passed its end by `gap`. Events without a time are in no session; a null key is a key."""
    e = events.where("ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if events.isStreaming else e
    out = e.groupBy(F.col(key).alias("key"), F.session_window("ts", gap).alias("w")).agg(F.max("ts").alias("session_end"), F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return out.select("key", F.col("w.start").alias("session_start"), "session_end", "n", F.col("total").cast("double").alias("total"))


def gate(events: DataFrame, late: str, on_time: str, too_late: str, checkpoint: str) -> StreamingQuery:
    """Splits a stream (ts) into two tables by batch: rows older than the watermark, the latest time of all batches before less `late`, and the others.

    A batch's latest time is written beside its rows, so a batch that runs again, after a restart too, finds the same watermark and
    replaces what it wrote. A stream that reads `on_time` with the same delay leaves out nothing more, since its watermark isn't ahead of the gate's. Rows
    without a time are on time.
    """
    spark = events.sparkSession
    marks = f"{on_time.rstrip('/')}-marks"

    def split(batch: DataFrame, number: int) -> None:
        from pyspark.errors import AnalysisException

        batch = batch.withColumn("ts", F.col("ts").cast("timestamp"))
        try:
            before = spark.read.schema("latest timestamp, batch bigint").parquet(marks).where(F.col("batch") < number).agg(F.max("latest").alias("t"))
        except AnalysisException:  # the first batch
            before = spark.createDataFrame([(None,)], "t timestamp")
        mark = before.select((F.col("t") - F.expr(f"INTERVAL {late}")).alias("t")).first()["t"]
        old = F.lit(False) if mark is None else F.coalesce(F.col("ts") < F.lit(mark), F.lit(False))
        batch.where(old).write.mode("overwrite").parquet(f"{too_late}/batch={number}")
        batch.where(~old).write.mode("overwrite").parquet(f"{on_time}/batch={number}")
        batch.agg(F.max("ts").alias("latest")).coalesce(1).write.mode("overwrite").parquet(f"{marks}/batch={number}")

    return events.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
