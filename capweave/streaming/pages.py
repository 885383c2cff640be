"""Pages and their replies, which come apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How long after a page its reply can come.
WITHIN = "5 minutes"


def with_replies(pages: DataFrame, replies: DataFrame, within: str = WITHIN, late: str = "1 minute") -> DataFrame:
    """Pages (doc_id, page_num, ts, ...) with content and failed: the content of the reply (doc_id, page_num, ts, content) that came from the page's time on and not
    more than `within` later; failed where none came.

    On streams, both sides have a watermark of `late`, and a page without a reply is given as failed once none can come any more; a reply after that,
    or one before its page, is left out. Tables give the same rows. A page with several replies in time has a row for each.
    """
    p, r = pages.withColumn("ts", F.col("ts").cast("timestamp")), replies.select(F.col("doc_id").alias("__d"), F.col("page_num").alias("__p"), F.col("ts").cast("timestamp").alias("__t"), "content", F.lit(True).alias("__came"))
    p = p.withWatermark("ts", late) if pages.isStreaming else p
    r = r.withWatermark("__t", late) if replies.isStreaming else r
    same = (F.col("doc_id") == F.col("__d")) & (F.col("page_num") == F.col("__p")) & (F.col("__t") >= F.col("ts")) & (F.col("__t") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    return p.join(r, same, "left").select(*pages.columns, "content", F.col("__came").isNull().alias("failed"))
