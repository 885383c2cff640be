"""Where a row came from: the stage of a plan that added it, changed a value, or dropped it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trace(stages: Sequence[tuple[str, DataFrame]], keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """keys, stage_no, stage, change (added, changed, dropped), column, before, after.

    stages: in order, each with keys (a row's identity, which no stage changes) and values. A row is compared with the stage in which it was seen
    last; a row that the last stage lacks is dropped by the first one without it, so every lost row has a stage. Rows of the first stage aren't events.
    All stages meet in one shuffle by identity, sorted by stage. Values are compared as text; null differs from any text. Of
    rows with one identity in a stage, one is kept.
    """
    last = len(stages) - 1
    names = F.array(*[F.lit(n) for n, _ in stages])
    slim = [df.select(*keys, F.lit(i).alias("stage_no"), F.struct(*[F.col(v).cast("string").alias(v) for v in values]).alias("__v")) for i, (_, df) in enumerate(stages)]
    both = slim[0]
    for s in slim[1:]:
        both = both.unionByName(s)
    w = Window.partitionBy(*keys).orderBy("stage_no")
    both = both.withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "stage_no").orderBy("__v"))).where("__k = 1")
    seen = both.withColumns({"__from": F.lag("stage_no").over(w), "__was": F.lag("__v").over(w), "__to": F.lead("stage_no").over(w)})
    no = F.lit(None).cast("string")
    at = F.col("stage_no")

    def event(test: Column, stage: Column, change: str, column: Column = no, before: Column = no, after: Column = no) -> Column:
        own = F.struct(stage.alias("stage_no"), F.lit(change).alias("change"), column.alias("column"), before.alias("before"), after.alias("after"))
        return F.when(test, own)

    old, new = (lambda c: F.col("__was")[c]), (lambda c: F.col("__v")[c])
    events = [event(F.col("__from").isNull() & (at > 0), at, "added")]
    events += [event(F.col("__from").isNotNull() & ~old(c).eqNullSafe(new(c)), at, "changed", F.lit(c), old(c), new(c)) for c in values]
    events += [event(F.col("__to").isNull() & (at < last), at + 1, "dropped")]
    out = seen.select(*keys, F.explode(F.array_compact(F.array(*events))).alias("x"))
    return out.select(*keys, "x.stage_no", F.get(names, F.col("x.stage_no")).alias("stage"), "x.change", "x.column", "x.before", "x.after")


def blame(events: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """keys, stage, before, after of the stage that gave the column its last value; `stage` is null for rows whose first value stayed and aren't in events."""
    own = events.where((F.col("column") == column) | (F.col("change") == "added"))
    return own.groupBy(*keys).agg(F.max_by(F.struct("stage", "before", "after"), "stage_no").alias("x")).select(*keys, "x.*")


def losses(events: DataFrame) -> DataFrame:
    """stage, n: how many rows each stage dropped."""
    return events.where("change = 'dropped'").groupBy("stage_no", "stage").agg(F.count("*").alias("n")).select("stage", "n")
