"""The life of upload jobs: submitted, finished, asked for, expired.

Events: job_id, ts, kind (submit, done, failed, poll). A job runs from its submit on and is forgotten EXPIRED seconds later, finished or not. A poll's
answer is done or failed once the job is; till then running, slow beyond SLOW seconds, given_up beyond GIVEN_UP; unknown before the submit
and after the job is forgotten. At one time, submits come first, then finishes, then polls. A submit of a job that runs, and a finish of one that doesn't or has finished,
say nothing.

answers() works on a table, answer_stream() on a stream; both give job_id, at, status, elapsed (seconds since the submit; null for unknown): a row for each
submit (running), finish, poll and forgotten job (expired). Events without an id, a time or one of these kinds are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Seconds after which a job is slow, given up by who waits, and forgotten.
SLOW, GIVEN_UP, EXPIRED = 30, 180, 1_800
ORDER = {"submit": 0, "done": 1, "failed": 2, "poll": 3}
ANSWER = "job_id string, at timestamp, status string, elapsed double"
_SECOND = 1_000_000


def _usable(events: DataFrame) -> DataFrame:
    e = events.select(F.col("job_id").cast("string").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), "kind")
    return e.where(F.col("job_id").isNotNull() & F.col("ts").isNotNull() & F.col("kind").isin(*ORDER))


def waiting_status(elapsed: Column) -> Column:
    """What is said of a job that hasn't finished, by seconds since its submit."""
    return F.when(elapsed > GIVEN_UP, "given_up").when(elapsed > SLOW, "slow").otherwise("running")


def _begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of submits sorted by job and time, those that begin a life."""
    job, created = None, 0
    for b in batches:
        keep = []
        for i, (j, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            if j != job or t - created > EXPIRED * _SECOND:
                job, created = j, t
                keep.append(i)
        yield b.take(pa.array(keep, pa.int32()))


def lives(submits: DataFrame) -> DataFrame:
    """job_id, created (microseconds) of the submits (job_id, t) that begin a life: a job's first, and each first one after the last life. One sorted
    pass a partition holds two values at a time."""
    once = submits.select("job_id", F.col("t").alias("created")).distinct()
    return once.repartition("job_id").sortWithinPartitions("job_id", "created").mapInArrow(_begin, once.schema)


def answers(events: DataFrame, until: Column | None = None) -> DataFrame:
    """The rows of a whole table of events. until: jobs that are forgotten later have no row for it.

    A life lies in two bins of EXPIRED seconds at most, so events find theirs by job and bin, and a job that has most of all events is split
    like any other skewed join; finishes are reduced to one a life before they meet polls.
    """
    e = _usable(events).withColumn("t", F.unix_micros("ts"))
    begun = lives(e.where("kind = 'submit'"))
    width = EXPIRED * _SECOND
    bins = F.explode(F.array(F.expr(f"created div {width}"), F.expr(f"created div {width}") + 1)).alias("bin")
    binned = begun.select("job_id", "created", bins)
    others = e.where("kind <> 'submit'").select("job_id", "t", "kind", F.expr(f"t div {width}").alias("bin"))
    here = (F.col("t") >= F.col("created")) & (F.col("t") - F.col("created") <= width)

    def placed(rows: DataFrame, to: DataFrame, how: str) -> DataFrame:
        e, x = rows.alias("e"), to.alias("x")
        return e.join(x, (F.col("e.job_id") == F.col("x.job_id")) & (F.col("e.bin") == F.col("x.bin")) & here, how).drop(F.col("x.job_id"), F.col("x.bin"), F.col("e.bin"))

    rank = F.when(F.col("kind") == "done", 1).otherwise(2)
    finished = placed(others.where("kind <> 'poll'"), binned, "inner").groupBy("job_id", "created").agg(F.min(F.struct("t", rank.alias("k"), "kind")).alias("finish"))
    told = binned.join(finished, ["job_id", "created"], "left")
    polls = placed(others.where("kind = 'poll'"), told, "left")
    elapsed = (F.col("t") - F.col("created")) / _SECOND
    over = F.coalesce(F.col("finish.t") <= F.col("t"), F.lit(False))
    status = F.when(F.col("created").isNull(), "unknown").when(over, F.col("finish.kind")).otherwise(waiting_status(elapsed))
    row = lambda df, t, status, elapsed: df.select("job_id", F.timestamp_micros(t).alias("at"), status.alias("status"), elapsed.cast("double").alias("elapsed"))
    out = row(polls, F.col("t"), status, elapsed).unionByName(row(begun, F.col("created"), F.lit("running"), F.lit(0)))
    out = out.unionByName(row(finished, F.col("finish.t"), F.col("finish.kind"), (F.col("finish.t") - F.col("created")) / _SECOND))
    gone = row(begun, F.col("created") + width, F.lit("expired"), F.lit(EXPIRED))
    return out.unionByName(gone if until is None else gone.where(F.col("at") <= until))


class JobLife(StatefulProcessor):
    """Events wait until the watermark has passed them, so answers don't depend on the order in which they arrive; then they are taken by time.
    State: the job (created, outcome) and the events that wait. A timer at an event's time, and one at a job's end, wakes it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "created bigint, outcome string")
        self.waiting = handle.getListState("waiting", "t bigint, k int, kind string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), ORDER[kind], kind) for pdf in rows for t, kind in zip(pdf["t"], pdf["kind"])]
        if new:
            self.waiting.appendList(new)
        for t in {t for t, _, _ in new}:
            self.handle.registerTimer(-(-t // 1_000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1_000
        held = sorted(((*map(int, x[:2]), x[2]) for x in self.waiting.get()), key=lambda x: x[:2]) if self.waiting.exists() else []
        created, outcome = self.job.get() if self.job.exists() else (None, None)
        out, later = [], [x for x in held if x[0] > now]

        def expire(before: int) -> None:
            nonlocal created, outcome
            if created is not None and created + EXPIRED * _SECOND < before:
                out.append((created + EXPIRED * _SECOND, "expired", float(EXPIRED)))
                created = outcome = None

        for t, _, kind in held[: len(held) - len(later)]:
            expire(t)
            elapsed = None if created is None else (t - created) / _SECOND
            if kind == "submit":
                if created is None:
                    created = t
                    out.append((t, "running", 0.0))
                    self.handle.registerTimer(-(-(t + EXPIRED * _SECOND + 1) // 1_000))
            elif kind == "poll":
                waiting = "given_up" if elapsed and elapsed > GIVEN_UP else "slow" if elapsed and elapsed > SLOW else "running"
                out.append((t, "unknown" if created is None else outcome or waiting, elapsed))
            elif created is not None and outcome is None:
                outcome = kind
                out.append((t, kind, elapsed))
        expire(now + 1)
        if later:
            self.waiting.put(later)
        elif held:
            self.waiting.clear()
        if created is not None:
            self.job.update((created, outcome))
        elif self.job.exists():
            self.job.clear()
        if out:
            at, status, elapsed = zip(*out)
            yield pd.DataFrame({"job_id": key[0], "at": pd.to_datetime(pd.Series(at), unit="us"), "status": status, "elapsed": pd.Series(elapsed, dtype="float64")})

    def close(self) -> None:
        pass


def answer_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The same rows from a stream; each is given when the watermark (the latest time less `late`) has passed it, and events that come later than that are
    left out. Needs the RocksDB state store; the session's time zone is UTC."""
    e = _usable(events).withWatermark("ts", late).select("job_id", "ts", "kind", F.unix_micros("ts").alias("t"))
    return e.groupBy("job_id").transformWithStateInPandas(JobLife(), ANSWER, outputMode="Append", timeMode="EventTime")
