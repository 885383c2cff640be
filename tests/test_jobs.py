"""Jobs' lives: the table of answers against a plain version, the stream against the table."""

import datetime as dt
import random
from collections import Counter

import pytest

from capweave.streaming import jobs

T = dt.datetime(2024, 1, 1)
EVENT = "job_id string, ts timestamp, kind string"


def ev(job, seconds, kind):
    return job, T + dt.timedelta(seconds=seconds), kind


def plain(events):
    """Job by job, event by event."""
    out, by = Counter(), {}
    for j, t, kind in events:
        if j is not None and t is not None and kind in jobs.ORDER:
            by.setdefault(j, []).append((t, jobs.ORDER[kind], kind))
    for j, own in by.items():
        created = outcome = None
        for t, _, kind in [*sorted(own), (dt.datetime(9999, 1, 1), 9, "end")]:
            if created is not None and (t - created).total_seconds() > jobs.EXPIRED:
                out[(j, created + dt.timedelta(seconds=jobs.EXPIRED), "expired", float(jobs.EXPIRED))] += 1
                created = outcome = None
            passed = None if created is None else (t - created).total_seconds()
            if kind == "submit" and created is None:
                created = t
                out[(j, t, "running", 0.0)] += 1
            elif kind == "poll":
                out[(j, t, "unknown" if created is None else outcome or ("given_up" if passed > 180 else "slow" if passed > 30 else "running"), passed)] += 1
            elif kind in ("done", "failed") and created is not None and outcome is None:
                outcome = kind
                out[(j, t, kind, passed)] += 1
    return out


def test_answers_equal_the_plain_version(spark):
    r = random.Random(1)
    events = [ev(f"j{r.randrange(12)}", r.choice([r.randrange(0, 9000), r.randrange(0, 9000) / 7, 1800, 30, 180]), r.choice(["submit", "poll", "poll", "done", "failed"])) for _ in range(500)]
    events += [ev("edge", 0, "submit"), ev("edge", 30, "poll"), ev("edge", 180, "poll"), ev("edge", 1800, "poll"), ev("edge", 1800, "done"), ev("edge", 1800.000001, "poll"), ev("edge", 1801, "submit"), ev("edge", 1801, "poll")]
    events += [ev(None, 1, "poll"), ("x", None, "submit"), ev("x", 3, "other"), ev("x", 3, None), ev("old", -3 * 10**9, "submit"), ev("old", -3 * 10**9 + 40, "poll")]
    got = Counter(map(tuple, jobs.answers(spark.createDataFrame(events, EVENT).repartition(3)).collect()))
    assert got == plain(events)
    assert jobs.answers(spark.createDataFrame([], EVENT)).count() == 0


def test_lives_far_apart_and_times_until(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([ev("a", 0, "submit"), ev("a", 100_000, "submit"), ev("a", 100_001, "submit")], EVENT)
    out = jobs.answers(df, F.lit(T + dt.timedelta(seconds=2_000)))
    assert Counter(r["status"] for r in out.collect()) == {"running": 2, "expired": 1}


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def test_stream_equals_the_table_over_a_restart(spark, tmp_path, rocks):
    """Each file is a run of its own that goes on from the checkpoint; events come out of order, and one after the watermark has passed it."""
    files = [
        [ev("a", 0, "submit"), ev("a", 20, "poll"), ev("a", 100, "poll"), ev("b", 5, "submit"), ev("b", 61, "poll"), ev("b", 60, "done"), ev("c", 7, "poll")],
        [ev("a", 40, "poll"), ev("a", 320, "poll"), ev("a", 310, "failed"), ev("a", 300, "poll"), ev("b", 1900, "poll"), ev("b", 2000, "submit"), ev("a", 2500, "done")],
        [ev("z", 9000, "poll"), ev("a", 9000, "submit")],
        [ev("z", 20000, "poll"), ev("b", 10, "poll")],  # the last is too late
    ]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.json(str(tmp_path / "in" / f"{i}"))
        events = spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
        run = jobs.answer_stream(events).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        run.awaitTermination()
        assert run.exception() is None
    got = Counter(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    on_time = [e for rows in files for e in rows if e != ev("b", 10, "poll")]
    want = plain(on_time)
    del want[("z", T + dt.timedelta(seconds=20000), "unknown", None)]  # the watermark hasn't passed it
    assert got == want
