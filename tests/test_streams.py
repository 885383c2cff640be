"""Sessions with late rows, and pages joined with their replies, as streams against the same on tables."""

import datetime as dt
from collections import Counter

from capweave.streaming import pages, sessions

T = dt.datetime(2024, 1, 1)
at = lambda minutes: T + dt.timedelta(minutes=minutes)
EVENT = "user string, ts timestamp, value double"


def run(df, path, name="out"):
    q = df.writeStream.format("parquet").option("path", str(path / name)).option("checkpointLocation", str(path / f"{name}-ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def put(spark, path, number, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").json(str(path / f"{number}"))


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(str(path))


def test_sessions_of_a_stream_with_a_late_file(spark, tmp_path):
    """Four files, each a run of its own. The third has a row that is late by the watermark of the first two, the last closes all sessions."""
    files = [
        [("a", at(0), 1.0), ("a", at(20), 2.0), ("b", at(5), 1.0), (None, at(6), 4.0)],
        [("a", at(60), 1.0), ("b", at(61), 1.5), ("a", at(39), 1.0)],
        [("a", at(41), 9.0), ("b", at(52), 1.0), ("c", at(200), 1.0)],  # the watermark is at 51
        [("z", at(1000), 0.0)],
    ]
    for i, rows in enumerate(files):
        put(spark, tmp_path / "in", i, rows, EVENT)
        q = sessions.gate(stream(spark, tmp_path / "in", EVENT), "10 minutes", str(tmp_path / "on"), str(tmp_path / "late"), str(tmp_path / "gate-ck"))
        q.awaitTermination()
        assert q.exception() is None
        on = spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").parquet(str(tmp_path / "on"))
        run(sessions.sessions(on, "user", "30 minutes", "10 minutes"), tmp_path)
    late = spark.read.schema(EVENT).parquet(str(tmp_path / "late"))
    assert [tuple(r)[:3] for r in late.collect()] == [("a", at(41), 9.0)]
    kept = [r for rows in files for r in rows if r != ("a", at(41), 9.0)]
    want = Counter(map(tuple, sessions.sessions(spark.createDataFrame(kept, EVENT), "user", "30 minutes").where("key <> 'z' OR key IS NULL").collect()))
    assert Counter(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want
    assert want[("a", at(0), at(60), 4, 5.0)] == 1 and want[(None, at(6), at(6), 1, 4.0)] == 1


def test_a_batch_of_the_gate_that_runs_again_gives_the_same(spark, tmp_path):
    """The checkpoint is lost, so all batches run again over what is there."""
    for i, rows in enumerate([[("a", at(100), 1.0)], [("a", at(1), 1.0), ("b", at(95), 1.0), ("n", None, 1.0)]]):
        put(spark, tmp_path / "in", i, rows, EVENT)
        for ck in ("one", "two"):
            sessions.gate(stream(spark, tmp_path / "in", EVENT), "10 minutes", str(tmp_path / ck / "on"), str(tmp_path / ck / "late"), str(tmp_path / ck / "ck")).awaitTermination()
    for ck in ("one", "two"):
        assert [r["user"] for r in spark.read.schema(EVENT).parquet(str(tmp_path / ck / "late")).collect()] == ["a"]
        assert sorted(r["user"] for r in spark.read.schema(EVENT).parquet(str(tmp_path / ck / "on")).collect()) == ["a", "b", "n"]


PAGE = "doc_id string, page_num int, ts timestamp, w string"
REPLY = "doc_id string, page_num int, ts timestamp, content string"


def test_pages_joined_with_late_and_missing_replies(spark, tmp_path):
    pages_ = [[("a", 1, at(0), "x"), ("b", 1, at(1), "x"), ("c", 1, at(2), "x")], [("d", 1, at(20), "x"), ("a", 2, at(20), "x")], [("end", 1, at(60), "x")], [("end", 2, at(120), "x")]]
    replies = [[("a", 1, at(4), "ra"), ("c", 1, at(1), "early")], [("b", 1, at(9), "too late"), ("d", 1, at(21), None), ("a", 2, at(23), "ra2"), ("a", 2, at(24), "again")], [("x", 9, at(61), "of no page")], [("end", 2, at(121), "re")]]
    for i, (p, r) in enumerate(zip(pages_, replies)):
        put(spark, tmp_path / "p", i, p, PAGE)
        put(spark, tmp_path / "r", i, r, REPLY)
        run(pages.with_replies(stream(spark, tmp_path / "p", PAGE), stream(spark, tmp_path / "r", REPLY)), tmp_path)
    got = Counter(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    flat = lambda x: [y for z in x for y in z]
    want = Counter(map(tuple, pages.with_replies(spark.createDataFrame(flat(pages_), PAGE), spark.createDataFrame(flat(replies), REPLY)).collect()))
    assert got == want
    assert {(r[0], r[1], r[4], r[5]) for r in want} == {("a", 1, "ra", False), ("b", 1, None, True), ("c", 1, None, True), ("d", 1, None, False), ("a", 2, "ra2", False), ("a", 2, "again", False), ("end", 1, None, True), ("end", 2, "re", False)}
