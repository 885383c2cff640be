"""Traces of rows over stages, and folds over sorted keys."""

from collections import Counter

import pytest
from pyspark.sql.types import StructType

from capweave.operators import folds
from capweave.operators.trace import blame, losses, trace


def stages(spark, *tables):
    return [(f"s{i}", spark.createDataFrame(t, "doc string, i int, name string, n bigint")) for i, t in enumerate(tables)]


def test_every_change_and_loss_has_a_stage(spark):
    steps = stages(
        spark,
        [("a", 0, "x", 1), ("a", 1, "y", 2), ("a", 2, "z", None), ("b", 0, None, 5), ("b", 0, None, 5)],
        [("a", 0, "x", 1), ("a", 1, "y2", 2), ("a", 2, "z", None), ("b", 0, None, 5), ("c", 0, "new", 1)],
        [("a", 0, "x", 7), ("a", 2, "z", 3), ("b", 0, "", 5), ("c", 0, "new", 1)],
        [("a", 0, "x", 7), ("a", 1, "y2", 9), ("b", 0, "", 5)],
    )
    out = trace(steps, ["doc", "i"], ["name", "n"])
    got = Counter(map(tuple, out.collect()))
    assert got == Counter([
        ("a", 0, 2, "s2", "changed", "n", "1", "7"), ("a", 1, 1, "s1", "changed", "name", "y", "y2"), ("a", 1, 3, "s3", "changed", "n", "2", "9"), ("a", 2, 2, "s2", "changed", "n", None, "3"),
        ("a", 2, 3, "s3", "dropped", None, None, None), ("b", 0, 2, "s2", "changed", "name", None, ""), ("c", 0, 1, "s1", "added", None, None, None), ("c", 0, 3, "s3", "dropped", None, None, None),
    ])
    assert sorted(map(tuple, blame(out, ["doc", "i"], "n").collect())) == [("a", 0, "s2", "1", "7"), ("a", 1, "s3", "2", "9"), ("a", 2, "s2", None, "3"), ("c", 0, "s1", None, None)]
    assert [tuple(r) for r in losses(out).collect()] == [("s3", 2)]


def test_empty_stages(spark):
    assert trace(stages(spark, [], []), ["doc", "i"], ["name"]).count() == 0
    assert [tuple(r)[3:5] for r in trace(stages(spark, [("a", 0, "x", 1)], []), ["doc", "i"], ["name"]).collect()] == [("s1", "dropped")]


@pytest.mark.parametrize("batch", [2, 10_000])
def test_folds_see_whole_keys_in_order(spark, monkeypatch, batch):
    monkeypatch.setattr(folds, "BATCH", batch)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = [(f"k{i % 7}" if i % 11 else None, i * 37 % 100, i) for i in range(200)]
        df = spark.createDataFrame(rows, "k string, o int, v int").repartition(3)
        out = folds.by_key(df, ["o", "v"], lambda k, c: [(k, len(c[0]), ",".join(map(str, c[1])))], StructType.fromDDL("k string, n bigint, vs string"))
        want = Counter((k, len(own), ",".join(str(v) for _, v in sorted(own))) for k in {r[0] for r in rows} for own in [[r[1:] for r in rows if r[0] == k]])
        assert Counter(map(tuple, out.collect())) == want
        assert folds.by_key(df.limit(0), ["o"], lambda k, c: [], df.schema).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
