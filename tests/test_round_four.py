"""The search of all vectors against all: what it writes, and what it finds however its blocks fall."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from capweave.llm import neighbours
from capweave.llm import queries as llm
from helpers import duck, same_rows
from llm import brute


def _frame(spark, v, parts):
    return spark.createDataFrame([(i, 2, x.tolist()) for i, x in enumerate(v)], "cls bigint, size bigint, embedding array<float>").repartition(parts)


def _shuffled(spark) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    every = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))


def _groups(n, pairs):
    """Of each of n, the first that it is connected with."""
    first: dict[int, int] = {}
    return [first.setdefault(x, i) for i, x in enumerate(brute.roots(n, pairs))]


@pytest.mark.parametrize("ef", [neighbours.EF, neighbours.WHOLE])
def test_vectors_are_not_shuffled_for_each_meeting(spark, ef):
    """Once into their parts and, for graphs, once into their shards; they were sent to every shard."""
    v = np.random.default_rng(5).normal(size=(6000, 64)).astype(np.float32)
    rows, before = _frame(spark, v, 3), _shuffled(spark)
    neighbours.near_links(rows, ef=ef)
    assert _shuffled(spark) - before < 4 * v.nbytes


def test_blocks_meet_once(spark):
    """A dense group, pairs and vectors of another length in thirteen blocks, against all pairs."""
    r = np.random.default_rng(7)
    base = r.normal(size=(700, 64))
    v = list(np.concatenate((base, base[:200] + 0.3 * r.normal(size=(200, 64)), base[:1] + 0.1 * r.normal(size=(150, 64)))).astype(np.float32))
    v += list(np.concatenate((base[:90, :7], 2 * base[:90, :7] + 0.1)).astype(np.float32))
    unit = [x.astype(float) / np.linalg.norm(x.astype(float)) for x in v]
    pairs = [(i, j) for i in range(len(v)) for j in range(i) if len(v[i]) == len(v[j]) and unit[i] @ unit[j] >= 0.9]
    got = neighbours.near_links(_frame(spark, v, 13), ef=neighbours.WHOLE)
    k = {x["cls"]: (x["k"], x["near"]) for x in got.found.where("k IS NOT NULL").groupBy("cls").agg(F.sum("k").alias("k"), F.sum("near").alias("near")).collect()}
    assert k == {c: (n, 2 * n) for c, n in Counter(x for p in pairs for x in p).items()}
    assert _groups(len(v), [(x["cls"], x["low"]) for x in got.found.where("low IS NOT NULL").collect()]) == _groups(len(v), pairs)


def test_scan_by_heads_misses_nothing():
    """Bounded, few and many pairs at the threshold, and blocks that aren't whole tiles."""
    r = np.random.default_rng(8)
    a, b = r.normal(size=(700, 64)), r.normal(size=(1500, 64))
    b[:300] = a[:300] + 0.48 * r.normal(size=(300, 64))
    b[1100:], a[600:] = a[0] + 0.1 * r.normal(size=(400, 64)), a[0] + 0.1 * r.normal(size=(100, 64))
    a, b = (neighbours._unit(x.astype(np.float32)) for x in (a, b))
    size = neighbours._head_size(64, 0.9)
    assert 0 < size <= 32 and neighbours._head_size(8, 0.9) == 0
    heads = neighbours._heads(a, size), neighbours._heads(b, size)
    assert (heads[0] @ heads[1].T >= a @ b.T - 1e-6).all()
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(a @ b.T >= 0.9))))
    for h in (heads, None):
        found = [(i, j) for x, y, _ in neighbours._scan(a, b, h, 0.9) for i, j in zip(x.tolist(), y.tolist())]
        assert len(found) == len(set(found)) and len(want ^ set(found)) <= 2  # of 40,000, those that rounding decides


def test_planted_places_of_negative_ids(spark, tmp_path):
    """The SQL plants nothing where the remainder is negative."""
    duckdb.sql(f"COPY (SELECT CAST(i - 40 AS BIGINT) AS vec_id, CASE WHEN i <> 50 THEN list_transform(range(8), lambda j: CAST(sin(i * 8 + j * j) AS FLOAT)) END AS embedding FROM range(80) t(i)) TO '{tmp_path}/embeddings.parquet'")
    same_rows(llm.QUERIES["embedding_links"](spark, str(tmp_path)).toArrow(), duck(llm.ORACLE_SQL["embedding_links"], str(tmp_path)))
