"""Connected components of large edge tables, kept distributed throughout."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

EDGE = "v long, root long"


class Forest:
    """Union-find over labels; the smallest label of a tree is its root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root and y != x:
            up[x], x = root, y
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _forests(batches):
    """Of a partition's edges, one edge from each vertex to its root: as many as vertices at most."""
    forest = Forest()
    for b in batches:
        for v, root in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            forest.join(v, root)
    found = [(v, forest.find(v)) for v in forest.up]
    for i in range(0, len(found), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found[i : i + 50_000])], ["v", "root"])


def components(edges: DataFrame) -> DataFrame:
    """v, root (the smallest label reachable) of every vertex that isn't its own root, by alternating stars.

    edges: two columns of 64-bit labels without nulls. Each round (a large star, a small star) is written
    to the shared folder; it ends when a round changes nothing. Loops and repeated edges do no harm.
    """
    a, b = edges.columns
    edges = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("root")).where("v > root").mapInArrow(_forests, EDGE)
    # Once more with all edges of a vertex together: a dense group then has about an edge a vertex.
    edges = edges.repartition("v").mapInArrow(_forests, EDGE)
    now, mark = written(edges), None
    while True:
        both = now.unionByName(now.select(F.col("root").alias("v"), F.col("v").alias("root")))
        low = both.groupBy("v").agg(F.least(F.min("root"), F.col("v")).alias("m"))
        large = both.join(low, "v").where("root > v").select(F.col("root").alias("v"), F.col("m").alias("root")).distinct()
        low = large.groupBy("v").agg(F.min("root").alias("m"))
        small = large.join(low, "v")
        small = small.select("v", F.col("m").alias("root")).unionByName(small.where("root > m").select(F.col("root").alias("v"), F.col("m").alias("root"))).distinct()
        after = written(small)
        r = after.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "root")).alias("x"), F.sum(F.hash("v", "root").cast("long")).alias("s")).first()
        if mark is None:
            p = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "root")).alias("x"), F.sum(F.hash("v", "root").cast("long")).alias("s")).first()
            mark = tuple(p)
        dropped(now)
        now = after
        if tuple(r) == mark:
            return now
        mark = tuple(r)


