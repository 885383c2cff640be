"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has CELLS positions. Each shard owns `virtual_nodes` of them; a key belongs to the first
node at or clockwise of its cell. Every shard has a capacity, and a key that meets a full shard goes
on clockwise to the next shard with room. A key is a row's doc_id with the checksum and the bytes of its text, so that rows that
share an id (or have none) don't meet in one cell. Keys enter in ring order (cell, hash, doc_id, checksum, size),
so that the outcome depends on the rows alone.

With `load_factor` 1 capacities add up to the rows, and counts differ by one at most; every shard is then full at the end, and one more
shard moves more keys than the ring alone would. A larger factor leaves room and moves fewer: movement() tells how many.

Only counts by cell reach the driver (CELLS rows, whatever the input); there the capacities are
spent, and the resulting segments (cell, ranks, shard, first slot) go back as a table of at most
CELLS + shards rows. Ranks within a cell are the only thing that Spark sorts.

Nulls: a null doc_id has a place on the ring like any other key; a null text has no bytes and the
checksum 0. Repeated rows keep their own slots. An empty table gives an empty result. Columns of the
input named shard, slot or home_shard are replaced; others, whatever their names, pass through.
"""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

CELLS = 1 << 14
VIRTUAL_NODES = 256
RING_SEED = 1021


def ring_nodes(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of every node, in ring order; a taken cell sends a node to the next free one."""
    if shards < 1 or shards * virtual_nodes > CELLS // 2:
        raise ValueError(f"1 to {CELLS // 2} nodes fit on the ring")
    taken: dict[int, int] = {}
    for shard in range(shards):
        for node in range(virtual_nodes):
            cell = int.from_bytes(hashlib.sha256(f"shard {shard} node {node}".encode()).digest()[:8], "big") % CELLS
            while cell in taken:
                cell = (cell + 1) % CELLS
            taken[cell] = shard
    return sorted(taken.items())


def capacities(rows: int, shards: int, load_factor: float = 1.0) -> list[int]:
    """With factor 1 they add up to the rows and differ by one at most; a larger factor leaves room."""
    if load_factor < 1:
        raise ValueError("load_factor is at least 1")
    even = [rows // shards + (shard < rows % shards) for shard in range(shards)]
    return even if load_factor == 1 else [math.ceil(load_factor * rows / shards)] * shards


def segments(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot, home shard), spending the room in ring order."""
    room, used, out = list(room), [0] * len(room), []
    following = list(range(len(nodes)))  # of each node, the next whose shard may have room

    def open_node(at: int) -> int:
        path = []
        for _ in range(len(nodes) + 1):
            if room[nodes[at][1]]:
                break
            path.append(at)
            at = following[at] if following[at] != at else (at + 1) % len(nodes)
        for p in path:
            following[p] = at
        return at

    cells, k = [c for c, _ in nodes], 0
    for cell in sorted(counts):
        while k < len(cells) and cells[k] < cell:
            k += 1
        home, at, rank = k % len(nodes), k % len(nodes), 0
        while rank < counts[cell]:
            at = open_node(at)
            shard = nodes[at][1]
            n = min(counts[cell] - rank, room[shard])
            out.append((cell, rank, rank + n, shard, used[shard], nodes[home][1]))
            room[shard] -= n
            used[shard] += n
            rank += n
    return out


def movement(counts: dict[int, int], shards: int, virtual_nodes: int = VIRTUAL_NODES, load_factor: float = 1.0) -> tuple[float, float]:
    """Shares of the keys (by cell) that change their shard when there is one more: of all keys, and those that go to another shard than the new one."""
    rows, moved, elsewhere = sum(counts.values()), 0, 0
    before, after = ({} for _ in range(2))
    for into, k in ((before, shards), (after, shards + 1)):
        for cell, a, b, shard, *_ in segments(counts, ring_nodes(k, virtual_nodes), capacities(rows, k, load_factor)):
            into.setdefault(cell, []).append((a, b, shard))
    for cell, parts in before.items():
        for a, b, shard in parts:
            for c, d, other in after[cell]:
                if other != shard and (n := min(b, d) - max(a, c)) > 0:
                    moved += n
                    elsewhere += n * (other != shards)
    return moved / max(rows, 1), elsewhere / max(rows, 1)


def shard_documents(docs: DataFrame, shards: int = 24, virtual_nodes: int = VIRTUAL_NODES, load_factor: float = 1.0) -> DataFrame:
    """docs with shard, slot (gapless from 0 in each shard) and home_shard (the ring's choice before loads)."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot", "home_shard")
    text = F.col("text") if "text" in docs.columns else F.lit(None).cast("string")
    tie = [F.coalesce(F.crc32(text.cast("binary")), F.lit(0)), F.coalesce(F.octet_length(text), F.lit(0))]
    # Rows that differ anywhere have an order of their own (maps can't be hashed; rows that differ there alone are ordered by chance).
    own = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if f.dataType.typeName() not in ("map", "variant")])
    return _dealt(spark, docs.select(F.struct("*").alias("row"), "doc_id", tie[0].alias("crc"), tie[1].alias("bytes"), own.alias("own")), shards, virtual_nodes, load_factor).select("row.*", "shard", "slot", "home_shard")


def _dealt(spark, keys: DataFrame, shards: int, virtual_nodes: int, load_factor: float) -> DataFrame:
    """keys (doc_id, crc, bytes, perhaps own: a tie-breaker, and others) with shard, slot and home_shard."""
    order = ["spot", "doc_id", "crc", "bytes", *(["own"] if "own" in keys.columns else [])]
    spot = F.xxhash64(F.lit(RING_SEED), "doc_id", F.col("crc").cast("long"), F.col("bytes").cast("long"))
    keys = keys.withColumn("spot", spot).withColumn("cell", F.pmod("spot", F.lit(CELLS)).cast("int"))
    counts = {r["cell"]: r["n"] for r in keys.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # CELLS rows at most
    parts = segments(counts, ring_nodes(shards, virtual_nodes), capacities(sum(counts.values()), shards, load_factor))
    fields = ("of", "from", "to", "shard", "first", "home_shard")
    kind = "array<struct<of:int,from:bigint,to:bigint,shard:int,first:bigint,home_shard:int>>"
    parts_df = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([dict(zip(fields, p)) for p in parts])), kind)))
    ranked = keys.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy(*order)) - 1)
    fits = (F.col("cell") == F.col("of")) & (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to"))
    # At most CELLS + shards rows are broadcast.
    return ranked.join(F.broadcast(parts_df), fits).withColumn("slot", F.col("first") + F.col("rank") - F.col("from"))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    keys = docs.select("doc_id", F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("crc"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    out = _dealt(spark, keys, 24, VIRTUAL_NODES, 1.0)
    return out.select(
        "doc_id",
        (F.col("bytes") + 8).cast("long").alias("size"),
        F.col("crc").cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "home_shard",
    )


def shard_loads(spark, sf_dir: str) -> DataFrame:
    """Rows, slots and bytes of the shards of op10."""
    out = op10_sharding(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("slots"))
    return out.withColumn("shard", F.col("shard").cast("long"))


SHARD_LOADS_SQL = """
WITH c AS (SELECT count(*) AS n FROM documents), s AS (SELECT CAST(k AS BIGINT) AS shard, n // 24 + CASE WHEN k < n % 24 THEN 1 ELSE 0 END AS n FROM c, range(24) t(k))
SELECT shard, CAST(n AS BIGINT) AS n, CAST(0 AS BIGINT) AS first_slot, CAST(n - 1 AS BIGINT) AS last_slot, CAST(n AS BIGINT) AS slots FROM s WHERE n > 0
"""
