"""Hard-negative mining by distributed radix selection over integer scores.

Rows have an id, a label and a vector; every `ANCHOR_EVERY`th id is an anchor. A component x becomes floor(SCALE * x), and
a row's score for an anchor is the integer inner product, so scores are exact and ties are real. An anchor's positives are
its best rows of the same label; a positive with score p opens a window [least % of p, most % of p], and the best rows of
other labels in it are its hard negatives. Both are one operation, select(): of each window's rows, the k best by score,
then by smaller id.

select() doesn't sort: a pass computes all scores of a block of rows and a block of anchors in a task, and counts them by
digit (RADIX_BITS bits of the score above the window's floor). Counts are summed by window; the digit in which the kth
score lies becomes the window's new floor, and the next pass counts the next digit within it. When no window has digits
left (or all it holds is wanted), floors are the kth scores, and a last pass gathers rows at or above them. A task sends the
digits of its k best only, and of rows that tie at the floor the k smallest ids, which can't change the result: the kth best of
all lies no lower than the kth best of a part. So nothing that is sent grows with a group of copies, whatever its share.

Rows and anchors travel as blocks of numbers (BLOCK rows, ANCHORS anchors), the anchors' block first, then up to TASK_BLOCKS
blocks of rows, one at a time: a task's memory is bounded, and a lost one is computed again from written blocks. A pass sends
each block of rows once for each block of anchors. Scores are computed in double precision where a bound on the sum shows
that this is exact, else in 64-bit integers.

Left out: rows with a null id, label or vector, with a null or non-finite component, or with one so large that scores
need not fit 64 bits (LARGEST; vectors have up to 16,384 components). Vectors of different lengths aren't compared. Rows that share an id count each; "other" rows
have another id. Only vec_id, label and embedding are read; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, dropped, table, written

ANCHOR_EVERY, SCALE = 50, 256
POSITIVES, NEGATIVES, LEAST, MOST = 5, 3, 50, 95
BLOCK, ANCHORS, TASK_BLOCKS = 2_048, 2_048, 4
#: Blocks of rows made in a task.
TASK_ROWS = 8
#: Tasks of a pass.
MOST_TASKS = 50_000
RADIX_BITS = 9
#: |SCALE * x| is below it, so a score of 16,384 components is below 2**62.
LARGEST = 1 << 24
#: Scores held at once in a task.
SCORES = 1 << 20

BLOCKS = "dim int, ids binary, labels binary, vecs binary"


def quantised(x: Column, scale: int = SCALE) -> Column:
    """floor(scale * component) of each, computed in double precision; null if the vector takes no part."""
    wide = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * F.lit(float(scale))) < F.lit(float(LARGEST))))
    return F.when(F.coalesce(usable, F.lit(False)), F.transform(wide, lambda c: c.cast("int")))


def _packed(most: int):
    """Blocks of up to `most` rows (vec_id, label, v) of one length."""

    def block(dim, parts):
        ids, labels, vecs = (np.concatenate(x) for x in zip(*parts))
        row = (dim, ids.tobytes(), labels.tobytes(), vecs.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), *[pa.binary()] * 3))], ["dim", "ids", "labels", "vecs"])

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            dims = np.asarray(b.column(2).value_lengths())
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                for i in range(0, len(rows), most):
                    part = b.take(pa.array(rows[i : i + most]))
                    held.setdefault(dim, []).append((np.asarray(part.column(0), np.int64), np.asarray(part.column(1), np.int64), np.asarray(part.column(2).flatten(), np.int32)))
                    if sum(len(x[0]) for x in held[dim]) >= most:
                        yield block(dim, held.pop(dim))
        for dim, parts in held.items():
            yield block(dim, parts)

    return run


@dataclass
class Blocks:
    """df: BLOCKS and a number, `block`, that is fixed because they are written; n: how many."""

    df: DataFrame
    n: int

    @classmethod
    def of(cls, rows: DataFrame, most: int, rows_each: int) -> Blocks:
        """Blocks of up to `most` rows (vec_id, label, v). rows_each: rows of a task that makes them, so that few are less than full."""
        dealt = rows.select("vec_id", "label", "v").repartition(max(1, -(-rows.count() // rows_each)))
        df = written(dealt.mapInArrow(_packed(most), BLOCKS).withColumn("block", F.monotonically_increasing_id()))
        return cls(df, df.count())


def _places(batches):
    for b in batches:
        for block, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], ["block", "at", "vec_id"])


def places(blocks: Blocks) -> DataFrame:
    """block, at, vec_id of every row of blocks."""
    return blocks.df.select("block", "ids").mapInArrow(_places, "block long, at int, vec_id long")


WINDOW = ("w", "at", "lo", "hi", "top", "above")
SENT = "block long, w int, value long, n long"


class _Cell:
    """An anchors' block with its windows: number, the anchor's place, lowest and highest score wanted, highest score counted,
    and how many rows are above that. With a shift, digits are counted; else the best rows are kept."""

    def __init__(self, row, same: bool, k: int, shift: int | None):
        self.block, self.same, self.k, self.shift = row["block"], same, k, shift
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.vecs = np.frombuffer(row["vecs"], np.int32).reshape(len(self.ids), row["dim"])
        w = np.array(sorted((x["at"], x["w"], x["lo"], x["top"] if shift is not None else x["hi"], x["above"]) for x in row["windows"]), np.int64)
        self.at, self.w, self.lo, self.hi, self.above = np.ascontiguousarray(w.T)
        self.count = np.zeros((len(w), 1 << RADIX_BITS), np.int32) if shift is not None else None
        self.best = np.zeros((3, 0), np.int64)  # window, score, id

    def meet(self, ids, labels, vecs):
        top = lambda x: int(np.abs(x).max()) if x.size else 0
        exact = top(self.vecs) * top(vecs) * vecs.shape[1] < 1 << 53
        kind = np.float64 if exact else np.int64
        used, first = np.unique(self.at, return_index=True)
        ends = np.append(first, len(self.at))
        rows, more = vecs.astype(kind), []
        step = max(1, SCORES // max(len(ids), 1))
        for i in range(0, len(used), step):
            anchors = used[i : i + step]
            scores = (self.vecs[anchors].astype(kind) @ rows.T).astype(np.int64)
            fit = (labels[None, :] == self.labels[anchors][:, None]) == self.same
            if self.same:
                fit &= ids[None, :] != self.ids[anchors][:, None]
            for j in range(len(anchors)):
                own = np.flatnonzero(fit[j])
                s, i_own = scores[j, own], ids[own]
                for x in range(ends[i + j], ends[i + j + 1]):
                    inside = (s >= self.lo[x]) & (s <= self.hi[x])
                    if not inside.any():
                        continue
                    if self.shift is not None:
                        digit = (s[inside] - self.lo[x]) >> self.shift
                        self.count[x] += np.bincount(digit, minlength=1 << RADIX_BITS)
                    else:
                        got = np.stack((np.full(int(inside.sum()), x), s[inside], i_own[inside]))
                        more.append(got[:, np.lexsort((got[2], -got[1]))[: self.k]])
        if more:
            best = np.concatenate((self.best, *more), axis=1)
            best = best[:, np.lexsort((best[2], -best[1], best[0]))]
            self.best = best[:, np.arange(best.shape[1]) - np.searchsorted(best[0], best[0]) < self.k]

    def sent(self):
        if self.shift is not None:
            # Digits from the highest down to the one in which the kth of this task's rows lies.
            down = np.cumsum(self.count[:, ::-1], 1)[:, ::-1]
            x, value = np.nonzero((self.count > 0) & (down - self.count < self.k - self.above[:, None]))
            n = self.count[x, value]
        else:
            x, value, n = self.best
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), self.block)), pa.array(self.w[x].astype(np.int32)), pa.array(value.astype(np.int64)), pa.array(n.astype(np.int64))], ["block", "w", "value", "n"])


def _pass(same: bool, k: int, shift: int | None):
    def run(batches):
        cell = None
        for b in batches:
            for r in range(b.num_rows):
                row = {name: b.column(i)[r].as_py() for i, name in enumerate(b.schema.names)}
                if row["windows"] is not None:
                    if cell:
                        yield cell.sent()
                    cell = _Cell(row, same, k, shift)
                else:
                    ids = np.frombuffer(row["ids"], np.int64)
                    cell.meet(ids, np.frombuffer(row["labels"], np.int64), np.frombuffer(row["vecs"], np.int32).reshape(len(ids), row["dim"]))
        if cell:
            yield cell.sent()

    return run


def _met(rows: Blocks, anchors: Blocks, state: DataFrame, same: bool, k: int, shift: int | None) -> DataFrame:
    """SENT of a pass: digits and their counts (with a shift), or scores and ids of the best."""
    held = state.groupBy("block").agg(F.collect_list(F.struct(*WINDOW)).alias("windows"))  # some for each of ANCHORS anchors at most
    blocks_ = anchors.df.join(held, "block")
    parts = max(1, -(-rows.n // TASK_BLOCKS))
    numbers = ("ids", "labels", "vecs")
    a = blocks_.select("dim", "block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "windows", *numbers)
    # Written blocks are numbered within a task that makes TASK_ROWS or so, from 2**33 times its number on.
    number = F.shiftright("block", 33) * TASK_ROWS + F.col("block").bitwiseAND(F.lit((1 << 33) - 1))
    part = F.pmod(number, F.lit(parts)).cast("int").alias("part")
    mine = blocks_.select("dim", "block")  # slim, a row for ANCHORS anchors
    r = rows.df.select("dim", part, *numbers).join(F.broadcast(mine) if anchors.n <= BROADCAST_ROWS else mine, "dim")
    r = r.select("dim", "block", "part", F.lit(None).cast(held.schema["windows"].dataType).alias("windows"), *numbers)
    tasks = min(MOST_TASKS, 2 * parts * max(1, anchors.n))
    met = a.unionByName(r).repartition(tasks, "block", "part").sortWithinPartitions("block", "part", F.col("windows").isNull())
    return met.select("dim", "block", "windows", *numbers).mapInArrow(_pass(same, k, shift), SENT)


def select(rows: Blocks, anchors: Blocks, windows: DataFrame, same: bool, k: int) -> DataFrame:
    """block, w, at, rank, score, vec_id of the k best rows of each window.

    windows: block, w, at (the anchor's place in its block), lo, hi (scores, both included).
    same: whether rows of the anchor's label, other than itself, or rows of other labels are wanted.
    """
    state = written(windows.where("lo <= hi").select("block", "w", "at", "lo", "hi", F.col("hi").alias("top"), F.lit(0).cast("long").alias("above"), F.lit(True).alias("open")))
    span = state.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0
    shift = -(-span.bit_length() // RADIX_BITS) * RADIX_BITS
    while shift > 0 and not state.where("open").isEmpty():
        shift -= RADIX_BITS
        counted = _met(rows, anchors, state.where("open"), same, k, shift).groupBy("block", "w", F.col("value").alias("digit")).agg(F.sum("n").alias("n"))
        counted = counted.withColumn("down", F.sum("n").over(Window.partitionBy("block", "w").orderBy(F.desc("digit"))))
        # The highest digit at which the rows from above reach k.
        hit = counted.join(state.select("block", "w", "above"), ["block", "w"]).where(F.col("above") + F.col("down") >= k)
        hit = hit.groupBy("block", "w").agg(F.max(F.struct("digit", "down", "n")).alias("hit"))
        low = F.col("lo") + F.shiftleft(F.col("hit.digit"), shift)
        further = F.col("open") & F.col("hit").isNotNull()  # a window without a hit has fewer than k rows: all are wanted
        after = state.join(hit, ["block", "w"], "left").select(
            "block",
            "w",
            "at",
            F.when(further, low).otherwise(F.col("lo")).alias("lo"),
            "hi",
            F.when(further, F.least("top", low + (1 << shift) - 1)).otherwise(F.col("top")).alias("top"),
            F.when(further, F.col("above") + F.col("hit.down") - F.col("hit.n")).otherwise(F.col("above")).alias("above"),
            (further & (F.col("above") + F.col("hit.down") > k)).alias("open"),  # with exactly k, all down to here are wanted
        )
        before, state = state, written(after)
        dropped(before)
    best = _met(rows, anchors, state, same, k, None).withColumnsRenamed({"value": "score", "n": "vec_id"})
    order = Window.partitionBy("block", "w").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = written(best.join(state.select("block", "w", "at"), ["block", "w"]))
    dropped(state)
    return out


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, embedding; anchor: a condition on vec_id. least and most: per cent of the positive's score that a
    negative's must have; a positive with a score below 0 has no negatives, as its window is empty.
    """
    used = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), quantised(F.col("embedding")).alias("v"))
    used = written(used.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL"))
    all_rows, anchors = Blocks.of(used, BLOCK, TASK_ROWS * BLOCK), Blocks.of(used.where(anchor), ANCHORS, ANCHORS)
    # No score is beyond the largest squared length.
    bound = used.agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x))).first()[0] or 0
    named = places(anchors)
    first = select(all_rows, anchors, named.select("block", F.col("at").alias("w"), "at", F.lit(-bound).alias("lo"), F.lit(bound).alias("hi")), True, positives)
    pairs = first.select("block", (F.col("at") * positives + F.col("rank") - 1).alias("w"), "at", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    lo, hi = F.expr(f"({least} * positive_score + 99) div 100"), F.expr(f"({most} * positive_score) div 100")
    found = select(all_rows, anchors, pairs.where("positive_score >= 0").select("block", "w", "at", lo.alias("lo"), hi.alias("hi")), False, negatives)
    out = found.select("block", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["block", "w"])
    out = out.join(named.withColumnRenamed("vec_id", "anchor_id"), ["block", "at"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % ANCHOR_EVERY == 0)


OP12_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, r.vec_id AS r, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS s FROM e a JOIN e r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id AND len(a.v) = len(r.v)),
p AS (SELECT a, r AS p, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, r) <= 5),
n AS (SELECT a, p, ps, r, s.s, row_number() OVER (PARTITION BY a, p ORDER BY s.s DESC, r) AS k FROM p JOIN s USING (a) WHERE NOT same AND 50 * ps <= 100 * s.s AND 100 * s.s <= 95 * ps)
SELECT a AS anchor_id, p AS positive_id, CAST(k AS INTEGER) AS rank, r AS negative_id, ps AS positive_score, s AS negative_score FROM n WHERE k <= 3
"""
