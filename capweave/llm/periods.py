"""Periodic runs of words, found by bit-parallel lags.

Words are the SPACE_WORD words of a text, compared byte for byte. A run is a stretch of consecutive words with smallest period q (words q apart are
equal) of max(LEAST, TIMES * q) words or more that no neighbouring word extends. Of a run, the words behind the first q are repeats.

A document's words get numbers, and bit b of all numbers is one big integer, a bit plane. For a lag q, each plane is XORed with itself shifted by
q places and the results are ORed: a zero bit says that a word equals the one q places on. Zero stretches of the length wanted are isolated by
ANDing the complement with itself, shifted by 1, 2, 4, ... places, so a stretch of any length takes as many steps as its length has bits.

Lags that can't have a run are passed over first, without loss. A run of period q is TIMES * q words long at least, so from the first multiple
kq within it, q words equal those from (k+1)q on: hashes of 2**j <= q words at multiples of q must agree for some k, which takes n/q
comparisons a lag and n log n for all. Nor is a k followed whose words kq..(k+2)q lie within a run of a smaller period: by Fine and Wilf
that run's period divides q throughout, so q isn't the smallest. Lags go upward, hence a text of one word or two words in turn has one lag left. Hashes
choose lags only; planes decide. A document is worked on alone: its task holds it, its numbers and its planes (about 40 bytes a word).

Nulls: a null text has no words. A null doc_id is a row like any other, so are repeated ones. Empty texts and tables give empty results. Only
doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORD, by_batches, table
from .words import U, mix

LEAST, TIMES = 24, 3
#: Lags below it are always tried.
SHORT = 8


class Planes:
    """Bit planes of numbers; bit i of an integer stands for place i."""

    def __init__(self, numbers: np.ndarray):
        self.n = len(numbers)
        top = int(numbers.max()) if self.n else 0
        pack = lambda bits: int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        self.planes = [pack((numbers >> b) & 1) for b in range(top.bit_length())]

    def equal(self, lag: int) -> int:
        """The places whose number is that of the place `lag` further on."""
        off = 0
        for p in self.planes:
            off |= p ^ (p >> lag)
        return ~off & ((1 << max(self.n - lag, 0)) - 1)


def stretches(ones: int, least: int) -> list[tuple[int, int]]:
    """(start, length) of the maximal stretches of `least` or more one bits."""
    x, have = ones, 1
    while have < least and x:
        step = min(have, least - have)
        x &= x >> step
        have += step
    out = []
    if x:
        # Bits of x are the starts of `least` ones; a maximal stretch of k of them has k + least - 1.
        edge = x ^ (x << 1)
        at = np.flatnonzero(np.unpackbits(np.frombuffer(edge.to_bytes((edge.bit_length() + 7) // 8, "little"), np.uint8), bitorder="little"))
        out = [(int(a), int(b - a) + least - 1) for a, b in zip(at[::2], at[1::2])]
    return out


def _lags(numbers: np.ndarray, reach: np.ndarray, most: int):
    """Lags that may have a run, upward. reach: by place, how far runs found so far go that cover it; changed by the caller meanwhile."""
    n = len(numbers)
    hashed, width = mix(numbers.astype(U) + U(1)), 1
    for q in range(1, most + 1):
        while 2 * width <= q:
            hashed, width = _doubled(hashed, width), 2 * width
        at = hashed[::q]
        same = at[1:] == at[:-1]
        if same.any():
            k = np.flatnonzero(same) * q
            k = k[k + 2 * q <= n]
            if (reach[k] < k + 2 * q).any():
                yield q


def _doubled(hashed: np.ndarray, by: int) -> np.ndarray:
    """Hashes of stretches that are `by` longer, of which each begins with one of `hashed` and ends with the one `by` further on."""
    return mix(hashed[:-by] + mix(hashed[by:] ^ U(0x9E3779B97F4A7C15)))


def _farthest(numbers: np.ndarray, width: int) -> int:
    """The largest distance between places at which `width` equal words can begin; 0 if there are no two."""
    hashed, have = mix(numbers.astype(U) + U(1)), 1
    while have < width:
        by = min(have, width - have)
        hashed, have = _doubled(hashed, by), have + by
    order = np.argsort(hashed, kind="stable")
    twice = hashed[order][1:] == hashed[order][:-1]
    at = order[np.append(twice, False) | np.append(False, twice)]
    return int(at.max() - at.min()) if len(at) else 0


def runs(numbers: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of times >= 3 periods and `least` places, by start, then period."""
    n = len(numbers)
    if n < max(least, times):
        return []
    # A third of `least` words, or of a period if that is longer, stand twice in a run.
    most = min(n // times, _farthest(numbers, max(1, least // 3)))
    if not most:
        return []
    planes, reach, out = Planes(numbers), np.zeros(n, np.int64), []
    for q in _lags(numbers, reach, most):
        for start, length in stretches(planes.equal(q), max(least - q, (times - 1) * q)):
            end = start + length + q
            if reach[start] < end:  # else it lies in a run of a smaller period
                out.append((start, end - start, q))
                reach[start:end] = np.maximum(reach[start:end], end)
    return sorted(out, key=lambda r: (r[0], r[2]))


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _found(least: int, times: int):
    def run(batches):
        for b in batches:
            n_words, found, collapsed = [], [], []
            for text in b.column(1).cast(pa.large_string()).cast(pa.large_binary()):
                words = (text.as_py() or b"").split()  # of bytes: at ASCII white space only
                own = []
                if len(words) >= least:
                    seen: dict[bytes, int] = {}
                    own = runs(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)), least, times)
                edge = np.zeros(len(words) + 1, np.int64)
                for start, length, period in own:
                    edge[start + period] += 1
                    edge[start + length] -= 1
                kept = words if not own else [w for w, c in zip(words, np.cumsum(edge)[:-1].tolist()) if not c]
                n_words.append(len(words))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                collapsed.append(b" ".join(kept))
            arrays = [b.column(0), pa.array(n_words, pa.int64()), pa.array(found, pa.list_(RUN)), pc.cast(pa.array(collapsed, pa.binary()), pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed (words that aren't repeats, joined by one space) by row of docs."""
    if times < 3:
        raise ValueError("lags are passed over on the ground that a run has three periods or more")
    return by_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _found(least, times), RESULT)


def best_run(runs: Column) -> Column:
    """Of an array of runs by start and period, the one with the greatest exact length / period, the first of several."""
    better = lambda a, x: a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"])
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.reduce(runs, none, lambda a, x: F.when(better(a, x), x).otherwise(a))


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text of docs; in every tenth document by its id's CRC-32, the words from some place on repeat those before them.
    A null doc_id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    w = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(SPACE_WORD), F.lit(0))
    d = docs.select("doc_id", "text", F.when(h % 10 == 0, w).alias("w"), F.expr("crc32(CAST(CAST(doc_id AS BIGINT) AS STRING)) div 10").alias("g"))
    d = d.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    place = lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return d.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.transform("w", place), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeats(table(spark, sf_dir, "documents"))).withColumn("best", best_run(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP13_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) AS h FROM documents),
u AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
d AS (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i + 1 ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1 END]) END AS w FROM u),
v AS (SELECT rid, i, w[i + 1] AS x, md5(array_to_string(w[i + 1:i + 8], ' ')) AS e, n FROM d, unnest(range(0, n)) r(i) WHERE n >= 24),
c AS (SELECT DISTINCT a.rid, b.i - a.i AS q FROM v a JOIN v b ON a.rid = b.rid AND a.e = b.e AND a.i < b.i AND b.i - a.i <= a.n // 3 AND (b.i - a.i < 8 OR a.i % (b.i - a.i) = 0)),
e AS (SELECT a.rid, q, a.i, a.i - row_number() OVER (PARTITION BY a.rid, q ORDER BY a.i) AS k FROM c JOIN v a USING (rid) JOIN v b ON a.rid = b.rid AND b.i = a.i + q AND a.x = b.x),
s AS (SELECT rid, q, min(i) AS a, count(*) + q AS l FROM e GROUP BY rid, q, k HAVING count(*) >= greatest(24 - q, 2 * q)),
r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.rid = s.rid AND o.q < s.q AND o.a <= s.a AND o.a + o.l >= s.a + s.l)),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY rid ORDER BY l * 1000000000000 // q DESC, a, q) = 1),
g AS (SELECT rid, count(*) AS n, string_agg(a || ',' || l || ',' || q || chr(10), '' ORDER BY a, q) AS t FROM r GROUP BY rid),
x AS (SELECT DISTINCT rid, p FROM r, unnest(range(a + q, a + l)) t(p)),
k AS (SELECT d.rid, string_agg(d.w[p + 1], ' ' ORDER BY p) AS t FROM d, unnest(range(0, d.n)) t(p) WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.rid = d.rid AND x.p = t.p) GROUP BY d.rid)
SELECT doc_id, coalesce(g.n, 0) AS n_runs, b.a AS start, b.l AS length, b.q AS period, 1000 * b.l // b.q AS exponent_milli, sha256(coalesce(g.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (rid) LEFT JOIN g USING (rid) LEFT JOIN k USING (rid)
"""
