"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weighted share of all words, at most `cap` times its own; what is cut off
goes to the others by weight until none is above its limit (water level over the sources sorted by
limit / weight). Of a source whose target is f times its size, every document gets floor(f) whole copies.
The rest, f - floor(f) of the source's words, is a fixed-size sample with unequal probabilities: a document's
inclusion probability grows with its weight, by default 1 + the whole root of its words, or a column of whole numbers
(missing or negative: 0, never needed). Documents whose probability would reach 1 get one certain copy more and
leave the sample, and the probabilities of the others are found anew, until all are below 1; so the expected
words are the rest. Then documents are ranked by the odds of a uniform number (from an MD5 of seed, doc_id and text) divided
by the odds of their inclusion probability, and taken in that order until the words are full.

The size is fixed in words, not documents, so that a source misses its target by half a document at
most. No task sees a whole source: certain weights are found in a table of words by source and weight, the threshold
in a histogram of the rank by source, then among the rows of one bin of each source.

Nulls: a null source is a source of its own, after all others; a null text has no words and is never
taken. Rows equal in doc_id and text are taken alike. A table without words takes nothing. Other columns,
whatever their names, pass through mixed_documents() unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, fitted, table, written

BINS = 4096
WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 20_011
#: What sized() returns besides source.
SLIM = ("source", "size", "weight", "draw", "tie")


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def _hex(digest: Column, at: int, digits: int) -> Column:
    return F.conv(F.substring(digest, at, digits), 16, 10).cast("long")


def sized(docs: DataFrame, weight: str | None = None, seed: int = SEED, keep: list[Column] = ()) -> DataFrame:
    """`keep`, source, size (words), weight, draw (52 bits) and tie, by row of docs."""
    n = words_in(F.col("text"))
    w = F.greatest(F.coalesce(F.col(weight).cast("long"), F.lit(0)), F.lit(0)) if weight else F.floor(F.sqrt(n.cast("double"))) + 1
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.md5("text"), F.lit(""))))
    out = docs.select(*keep, "source", n.alias("size"), w.cast("long").alias("weight"), digest.alias("digest"))
    return out.select(*[c for c in out.columns if c not in SLIM[:3] and c != "digest"], *SLIM[:3], _hex(F.col("digest"), 1, 13).alias("draw"), _hex(F.col("digest"), 14, 15).alias("tie"))


def source_targets(rows: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target; one row a source, so single-task windows over sources are small."""
    all_rows, by_name = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("double"))
    s = s.withColumn("limit", F.lit(cap) * F.col("source_size"))
    before = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", F.try_divide(F.sum("source_size").over(all_rows) - F.coalesce(F.sum("limit").over(before), F.lit(0)), F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("full", F.col("limit") <= F.col("w") * F.col("level"))
    # Sorted so, the full sources come first; the level of the first other one holds for all others.
    first = F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("w"), F.col("level").alias("level")))).over(all_rows)["level"]
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("w") * first, F.col("limit").cast("double")))
    return s.select("source", "source_size", target.alias("target"))


def _with_source(rows: DataFrame, plan: DataFrame, *columns: str) -> DataFrame:
    """rows with columns of plan, which has one row a source."""
    p = plan.select(F.col("source").alias("plan_source"), *columns)
    return rows.join(fitted(p, 100_000), F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")


def _rank() -> Column:
    """A number in (0, 1) that grows with the Pareto quotient; null for rows outside the sample."""
    u = (F.col("draw").cast("double") + 0.5) / float(1 << 52)
    share = F.when((F.col("weight") > 0) & (F.col("weight") <= F.col("most")), F.col("rate") * F.col("weight"))
    q = (u / (1 - u)) / (share / (1 - share))
    return q / (1 + q)


def certain_weights(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with copies (whole copies of every document), need (words of the sample), most (the greatest weight in the sample; heavier
    documents are certain) and rate (a probability is rate * weight)."""
    f = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    t = written(targets.withColumn("copies", F.floor(f)).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.floor(f) * F.col("source_size"))))
    kinds = rows.where("size > 0 AND weight > 0").groupBy("source", "weight").agg(F.sum("size").alias("s"))
    w = Window.partitionBy("source").orderBy(F.col("weight").desc())
    kinds = _with_source(kinds, t, "rest").withColumns({
        "above": F.coalesce(F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "below": F.sum(F.col("weight") * F.col("s")).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    need = F.col("rest") - F.col("above")
    fits = kinds.where((F.col("rest") > 0) & (need * F.col("weight") < F.col("below")))
    fits = fits.groupBy("source").agg(F.max_by(F.struct(F.col("weight").alias("most"), need.alias("need"), (need / F.col("below")).alias("rate")), "weight").alias("p"))
    return t.join(fits.select(F.col("source").alias("s"), "p"), F.col("source").eqNullSafe(F.col("s")), "left").select(*t.columns, F.coalesce("p.need", F.lit(0.0)).alias("need"), "p.most", "p.rate")


def mix_plan(rows: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row a source: its target, whole copies, certain weights and the last (rank, tie) that the sample takes. rows: as sized() makes them."""
    rows = rows.select(*SLIM)
    t = written(certain_weights(rows, source_targets(rows, weights, cap)))
    ranked = _with_source(rows.where("size > 0"), t, "need", "most", "rate").withColumn("rank", _rank()).where("rank IS NOT NULL").withColumn("bin", F.floor(F.col("rank") * BINS))
    bins = ranked.groupBy("source", "bin", "need").agg(F.sum("size").alias("n"))
    bins = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("bin"))).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
    edge = bins.select("source", F.col("bin").alias("edge"), (F.col("upto") - F.col("n")).alias("before"))
    near = _with_source(ranked, edge, "edge", "before").where("bin = edge")
    order = Window.partitionBy("source").orderBy("rank", "tie")
    near = near.withColumn("upto", F.col("before") + F.sum("size").over(order))  # equal rows share a place
    here = F.sum("size").over(Window.partitionBy("source", "rank", "tie"))
    near = near.withColumn("take", F.col("need") - (F.col("upto") - here) > F.col("upto") - F.col("need"))
    cut = near.groupBy("source").agg(F.max(F.when(F.col("take"), F.struct("rank", "tie"))).alias("last"), F.min("edge").alias("edge"))
    cut = cut.select(F.col("source").alias("s"), "edge", F.col("last.rank").alias("last_rank"), F.col("last.tie").alias("last_tie"))
    return written(t.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))


def mix_sources(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of sized() with source_size, target and taken_copies (0 to the cap)."""
    r = _with_source(rows, plan, "source_size", "target", "copies", "need", "most", "rate", "edge", "last_rank", "last_tie").withColumn("rank", _rank())
    b = F.floor(F.col("rank") * BINS)
    taken = (b < F.col("edge")) | ((b == F.col("edge")) & ((F.col("rank") < F.col("last_rank")) | ((F.col("rank") == F.col("last_rank")) & (F.col("tie") <= F.col("last_tie")))))
    certain = F.col("weight") > F.col("most")
    copies = F.col("copies") + F.coalesce(certain | ((F.col("need") > 0) & taken), F.lit(False)).cast("int")
    return r.select(*rows.columns, "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(0).cast("int").alias("taken_copies"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = SEED, weight: str | None = None) -> DataFrame:
    """The documents of the mix, each row as often as it is taken, with the columns of docs."""
    plan = mix_plan(written(sized(docs, weight, seed)), weights, cap)
    out = mix_sources(sized(docs, weight, seed, [F.struct("*").alias("row")]), plan).where("taken_copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), "taken_copies"))).select("row.*")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    rows = written(sized(table(spark, sf_dir, "documents"), keep=[F.col("doc_id")]))
    out = mix_sources(rows, mix_plan(rows))
    return out.select("doc_id", "size", "source_size", "target", (F.col("taken_copies") * F.col("size")).alias("taken"), F.col("taken_copies").alias("copies"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('20011|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')) AS h FROM documents),
r AS (SELECT *, CAST(floor(sqrt(CAST(size AS DOUBLE))) AS BIGINT) + 1 AS w, (CAST(CAST('0x' || substr(h, 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u, CAST('0x' || substr(h, 14, 15) AS BIGINT) AS tie FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM r GROUP BY source),
l AS (SELECT *, 3 * n AS top, CAST([5, 2, 1][(k - 1) % 3 + 1] AS DOUBLE) AS sw FROM s),
v AS (SELECT *, CAST(sum(n) OVER () - coalesce(sum(top) OVER b, 0) AS DOUBLE) / (sum(sw) OVER () - coalesce(sum(sw) OVER b, 0)) AS level FROM l WINDOW b AS (ORDER BY top / sw, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, n, least(CAST(top AS DOUBLE), coalesce(sw * (SELECT arg_min(level, top / sw) FROM v x WHERE NOT x.top <= x.sw * x.level), CAST(top AS DOUBLE))) AS target FROM v),
p AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS base, CASE WHEN n > 0 THEN greatest(0, target - floor(target / n) * n) ELSE 0 END AS rest FROM t),
k AS (SELECT source, w, sum(size) AS s FROM r WHERE size > 0 GROUP BY ALL),
c AS (SELECT k.*, rest, rest - CAST(coalesce(sum(s) OVER (PARTITION BY k.source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS need, CAST(sum(w * s) OVER (PARTITION BY k.source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS below FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source),
m AS (SELECT source, max(w) AS most, arg_max(need, w) AS need, arg_max(need / below, w) AS rate FROM c WHERE rest > 0 AND need * w < below GROUP BY source),
q AS (SELECT r.*, p.n, p.target, p.base, m.most, m.need, CASE WHEN r.w <= m.most THEN (u / (1 - u)) / ((rate * r.w) / (1 - rate * r.w)) END AS x FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source LEFT JOIN m ON r.source IS NOT DISTINCT FROM m.source),
o AS (SELECT *, x / (1 + x) AS rank FROM q),
z AS (SELECT *, sum(CASE WHEN x IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rank, tie) AS upto, sum(size) OVER (PARTITION BY source, rank, tie) AS here FROM o),
f AS (SELECT *, CASE WHEN size > 0 THEN CAST(base AS INT) + CASE WHEN w > most OR (x IS NOT NULL AND need > 0 AND need - (upto - here) > upto - need) THEN 1 ELSE 0 END ELSE 0 END AS copies FROM z)
SELECT doc_id, size, n AS source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS INT) AS copies FROM f
"""
