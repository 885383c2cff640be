"""Scoring extracted rows against ground truth.

Rows on both sides: doc_id, ord, name, share_type, share_count. Matching that consumes rows one by one runs over
one document at a time; names are compared in Spark beforehand, by keys made once a row.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import names_match, no_space, scoring_keys
from ..plans.stages import written
from .folds import by_key
from .relational import missing_from, unique_match, zero_filled

CORRECT = "correct"
# The failure types.
FAILURES = ("name_truncation", "name_corruption", "share_type_mismatch", "share_count_mismatch", "row_omission", "row_hallucination")


def _keyed(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.col("ord").cast("long").alias("ord"), "name", F.coalesce("share_type", F.lit("")).alias("share_type"), F.coalesce("share_count", F.lit(0)).cast("long").alias("share_count"), scoring_keys(F.col("name")).alias("k"), no_space(F.col("name")).alias("packed"))


def _pairs_by_count(truth: DataFrame, rows: DataFrame) -> DataFrame:
    """Ordinals that one count, unique on either side, brings together."""
    side = lambda d, n: d.select("doc_id", F.coalesce("share_count", F.lit(0)).cast("long").alias("share_count"), F.col("ord").cast("long").alias(n)).where("share_count > 0")
    return unique_match(side(truth, "g"), side(rows, "e"), ["doc_id", "share_count"]).where("side = 'both'").select("doc_id", "g", "e")


def _nearest_index(doc: object, columns: list[list]) -> list[tuple]:
    """Each truth row, in order, takes the nearest free row; of two as near, the lower one. Taken rows are skipped by links to the next
    free one on either side, so a document costs little more than sorting it."""
    rows = [n for n, truth in zip(*columns) if not truth]
    n, out = len(rows), []
    down, up = list(range(n + 1)), list(range(n + 1))  # places 1 to n and 0; places 0 to n - 1 and n

    def free(links, at):
        path = []
        while links[at] != at:
            path.append(at)
            at = links[at]
        for p in path:
            links[p] = at
        return at

    for g, truth in zip(*columns):
        if truth:
            at = bisect.bisect_left(rows, g)
            low, high = free(down, at) - 1, free(up, at)
            if low < 0 and high == n:
                break
            best = low if high == n or (low >= 0 and g - rows[low] <= rows[high] - g) else high
            down[best + 1], up[best] = best, best + 1
            out.append((doc, g, rows[best]))
    return out


def nearest_index(left: DataFrame, right: DataFrame) -> DataFrame:
    """doc_id, g, e: one-to-one, greedy by distance of ordinals (doc_id, ord)."""
    side = lambda d, truth: d.select("doc_id", F.col("ord").cast("long").alias("ord"), F.lit(truth).alias("truth"))
    both = side(left, True).unionByName(side(right, False))
    return by_key(both, ["ord"], _nearest_index, both.select("doc_id", F.col("ord").alias("g"), F.col("ord").alias("e")).schema)


def matched(truth: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, g, e: pairs by unique count, then by nearest place."""
    first = _pairs_by_count(truth, rows)
    rest = lambda d, c: d.select("doc_id", F.col("ord").cast("long").alias("ord")).join(first.select("doc_id", F.col(c).alias("ord")), ["doc_id", "ord"], "left_anti")
    return first.unionByName(nearest_index(rest(truth, "g"), rest(rows, "e")))


def classified(truth: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, g, e, type and both rows (truth, extracted); unmatched rows are omissions and hallucinations."""
    whole = lambda d, n: d.select("doc_id", F.col("ord").cast("long").alias(n), F.struct("name", F.coalesce("share_type", F.lit("")).alias("share_type"), F.coalesce("share_count", F.lit(0)).cast("long").alias("share_count")).alias(f"row_{n}"))
    both = whole(truth, "g").join(matched(truth, rows), ["doc_id", "g"], "left").join(whole(rows, "e"), ["doc_id", "e"], "full")
    g, e = F.col("row_g"), F.col("row_e")
    # Names are normalised once, for rows that have a partner; equal ones need no key.
    pair = g.isNotNull() & e.isNotNull()
    both = both.withColumn("keys", F.when(pair & (g["name"] != e["name"]), F.struct(scoring_keys(g["name"]).alias("g"), scoring_keys(e["name"]).alias("e"))))
    a, b, other = F.col("keys.g.plain"), F.col("keys.e.plain"), F.coalesce(~names_match(F.col("keys.g"), F.col("keys.e")), F.lit(False))
    kind = (
        F.when(g.isNull(), "row_hallucination")
        .when(e.isNull(), "row_omission")
        .when(other & (b != "") & a.startswith(b) & (F.length(b) < F.length(a)), "name_truncation")
        .when(other, "name_corruption")
        .when(g["share_type"] != e["share_type"], "share_type_mismatch")
        .when(g["share_count"] != e["share_count"], "share_count_mismatch")
        .otherwise(CORRECT)
    )
    return both.select("doc_id", "g", "e", kind.alias("type"), g.alias("truth"), e.alias("extracted"))


def failure_counts(found: DataFrame) -> DataFrame:
    """type, n: every failure type and correct, 0 where there is none."""
    dim = found.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in (CORRECT, *FAILURES)])).alias("type"))
    return zero_filled(found.groupBy("type").agg(F.count("*").alias("n")), dim, "type", "n")


def accuracy(found: DataFrame) -> DataFrame:
    """doc_id, n_truth, n_correct, accuracy (0 without truth)."""
    agg = found.groupBy("doc_id").agg(F.count("truth").alias("n_truth"), F.count_if(F.col("type") == CORRECT).alias("n_correct"))
    return agg.withColumn("accuracy", F.coalesce(F.try_divide("n_correct", "n_truth"), F.lit(0.0)))


def passed(truth: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, passed: equal length, and every row equal at its place; documents without a result fail."""
    place = lambda d, n: _keyed(d).withColumn("o", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).select("doc_id", "o", F.struct("share_type", "share_count", "k").alias(n))
    both = place(truth, "g").join(place(rows, "e"), ["doc_id", "o"], "full")
    g, e = F.col("g"), F.col("e")
    same = F.coalesce(names_match(g["k"], e["k"]) & (g["share_type"] == e["share_type"]) & (g["share_count"] == e["share_count"]), F.lit(False))
    return both.groupBy("doc_id").agg(F.bool_and(same).alias("passed"))


def missing_and_extra(truth: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, name, share_type, share_count, side: missing or extra, as sets."""
    cut = lambda d: d.select("doc_id", "name", F.coalesce("share_type", F.lit("")).alias("share_type"), "share_count")
    a, b = cut(truth), cut(rows)
    return missing_from(a, b).withColumn("side", F.lit("missing")).unionByName(missing_from(b, a).withColumn("side", F.lit("extra")))


def _rows(df: DataFrame, at: str, row: str) -> DataFrame:
    return _keyed(df).select("doc_id", F.col("ord").alias(at), F.struct("name", "share_type", "share_count", "k", "packed").alias(row))


def _agreeing(pairs: DataFrame) -> DataFrame:
    """doc_id, g, e and what agrees of their rows a and b."""
    a, b = F.col("a"), F.col("b")
    packed = a["packed"] == b["packed"]
    inner = (F.contains(b["packed"], a["packed"]) | F.contains(a["packed"], b["packed"])) & (F.length(a["packed"]) > F.length(b["packed"]))
    agree = {"packed": packed, "fuzzy": packed | names_match(a["k"], b["k"]), "kind": a["share_type"] == b["share_type"], "count": a["share_count"] == b["share_count"], "inner": inner}
    return pairs.withColumns(agree).drop("a", "b")


def _spread(d: DataFrame, at: str, row: str, keys) -> DataFrame:
    """h, i, c, doc_id, `at`: a name's forms, whole (i 0) and without their i-th character (c), each with the keys as one hash."""
    t = d.select("doc_id", at, *[F.col(row)[k].alias(k) for k in keys], F.explode(F.array_distinct(F.array(F.col(row)["packed"], F.col(row)["k"]["packed"], F.col(row)["k"]["bare"]))).alias("t"))
    t = t.withColumn("i", F.explode(F.sequence(F.lit(0), F.length("t"))))
    i, whole = F.col("i"), F.col("i") == 0
    x = F.when(whole, F.col("t")).otherwise(F.concat(F.substring("t", F.lit(1), i - 1), F.substring("t", i + 1, F.length("t"))))
    return t.select(F.xxhash64("doc_id", *keys, x).alias("h"), "i", F.when(whole, "").otherwise(F.substring("t", i, F.lit(1))).alias("c"), "doc_id", at)


def _named(g: DataFrame, e: DataFrame, keys=()) -> DataFrame:
    """doc_id, g, e: pairs of a document's rows whose names (and keys) agree. Names one edit apart are joined on a form that they share: one is the other without
    a character, or both lack a different one at the same place. So no pair of all rows is made, an equal pair is made once, and what is
    shuffled has hashes, not rows; the names are compared afterwards."""
    a, b = _spread(g, "g", "a", keys), _spread(e, "e", "b", keys).drop("doc_id").withColumnsRenamed({"i": "j", "c": "other"})
    c = F.col
    pairs = a.join(b, "h").where((c("i") == 0) | (c("j") == 0) | ((c("i") == c("j")) & (c("c") != c("other")))).select("doc_id", "g", "e").distinct()
    pairs = _agreeing(pairs.join(g, ["doc_id", "g"]).join(e, ["doc_id", "e"])).where("fuzzy")
    return (pairs.where("kind AND count") if keys else pairs).select("doc_id", "g", "e")


def _first_fit(doc: object, columns: list[list]) -> list[tuple]:
    """Each truth row in order takes the first free row of its candidates."""
    used_g, used_e, out = set(), set(), []
    for g, e in zip(*columns):
        if g not in used_g and e not in used_e:
            used_g.add(g)
            used_e.add(e)
            out.append((doc, g, e))
    return out


def _taken(pairs: DataFrame) -> DataFrame:
    return by_key(pairs, ["g", "e"], _first_fit, pairs.schema)


def _in_turn(g: DataFrame, e: DataFrame, keys) -> DataFrame:
    """doc_id, g, e: the n-th row of a document and keys meets the n-th on the other side: the first fit by equality, without pairs of all."""

    def place(d, at, row):
        d = d.select("doc_id", at, *[F.col(row)[k].alias(k) for k in keys])
        return d.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", *keys).orderBy(at)))

    return place(g, "g", "a").join(place(e, "e", "b"), ["doc_id", *keys, "place"]).select("doc_id", "g", "e")


def cascade(truth: DataFrame, rows: DataFrame, by_name: bool = True) -> DataFrame:
    """doc_id, g, e, pass_no and what agrees: exact, then fuzzy name, then count alone, then (by_name) name alone.

    Only rows that the passes before left free come into the next one; of the second pass, only those with a type and count that the other side has.
    """
    g, e = written(_rows(truth, "g", "a")), written(_rows(rows, "e", "b"))  # names are normalised once
    kind = ["share_type", "share_count"]
    number = lambda d, n: d.withColumn("pass_no", F.lit(n))
    free = lambda d, at, used: d.join(used.select("doc_id", at), ["doc_id", at], "left_anti")
    used = written(number(_in_turn(g, e, ["packed", *kind]), 1))
    g2, e2 = free(g, "g", used), free(e, "e", used)
    known = lambda d, row: d.select("doc_id", *[F.col(row)[k].alias(k) for k in kind]).distinct()
    both = known(g2, "a").join(known(e2, "b"), ["doc_id", *kind])
    there = lambda d, row: d.join(both, (d["doc_id"] == both["doc_id"]) & (d[row]["share_type"] == both["share_type"]) & (d[row]["share_count"] == both["share_count"]), "left_semi")
    used = written(used.unionByName(number(_taken(_named(there(g2, "a"), there(e2, "b"), kind)), 2)))
    used = written(used.unionByName(number(_in_turn(free(g, "g", used), free(e, "e", used), ["share_count"]), 3)))
    if by_name:
        used = used.unionByName(number(_taken(_named(free(g, "g", used), free(e, "e", used))), 4))
    return _agreeing(used.join(g, ["doc_id", "g"]).join(e, ["doc_id", "e"]))


def errors(truth: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, g, e, error: one pair can have two; documents that pass have none."""
    m = cascade(truth, rows)
    name = F.when(~F.col("fuzzy"), F.when(F.col("inner"), "name_truncation").otherwise("name_corruption"))
    kind = F.when(~F.col("kind"), "share_type_mismatch")
    found = F.when(F.col("pass_no") == 3, F.array(name, kind)).when(F.col("pass_no") == 4, F.array(F.lit("share_count_mismatch"), kind)).otherwise(F.array().cast("array<string>"))
    pairs = m.select("doc_id", "g", "e", F.explode(F.array_compact(found)).alias("error"))
    long = lambda d, c: d.select("doc_id", F.col("ord").cast("long").alias(c))
    lost = long(truth, "g").join(m.select("doc_id", "g"), ["doc_id", "g"], "left_anti").select("doc_id", "g", F.lit(None).cast("long").alias("e"), F.lit("row_omission").alias("error"))
    made = long(rows, "e").join(m.select("doc_id", "e"), ["doc_id", "e"], "left_anti").select("doc_id", F.lit(None).cast("long").alias("g"), "e", F.lit("row_hallucination").alias("error"))
    good = passed(truth, rows).where("passed").select("doc_id")
    return pairs.unionByName(lost).unionByName(made).join(good, "doc_id", "left_anti")


def discrepancies(truth: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, g, e, kind: name_diff, type_diff, missing, extra."""
    m = cascade(truth, rows, by_name=False)
    pairs = m.where("pass_no = 3").select("doc_id", "g", "e", F.explode(F.array_compact(F.array(F.when(~F.col("fuzzy"), "name_diff"), F.when(~F.col("kind"), "type_diff")))).alias("diff"))
    long = lambda d, c: d.select("doc_id", F.col("ord").cast("long").alias(c))
    lost = long(truth, "g").join(m.select("doc_id", "g"), ["doc_id", "g"], "left_anti").select("doc_id", "g", F.lit(None).cast("long").alias("e"), F.lit("missing").alias("diff"))
    made = long(rows, "e").join(m.select("doc_id", "e"), ["doc_id", "e"], "left_anti").select("doc_id", F.lit(None).cast("long").alias("g"), "e", F.lit("extra").alias("diff"))
    return pairs.unionByName(lost).unionByName(made)


def error_profile(truth: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, one column an error type, total, paren (corrupted names with a parenthesis the truth lacks), uniform (ratios)."""
    e = errors(truth, rows)
    t = truth.select("doc_id", F.col("ord").cast("long").alias("g"), F.col("name").alias("gn"), F.col("share_count").alias("gc"))
    x = rows.select("doc_id", F.col("ord").cast("long").alias("e"), F.col("name").alias("en"), F.col("share_count").alias("ec"))
    e = e.join(t, ["doc_id", "g"], "left").join(x, ["doc_id", "e"], "left")
    ratio = F.when((F.col("error") == "share_count_mismatch") & (F.col("gc") > 0), F.col("ec") / F.col("gc"))
    first = F.first(ratio, True).over(Window.partitionBy("doc_id").orderBy(F.col("g").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    e = e.withColumn("near", F.abs(ratio - first) < 0.01)
    paren = (F.col("error") == "name_corruption") & F.contains("en", F.lit("(")) & ~F.contains("gn", F.lit("("))
    return e.groupBy("doc_id").agg(*[F.count_if(F.col("error") == f).alias(f) for f in FAILURES], F.count("*").alias("total"), F.count_if(paren).alias("paren"), F.coalesce(F.bool_and("near"), F.lit(False)).alias("uniform"))


def root_causes(profile: DataFrame) -> DataFrame:
    """profile with cause and bucket (the first that fits, `hard` for the rest)."""
    c = F.col
    cause = (
        F.when((c("share_count_mismatch") >= 3) & c("uniform"), "amount column read as counts")
        .when(c("share_count_mismatch") >= 3, "count column misread")
        .when(c("row_hallucination") >= 3, "other rows read as holders")
        .when((c("name_corruption") > 0) & (c("paren") >= c("name_corruption") * 0.5), "organisation in parentheses")
        .when(c("name_corruption") >= 5, "table structure misread")
        .when(c("name_corruption") > 0, "name misread")
        .when(c("share_type_mismatch") > 0, "type column misread")
        .when(c("row_omission") > 0, "rows left out")
        .otherwise("several")
    )
    named = [
        ("parentheses", (c("paren") >= c("name_corruption") * 0.5) & (c("paren") >= 2)),
        ("counts", c("share_count_mismatch") >= 3),
        ("hallucinations", c("row_hallucination") >= 3),
        ("simple names", (c("total") <= 2) & (c("name_corruption") > 0)),
    ]
    buckets = F.array_compact(F.array(*[F.when(test, name) for name, test in named]))
    return profile.withColumns({"cause": cause, "buckets": F.when(F.size(buckets) == 0, F.array(F.lit("hard"))).otherwise(buckets)})


def unresolved(profile: DataFrame, scores: DataFrame) -> DataFrame:
    """doc_id of hopeless documents: nothing right, or ten errors and more with corrupted names."""
    return profile.join(scores, "doc_id").where((F.col("accuracy") == 0) | ((F.col("total") >= 10) & (F.col("name_corruption") > 0))).select("doc_id")


def summary(results: DataFrame) -> DataFrame:
    """One row: documents, passed, pass rate; errors and documents affected are in error_report()."""
    return results.agg(F.count("*").alias("documents"), F.count_if("passed").alias("passed"), F.avg(F.col("passed").cast("int")).alias("pass_rate"))


def error_report(found: DataFrame) -> DataFrame:
    """error, n, documents (distinct)."""
    return found.groupBy("error").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


def affected(found: DataFrame) -> DataFrame:
    """error, doc_id, n: a row for each document that an error is in, however many there are."""
    return found.groupBy("error", "doc_id").agg(F.count("*").alias("n"))


def optional_results(truth: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, n_truth, n, has_result: every document of the truth, with or without a result; a result without truth is left out."""
    count = lambda d, n: d.groupBy("doc_id").agg(F.count("*").alias(n))
    out = count(truth, "n_truth").join(count(rows, "n"), "doc_id", "left")
    return out.select("doc_id", "n_truth", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("has_result"))


def has_expected(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected rows (name, share_count) that a result has."""
    return expected.join(rows.select("name", "share_count"), ["name", "share_count"], "left_semi")
