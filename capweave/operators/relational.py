"""Operators on any table, by column names. Keys make the partitions; order columns make results repeatable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Cols = Sequence[str]


def upper_median(x: Column) -> Column:
    """An aggregate: of a small group's values, sorted, the one at index n // 2. Nulls don't count."""
    s = F.array_sort(F.collect_list(x))
    return F.try_element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))


def upper_medians(df: DataFrame, keys: Cols, value: str, name: str = "median") -> DataFrame:
    """keys and the upper median of each group, by a sort that can spill, for groups of any size."""
    w = Window.partitionBy(*keys)
    d = df.where(F.col(value).isNotNull()).select(*keys, value, F.count("*").over(w).alias("__n"), F.row_number().over(w.orderBy(value)).alias("__k"))
    return d.where(F.col("__k") == F.floor(F.col("__n") / 2) + 1).select(*keys, F.col(value).alias(name))


def dominant_value(df: DataFrame, keys: Cols, value: str, share: float, least: int = 2) -> DataFrame:
    """keys and the value that at least `share` of a group's rows have (the smallest of several), in groups of `least` rows or more."""
    v = df.groupBy(*keys, value).agg(F.count("*").alias("k")).withColumn("__n", F.sum("k").over(Window.partitionBy(*keys)))
    v = v.where((F.col("__n") >= least) & (F.col("k") >= F.col("__n") * share))
    return v.groupBy(*keys).agg(F.min(value).alias(value), F.max(F.col("__n")).alias("n"))


def unique_only(df: DataFrame, keys: Cols) -> DataFrame:
    """Rows whose keys no other row has."""
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where("__n = 1").drop("__n")


def first_of(df: DataFrame, keys: Cols, order: Sequence) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def typed_preferred(df: DataFrame, keys: Cols, kind: str, order: str) -> DataFrame:
    """Of each key all rows with a kind, or else the first; `place` is the first member's position, at which the group stands."""
    w = Window.partitionBy(*keys)
    typed = F.coalesce(F.col(kind) != "", F.lit(False))
    out = df.withColumns({"__any": F.bool_or(typed).over(w), "__k": F.row_number().over(w.orderBy(order)), "place": F.min(order).over(w)})
    return out.where((F.col("__any") & typed) | (~F.col("__any") & (F.col("__k") == 1))).drop("__any", "__k")


def leave_one_out(df: DataFrame, keys: Cols, value: str, tolerance: float, total: str | None = None, positive: bool = True) -> DataFrame:
    """Without rows whose value is about the sum of the group's others, or its known total, in groups of over two rows."""
    w = Window.partitionBy(*keys)
    v = F.coalesce(F.col(value), F.lit(0))
    df = df.withColumns({"__v": v, "__rest": F.sum(v).over(w) - v, "__n": F.count("*").over(w)})
    gone = (F.col("__rest") > 0) & (F.abs(F.col("__v") - F.col("__rest")) < F.col("__rest") * tolerance)
    if positive:
        gone = gone & (F.col("__v") > 0)
    if total:
        gone = gone | F.coalesce((F.col(total) != 0) & (F.col("__v") == F.col(total)), F.lit(False))
    return df.where(~((F.col("__n") > 2) & gone)).drop("__v", "__rest", "__n")


def outlier_filter(df: DataFrame, keys: Cols, value: str, share: float) -> DataFrame:
    """Rows with at least `share` of the group's greatest value."""
    return df.withColumn("__m", F.max(value).over(Window.partitionBy(*keys))).where(F.col(value) >= F.col("__m") * share).drop("__m")


def islands(df: DataFrame, keys: Cols, at: Column | str, gap, order: Cols, name: str = "island") -> DataFrame:
    """Numbers the groups (from 0) in which each value is at most `gap` from the one before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    at = F.col(at) if isinstance(at, str) else at
    gap = gap if isinstance(gap, Column) else F.lit(gap)
    return df.withColumn("__g", (at - F.lag(at).over(w) > gap).cast("int")).withColumn(name, F.coalesce(F.sum("__g").over(w), F.lit(0))).drop("__g")


def anchored_groups(values: Column, gap: Column) -> Column:
    """Of a sorted array, the group number (from 0) of each value: a new group when over `gap` from the group's first. The fold keeps the
    groups' first values only; a value's number is that of the last of them up to it."""
    start = F.struct(F.lit(None).cast("double").alias("first"), F.array().cast("array<double>").alias("firsts"))

    def step(a, v):
        new = a["first"].isNull() | (v - a["first"] > gap)
        return F.when(new, F.struct(v.alias("first"), F.array_append(a["firsts"], v).alias("firsts"))).otherwise(a)

    firsts = F.aggregate(values, start, step, lambda a: a["firsts"])
    # As the one member of an array, so that the fold runs once and not once a value.
    return F.transform(F.array(firsts), lambda own: F.transform(values, lambda v: F.size(F.filter(own, lambda f: f <= v)) - 1))[0]


def midpoint_bands(df: DataFrame, keys: Cols, at: str, alone) -> DataFrame:
    """lo, hi of each anchor: half-way to its neighbours; at the ends the one gap is mirrored, `alone` on both sides without any."""
    w = Window.partitionBy(*keys).orderBy(at)
    before, after = F.lag(at).over(w), F.lead(at).over(w)
    alone = alone if isinstance(alone, Column) else F.lit(alone)
    here = F.col(at)
    half_up, half_down = F.coalesce((after - here) / 2, alone), F.coalesce((here - before) / 2, alone)
    return df.withColumns({"lo": F.when(before.isNotNull(), (before + here) / 2).otherwise(F.greatest(F.lit(0.0), here - half_up)), "hi": F.when(after.isNotNull(), (here + after) / 2).otherwise(here + half_down)})


def in_band(points: DataFrame, bands: DataFrame, keys: Cols, at: str) -> DataFrame:
    """Points with the band (lo, hi] of their key that they are in; bands of a key don't overlap.

    One sorted pass a key over points and bands together, so a key with many of both makes no pairs.
    """
    rest = [c for c in bands.columns if c not in keys]
    p = points.select("*", F.lit(None).cast(bands.select(F.struct(*rest)).schema[0].dataType).alias("__band"), F.lit(0).alias("__kind"), F.col(at).cast("double").alias("__at"))
    b = bands.select(*keys, F.struct(*rest).alias("__band"), F.lit(1).alias("__kind"), F.col("lo").cast("double").alias("__at"))
    w = Window.partitionBy(*keys).orderBy("__at", "__kind")  # at one place, points are before a band that begins there
    both = p.unionByName(b, allowMissingColumns=True).withColumn("__in", F.last_value("__band", True).over(w))
    both = both.where((F.col("__kind") == 0) & (F.col("__at") <= F.col("__in.hi")))
    return both.select(*points.columns, *[F.col(f"__in.{c}").alias(c) for c in rest])


def _around(df: DataFrame, others: DataFrame, keys: Cols, at: str, value: Column, tie: Column) -> DataFrame:
    """df with __before and __after: the (at, tie, value) of the nearest others on either side, found in one sorted pass a key."""
    o = others.where(F.col(at).isNotNull()).groupBy(*keys, F.col(at).alias("__at")).agg(F.min(F.struct(tie.alias("tie"), value.alias("value"))).alias("o"))
    o = o.select(*keys, "__at", F.struct(F.col("__at").alias("at"), "o.tie", "o.value").alias("__o"), F.lit(1).alias("__kind"))
    d = df.select("*", F.col(at).alias("__at"), F.lit(0).alias("__kind"))
    w = Window.partitionBy(*keys).orderBy("__at")
    both = d.unionByName(o, allowMissingColumns=True)
    both = both.withColumns({"__before": F.last_value("__o", True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)), "__after": F.first_value("__o", True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))})
    return both.where("__kind = 0").drop("__o", "__kind", "__at")


def near_any(df: DataFrame, others: DataFrame, keys: Cols, at: str, reach, how: str = "left_semi") -> DataFrame:
    """Rows with (left_semi) or without (left_anti) one of `others` (same key) within `reach`."""
    out = _around(df, others, keys, at, F.lit(0), F.lit(0))
    test = F.coalesce(F.col(at) - F.col("__before.at") <= reach, F.lit(False)) | F.coalesce(F.col("__after.at") - F.col(at) <= reach, F.lit(False))
    return out.where(test if how == "left_semi" else ~test).drop("__before", "__after")


def nearest(df: DataFrame, others: DataFrame, keys: Cols, at: str, tie: str, value: str, most=None) -> DataFrame:
    """df with nearest_<value> of the nearest of `others` in its key (ties: the smallest `tie`); rows without one (within `most`) drop out."""
    out = _around(df, others, keys, at, F.col(value), F.col(tie))
    side = lambda s, d: F.when(F.col(s).isNotNull(), F.struct(d.alias("d"), F.col(f"{s}.tie").alias("tie"), F.col(f"{s}.value").alias("value")))
    best = F.least(side("__before", F.col(at) - F.col("__before.at")), side("__after", F.col("__after.at") - F.col(at)))
    out = out.withColumn("__best", best).where("__best IS NOT NULL")
    if most is not None:
        out = out.where(F.col("__best.d") <= most)
    return out.withColumn(f"nearest_{value}", F.col("__best.value")).drop("__before", "__after", "__best")


def fallback_insert(base: DataFrame, extra: DataFrame, keys: Cols, unique: Cols, flag: str) -> DataFrame:
    """base and, flagged, the rows of extra that are the only ones with `unique` there and whose keys base lacks."""
    new = unique_only(extra, unique).join(base.select(*keys).distinct(), list(keys), "left_anti")
    return base.withColumn("flags", F.array().cast("array<string>")).unionByName(new.withColumn("flags", F.array(F.lit(flag))))


def override(df: DataFrame, dim: DataFrame, keys: Cols, value: str, flag: str) -> DataFrame:
    """Takes `value` from dim where its keys are unique there and the value is another; appends a flag."""
    d = unique_only(dim.where(F.coalesce(F.col(value) != "", F.lit(False))), keys).select(*keys, F.col(value).alias("__new"))
    out = df.join(d, list(keys), "left")
    other = F.coalesce(F.col("__new") != F.coalesce(F.col(value), F.lit("")), F.lit(False))
    return out.withColumns({"flags": F.when(other, F.array_append("flags", F.lit(flag))).otherwise(F.col("flags")), value: F.when(other, F.col("__new")).otherwise(F.col(value))}).drop("__new")


def ordinal_agreement(a: DataFrame, b: DataFrame, key: str, order: Cols, value: str) -> DataFrame:
    """By key: n_a, n_b and whether both lists have one length and agree place by place."""
    rank = lambda d, n: d.select(key, F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("__o"), F.col(value).alias(n))
    both = rank(a, "va").withColumn("a", F.lit(1)).join(rank(b, "vb").withColumn("b", F.lit(1)), [key, "__o"], "full")
    return both.groupBy(key).agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("va").eqNullSafe(F.col("vb"))).alias("agree"))


def sorted_agreement(a: DataFrame, b: DataFrame, keys: Cols, value: str, tolerance: float) -> DataFrame:
    """By keys: whether both sorted lists have one length and differ by under `tolerance` of b's value everywhere."""
    rank = lambda d, n: d.where(F.col(value).isNotNull()).select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy(value)).alias("__o"), F.col(value).alias(n))
    both = rank(a, "va").join(rank(b, "vb"), [*keys, "__o"], "full")
    near = F.coalesce(F.abs(F.col("va") - F.col("vb")) < tolerance * F.greatest(F.col("vb"), F.lit(1)), F.lit(False))
    return both.groupBy(*keys).agg(F.bool_and(near).alias("agree"))


def unique_match(a: DataFrame, b: DataFrame, keys: Cols) -> DataFrame:
    """Full outer join of the rows whose keys are unique on their side; `side` is both, left or right."""
    u, v = unique_only(a, keys).withColumn("__a", F.lit(1)), unique_only(b, keys).withColumn("__b", F.lit(1))
    side = F.when(F.col("__a").isNull(), "right").when(F.col("__b").isNull(), "left").otherwise("both")
    return u.join(v, list(keys), "full").withColumn("side", side).drop("__a", "__b")


def deficit_flags(df: DataFrame, known: str, total: str, n_known: str, n: str, share: float) -> DataFrame:
    """sum_deficit: a known, non-zero total that the sum falls short of; count_deficit: at least two known rows, fewer found."""
    return df.withColumns({"sum_deficit": F.coalesce((F.col(known) != 0) & (F.col(total) < F.col(known) * share), F.lit(False)), "count_deficit": F.coalesce((F.col(n_known) >= 2) & (F.col(n) < F.col(n_known)), F.lit(False))})


def carried(df: DataFrame, keys: Cols, order: Cols, marker: Column, name: str) -> DataFrame:
    """The last marker that isn't null, up to each row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.last_value(marker, True).over(w))


def zero_filled(counts: DataFrame, dim: DataFrame, key: str, n: str) -> DataFrame:
    """Every value of dim with its count, 0 where there is none."""
    return dim.join(counts, key, "left").withColumn(n, F.coalesce(n, F.lit(0)))


def overlap_with(df: DataFrame, seen: DataFrame, group: str, keys: Cols, name: str) -> DataFrame:
    """By group, the share of its rows whose keys are in `seen`."""
    hit = df.join(seen.select(*keys).distinct().withColumn("__s", F.lit(1)), list(keys), "left")
    return hit.groupBy(group).agg(F.avg(F.col("__s").isNotNull().cast("int")).alias(name))


def uniform_ratio(df: DataFrame, key: str, a: str, b: str, order: Cols, least: int, spread: float) -> DataFrame:
    """By key with `least` rows or more: whether all ratios b / a are within `spread` of the first's."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = df.withColumn("__r", F.try_divide(F.col(b), F.col(a))).where("__r IS NOT NULL")
    r = r.withColumns({"__f": F.first("__r").over(w), "__n": F.count("*").over(w)}).where(F.col("__n") >= least)
    return r.groupBy(key).agg(F.bool_and(F.abs(F.col("__r") - F.col("__f")) < spread).alias("uniform"), F.count("*").alias("n"))


def missing_from(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that b lacks."""
    return a.subtract(b)


def latest(df: DataFrame, keys: Cols, order: str) -> DataFrame:
    """The last row of each key, whatever came before."""
    return first_of(df, keys, [F.col(order).desc()])


def edited(df: DataFrame, at: str, place: int, **values) -> DataFrame:
    """The row at `place` with other values."""
    return df.withColumns({c: F.when(F.col(at) == place, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def removed(df: DataFrame, keys: Cols, at: str, place: int) -> DataFrame:
    """Without the row at `place`; the others close up."""
    out = df.where(F.col(at) != place)
    return out.withColumn(at, (F.row_number().over(Window.partitionBy(*keys).orderBy(at)) - 1).cast("int"))


def in_ranges(df: DataFrame, number: Column, spec: str) -> DataFrame:
    """Rows whose number is in a list such as 1,3,7-13."""
    test = F.lit(False)
    for part in filter(None, (p.strip() for p in spec.split(","))):
        lo, _, hi = part.partition("-")
        test = test | number.between(int(lo), int(hi or lo))
    return df.where(test)


def appended(df: DataFrame, keys: Cols, at: str, **values) -> DataFrame:
    """With a row behind the last of each key; columns without a value are null."""
    last = df.groupBy(*keys).agg((F.max(at) + 1).cast(df.schema[at].dataType).alias(at))
    return df.unionByName(last.withColumns({c: F.lit(v) for c, v in values.items()}), allowMissingColumns=True)


def joined(df: DataFrame, keys: Cols, order: Cols, value: str, separator: str = "; ") -> DataFrame:
    """keys, n and the values of a (small) group in order, as one text."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__value"))))
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), items.alias("__items"))
    return out.select(*keys, "n", F.array_join(F.transform("__items", lambda x: x["__value"]), separator).alias(value))
