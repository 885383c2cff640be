"""Benchmark decontamination: a broadcast hash set of test n-grams against every training window.

Words are those of PLAIN_WORD in lower-cased (A-Z) text. A window is N consecutive words of an item;
an item of fewer words is one window. Every training window is named by a 64-bit hash of its length and four of its words
(first, last and two between) and tested against the set of the items' names. The few documents with a name in
the set are read again, and there the windows themselves, all words, are compared with the items' windows.

The names are broadcast only if a count proves them few (BROADCAST_ROWS); beyond that the join is shuffled, behind a bitmap of all names that has a
fixed size (FILTER_BITS, 32 MB) and is broadcast: windows whose bit isn't set, which are nearly all of clean text, are never shuffled. Training
text itself isn't shuffled: each row sends out its candidates and one marker with its length, which are gathered by row.

Nulls, ties, sizes: a null or empty text has no words and no hits; a very long text is one row of its task; an empty table gives no rows; an item with a null text has no window; an item
with a null id counts as hit words but is not named. Rows equal in doc_id and text are one row for the
search and come back as often as they are there. Other columns, whatever their names, pass through decontaminated() unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PLAIN_WORD, ascii_lower, fitted, table, written

N = 10
#: Windows of items with their words that may be broadcast (100 bytes each or so).
BROADCAST_WINDOWS = 200_000
#: Bits of the bitmap that stands before a shuffled join. With ten million names, one window in 27 of clean text passes it.
FILTER_BITS = 1 << 28


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(PLAIN_WORD), F.lit(0)), F.array().cast("array<string>"))


def _hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _names(hashes: Column, n: int) -> Column:
    """The names of all windows of n words, by place, given the words' hashes."""
    others = sorted({(n - 1) // 3, 2 * (n - 1) // 3, n - 1} - {0})
    windows = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - n + 1, F.lit(0))), lambda x, i: F.xxhash64(F.lit(n), x, *[hashes[i + k] for k in others]))
    return F.when(F.size(hashes) >= n, windows).otherwise(F.array().cast("array<bigint>"))


def _once(value: Column, use) -> Column:
    """use(value), with value computed once although use names it often."""
    return F.transform(F.array(value), use)[0]


def _window(words: Column, at: Column, n: Column) -> Column:
    """The words of a window; joined, as words hold no spaces."""
    return F.array_join(F.slice(words, at + 1, n), " ")


def item_windows(items: DataFrame, n: int = N) -> DataFrame:
    """n, name, window and the ids of the items that hold it."""
    every = lambda h: F.coalesce(*[F.when(F.size(h) == k, _names(h, k)) for k in range(1, n)], _names(h, n))
    w = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w"))
    w = w.select("item", "w", F.least(F.size("w"), F.lit(n)).alias("n"), F.posexplode(_once(F.transform("w", lambda x: F.xxhash64(x)), every)).alias("at", "name"))
    return w.select("item", "n", "name", _window(F.col("w"), F.col("at"), F.col("n")).alias("window")).groupBy("n", "name", "window").agg(F.collect_set("item").alias("items"))


def _bit(name: Column) -> Column:
    return F.pmod(name, F.lit(FILTER_BITS))


def _maybe_named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows (n, name) that are markers (n = 0), or whose name's bit is set: all that have a name in `names` (wanted), and few others."""
    place = _bit(F.col("wanted"))
    bits = names.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    own = rows.withColumn("of", F.bitmap_bucket_number(_bit(F.col("name")))).withColumn("bit", F.bitmap_bit_position(_bit(F.col("name"))))
    met = own.join(F.broadcast(bits), F.col("of") == F.col("bucket"), "left")  # FILTER_BITS / 8 bytes at most
    is_set = F.expr("(shiftright(CAST(conv(hex(substring(bits, CAST(bit div 8 AS INT) + 1, 1)), 16, 10) AS INT), CAST(bit % 8 AS INT)) & 1) = 1")
    return met.where((F.col("n") == 0) | F.coalesce(is_set, F.lit(False))).select(*rows.columns)


def _candidates(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), copies, n_words, places (at, n) by distinct row of docs; windows: written item_windows()."""
    sizes = [r["n"] for r in windows.select("n").distinct().collect()]  # at most N of them
    wanted = windows.select(F.col("name").alias("wanted")).distinct()
    names = fitted(wanted)
    # A row's first list has one null in the place of a name, and tells its number of words.
    lists = lambda h: F.array(
        F.struct(F.lit(0).alias("n"), F.size(h).alias("words"), F.array(F.lit(None).cast("bigint")).alias("names")),
        *[F.struct(F.lit(k).alias("n"), F.lit(0).alias("words"), _names(h, k).alias("names")) for k in sizes],
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.inline(_once(_hashes(F.col("text")), lists)))
    rows = rows.select("doc_id", "key", "n", "words", F.posexplode("names").alias("at", "name"))
    rows = _maybe_named(rows, wanted) if names is wanted else rows
    found = rows.join(names, F.col("name") == F.col("wanted"), "left").where("n = 0 OR wanted IS NOT NULL")
    return found.groupBy("doc_id", "key").agg(
        F.count_if(F.col("n") == 0).alias("copies"),
        F.max("words").cast("long").alias("n_words"),
        F.collect_set(F.when(F.col("n") > 0, F.struct("at", "n"))).alias("places"),
    )


def find_hits(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """doc_id, key (hash of the text), copies, n_words, n_hit, items (sorted ids) by distinct row of docs (doc_id, text)."""
    windows = written(item_windows(items, n))
    rows = written(_candidates(docs, windows))
    some = rows.where(F.size("places") > 0).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "places")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    texts = texts.join(fitted(some, 100_000), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).select("doc_id", "key", words_of(F.col("text")).alias("w"), "places")
    spots = F.transform("places", lambda p: F.struct(p["at"].alias("at"), p["n"].alias("n"), _window(F.col("w"), p["at"], p["n"]).alias("window")))
    spots = texts.select("doc_id", "key", F.inline(spots))
    hits = spots.join(fitted(windows.select(F.col("n").alias("m"), F.col("window").alias("text"), "items"), BROADCAST_WINDOWS), (F.col("window") == F.col("text")) & (F.col("n") == F.col("m")))
    by_row = hits.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    step = lambda a, s: F.struct(
        F.greatest(a["end"], s["at"] + s["n"]).alias("end"),
        (a["hit"] + F.greatest(F.lit(0), s["at"] + s["n"] - F.greatest(a["end"], s["at"]))).cast("long").alias("hit"),
    )
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit")), step, lambda a: a["hit"])
    by_row = by_row.select("d", "k", covered.alias("n_hit"), "items")
    out = rows.join(by_row, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    return out.select("doc_id", "key", "copies", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminated(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """The rows of docs in which no window of an item occurs."""
    bad = find_hits(docs.select("doc_id", "text"), items, n).where("n_hit > 0").select(F.col("doc_id").alias("d"), F.col("key").alias("k"))
    bad = written(bad)  # counted and joined: searched once
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("key"))
    return rows.join(fitted(bad), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left_anti").select("row.*")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    out = find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, sizes, unnest(range(1, greatest(len(w) - n + 2, 1))) t(i)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM h) x, unnest(range(i, i + n)) t(p) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""
