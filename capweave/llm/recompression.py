"""Removing repeated word windows by recompression.

A document is a string of SPACE_WORD words. ROUNDS times, every maximal run of a symbol gets a name made
from (symbol, length), then every pair of a left and a right symbol (a bit of the symbol's hash decides
which) gets a name made from both. Names are 64-bit hashes, so they are the same in every task and round
without a table of names. A symbol carries the words that decided about it, its context; wherever those
words stand, the same symbol comes out. Equal windows hence share all symbols whose context lies within.

Of each window of N words, the symbol of the highest level that has one within (a word, if none has) and
the smallest name is its anchor. Windows are dealt by anchor, neighbours with one anchor together. An anchor
that occurs once reveals that its windows are unique; the others are verified by two hashes of all N words, 64 bits each, made
from two hashes of each word that share nothing. Within some megabytes of rows all 128 bits decide, between tasks 64 and half of the others (96), whatever
the anchor: with W different windows, a false equality has odds of W * W / 2 ** 97: 4e-10 at 30 GB (8e9 windows), 0.4 % at 100 TB. Of equal windows, all but the first by (doc_id, start)
are marked, and every word that a marked window covers goes. Windows that repeat within some megabytes of rows are marked there
and only the first is dealt, so a passage in a third of all rows counts once for these.

Some anchors stand in a large share of all different windows (a common pair of words), and would fill one task. A first pass counts windows by anchor over all
rows; windows of a heavy anchor (HEAVY or more) are dealt by their own hash instead. Which anchors count as heavy moves windows between
tasks and changes no result: equal windows have equal anchors and hashes.

Names are hashes of what they name, so all tasks give the same names without asking each other; the Spark job has one exchange
(windows by anchor) instead of one a round, and a second one that brings the marks to the documents.

Nulls: a null text has no words. A null doc_id is after all others. doc_id names a document: rows that
share one are marked alike, position by position. Texts of fewer than N words keep all of them; a very long one is worked on
whole by its task. An empty table gives no rows. Only doc_id and text are read, so other columns may have any name. Marks go
to the texts by broadcast if their bytes, summed first, are few; else by a shuffled join.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, table, written
from .words import U, Words, mix, row_groups

N = 20
ROUNDS = 2
LAST_ID = (1 << 63) - 1
#: Marks of at most so many bytes and rows are broadcast.
BROADCAST_MARK_BYTES, BROADCAST_MARK_ROWS = 64 << 20, 500_000
#: Bytes of text for which there are eight buckets at least.
PART_BYTES = 32 << 20
#: Tasks that compare; each takes its buckets one by one.
MOST_TASKS = 40_000
#: An anchor with so many different windows is heavy; an anchor with fewer than a LOCAL in some megabytes of rows isn't counted there.
HEAVY, LOCAL = 2_000_000, 32
#: Heavy anchors that tasks are told of, the heaviest first; 8 bytes each.
MOST_HEAVY = 4_000_000
MARK = np.dtype([("doc", "<i8"), ("start", "<u4"), ("count", "<u4")])
#: tag: 16 bits of the anchor's name, by which unique ones are passed over.
SEGMENT = np.dtype([("doc", "<i8"), ("tag", "<u2"), ("start", "<u4"), ("count", "<u2")])
LONGEST = (1 << 16) - 1
#: What tells windows apart between tasks.
PRINT = np.dtype([("a", "<u8"), ("b", "<u4")])


def compress_runs(name, row, left, right, edges):
    """Names every maximal run. left and right: the context of each symbol, as positions of words."""
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(name)))
    out = np.where(length > 1, mix(name[at] * U(0xD6E8FEB86659FD93) + length.astype(U)), name[at])
    return out, row[at], *_contexts(at, at + length - 1, row, left, right, edges)


def compress_pairs(name, row, left, right, edges, turn: int):
    """Names every pair of a left symbol and a right symbol that follows it."""
    is_left = (mix(name + U(turn)) & U(1)).astype(bool)
    pair = np.zeros(len(name), bool)  # the symbol is the first of a pair
    pair[:-1] = is_left[:-1] & ~is_left[1:] & (row[1:] == row[:-1])
    keep = np.ones(len(name), bool)
    keep[1:] = ~pair[:-1]
    both = np.where(pair[:-1], mix(name[:-1] * U(0x9FB21C651E98DF25) + mix(name[1:])), name[:-1])
    out = np.append(both, name[-1:])[keep]
    at = np.flatnonzero(keep)
    return out, row[keep], *_contexts(at, at + pair[at], row, left, right, edges)


def _contexts(first, last, row, left, right, edges):
    """Contexts of symbols made from those at first..last: the symbols before and after decide too, with their own
    contexts; at a row's edge, the place before its first or after its last word."""
    before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(row) - 1)
    inner_left, inner_right = (first > 0) & (row[before] == row[first]), (last < len(row) - 1) & (row[after] == row[last])
    return np.where(inner_left, left[before], edges[row[first]] - 1), np.where(inner_right, right[after], edges[row[last] + 1] + 1)


def _least_within(name, left, right, starts):
    """Of the symbols whose context is in each window, the smallest name; False where there is none."""
    lo, hi = np.searchsorted(left, starts), np.searchsorted(right, starts + N, "right")
    size = np.maximum(hi - lo, 0)
    out = np.zeros(len(starts), U)
    table_, width = name, 1
    while True:
        fit = np.flatnonzero((size >= width) & (size < 2 * width))
        if len(fit):
            out[fit] = np.minimum(table_[lo[fit]], table_[hi[fit] - width])
        if not (size >= 2 * width).any():
            return out, size > 0
        table_ = np.minimum(table_[:-width], table_[width:])
        width *= 2


def anchors(words: np.ndarray, row: np.ndarray, edges: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The anchor's name of the windows at these starts. row: of every word, non-decreasing; edges: each row's first word, and the end."""
    at = np.arange(len(words))
    state, levels = (words, row, at, at + 1), []
    levels.append(state)
    for turn in range(1, ROUNDS + 1):
        state = compress_pairs(*compress_runs(*state, edges), edges, turn)
        levels.append(state)
    out, found = np.zeros(len(starts), U), np.zeros(len(starts), bool)
    for level in reversed(range(len(levels))):
        rest = np.flatnonzero(~found)
        if len(rest):
            name, _, left, right = levels[level]
            least, some = _least_within(name, left, right, starts[rest])
            out[rest[some]] = mix(least[some] + U(level))
            found[rest[some]] = True
    return out


def window_hashes(words: np.ndarray, starts: np.ndarray, n: int = N, base: U = U(0x9E3779B97F4A7C15)) -> np.ndarray:
    """A hash of the n words from each start: differences of a running polynomial in an odd base modulo 2**64."""
    power = np.cumprod(np.full(len(words) + 1, base))
    back = np.cumprod(np.full(len(words) + 1, U(pow(int(base), -1, 1 << 64))))
    total = np.concatenate((np.zeros(1, U), np.cumsum(words * power[: len(words)])))
    return mix((total[starts + n] - total[starts]) * back[starts])


def _runs(doc: np.ndarray, start: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of stretches of consecutive starts in one document, LONGEST at most."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(doc)))
    if len(at) and length.max() > LONGEST:
        pieces = -(-length // LONGEST)
        at = np.repeat(at, pieces) + LONGEST * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        length = np.diff(np.append(at, len(doc)))
    return at, length


def _marks(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    at, count = _runs(doc, start)
    out = np.zeros(len(at), MARK)
    out["doc"], out["start"], out["count"] = doc[at], start[at], count
    return out


def _later(key: np.ndarray, second: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each pair of keys by doc and start, those after the first) as indices."""
    order = np.argsort(key, kind="stable")
    k, k2 = key[order], second[order]
    if ((k[1:] == k[:-1]) & (k2[1:] != k2[:-1])).any():  # different windows with one key: the second tells them apart
        order = np.lexsort((second, key))
        k, k2 = key[order], second[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])
    at = np.flatnonzero(new)
    # The least (doc, start) of each key: the least doc, then the least start among its windows there.
    d, s = doc[order], start[order].astype(np.int64)
    group = np.cumsum(new) - 1
    least = np.minimum.reduceat(d, at) if len(at) else d
    here = d == least[group]
    s_here = np.where(here, s, np.int64(1 << 40))
    first = np.minimum.reduceat(s_here, at) if len(at) else s
    is_first = here & (s == first[group])
    one = np.flatnonzero(is_first)
    one = one[np.unique(group[one], return_index=True)[1]]
    return order[one], order[~is_first]


def _named(texts: pa.Array, twice: bool):
    """Of runs of rows with some megabytes: (first row, the windows' rows and places, words, anchors' names)."""
    for at, _, raw, offs in row_groups(texts):
        words = Words(raw, offs, lower=False, twice=twice)
        count = np.diff(words.first)
        row = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(row)) - words.first[:-1][row] if len(row) else np.zeros(0, np.int64)
        starts = np.flatnonzero(place + N <= count[row]) if len(row) else np.zeros(0, np.int64)
        if len(starts):
            yield at, row, place, starts, words, anchors(words.hash, row, words.first, starts)


def _counted(batches):
    """Anchors (as signed numbers) and how many windows have them, without the rare ones."""
    for b in batches:
        for *_, name in _named(b.column(0), False):
            names, n = np.unique(name, return_counts=True)
            many = n >= LOCAL
            yield pa.RecordBatch.from_arrays([pa.array(names[many].view(np.int64)), pa.array(n[many].astype(np.int64))], ["name", "n"])


def heavy_anchors(docs: DataFrame) -> np.ndarray:
    """The names of heavy anchors, sorted."""
    n = by_batches(docs.select("text"), _counted, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY)
    return np.sort(np.array([r["name"] for r in n.orderBy(F.desc("n"), "name").limit(MOST_HEAVY).collect()], np.int64).view(U))


def _deal(buckets: int, heavy: np.ndarray):
    def run(batches):
        for b in batches:
            for at, row, place, starts, words, name in _named(b.column(1), True):
                ids = np.asarray(b.column(0)[at : at + row[-1] + 1])
                whole, second = window_hashes(words.hash, starts), window_hashes(words.other, starts, base=U(0xC2B2AE3D27D4EB4F))
                doc, start = ids[row[starts]], place[starts]
                first, later = _later(whole, second, doc, start)
                marks = _marks(doc[later], start[later])
                name, whole, second, doc, start = name[first], whole[first], second[first], doc[first], start[first]
                near = np.minimum(np.searchsorted(heavy, name), max(len(heavy) - 1, 0))
                name = np.where(heavy[near] == name, mix(whole + U(1)), name) if len(heavy) else name
                bucket = (name % U(buckets)).astype(np.int32)
                order = np.lexsort((start, doc, bucket))
                name, whole, second, doc, start, bucket = name[order], whole[order], second[order], doc[order], start[order], bucket[order]
                seg, length = _runs(doc, start, name)
                out = np.zeros(len(seg), SEGMENT)
                out["doc"], out["tag"], out["start"], out["count"] = doc[seg], (mix(name[seg]) & U(0xFFFF)).astype(np.uint16), start[seg], length
                both = np.zeros(len(whole), PRINT)
                both["a"], both["b"] = whole, second >> U(32)
                seg_bucket = bucket[seg]
                cut = np.flatnonzero(np.diff(seg_bucket, prepend=-1, append=-1))
                ends = np.append(seg, len(doc))
                rows = [(int(seg_bucket[i]), out[i:j].tobytes(), both[ends[i] : ends[j]].tobytes(), b"") for i, j in zip(cut[:-1], cut[1:])]
                rows[0] = (*rows[0][:3], marks.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 3))], ["bucket", "segments", "hashes", "marks"])

    return run


def repeated(segments: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The marks of the windows of a bucket that aren't the first of their kind. hashes: a PRINT a window."""
    count = segments["count"].astype(np.int64)
    shown = np.bincount(segments["tag"], minlength=1 << 16)[segments["tag"]] > 1  # an anchor that occurs once has unique windows only
    hashes, segments, count = hashes[np.repeat(shown, count)], segments[shown], count[shown]
    before = np.concatenate(([0], np.cumsum(count)[:-1])) if len(count) else count
    start = np.repeat(segments["start"].astype(np.int64), count) + np.arange(len(hashes)) - np.repeat(before, count)
    doc = np.repeat(segments["doc"], count)
    _, later = _later(np.ascontiguousarray(hashes["a"]), np.ascontiguousarray(hashes["b"]), doc, start)
    return _marks(doc[later], start[later])


def _by_key(batches, done):
    """done(held rows without their key) for every key of rows sorted by the first column."""
    now, held = None, []
    for b in batches:
        for key, *rest in zip(*[c.to_pylist() for c in b.columns]):
            if key != now and held:
                yield from done(held)
                held = []
            now = key
            held.append(rest)
    if held:
        yield from done(held)


def _find(targets: int):
    def done(held):
        segments = np.frombuffer(b"".join(x[0] for x in held), SEGMENT)
        hashes = np.frombuffer(b"".join(x[1] for x in held), PRINT)
        marks = np.concatenate((repeated(segments, hashes), np.frombuffer(b"".join(x[2] for x in held), MARK)))
        if len(marks):
            target = (mix(marks["doc"].astype(U)) % U(targets)).astype(np.int32)
            order = np.argsort(target, kind="stable")
            marks, target = marks[order], target[order]
            cut = np.flatnonzero(np.diff(target, prepend=-1, append=-1))
            out = [(int(target[i]), marks[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.binary()))], ["target", "marks"])

    return lambda batches: _by_key(batches, done)


def _gather(batches):
    """From rows sorted by target, one row a document."""

    def done(held):
        marks = np.frombuffer(b"".join(x[0] for x in held), MARK)
        marks = marks[np.argsort(marks["doc"], kind="stable")]
        doc = marks["doc"]
        cut = np.concatenate(([0], np.flatnonzero(doc[1:] != doc[:-1]) + 1, [len(doc)]))
        out = [(int(doc[i]), marks[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.binary()))], ["doc", "marks"])

    return _by_key(batches, done)


def repeat_marks(docs: DataFrame) -> DataFrame:
    """doc (the id, LAST_ID for null), marks: packed (doc, start, count) of window starts, by document."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Buckets are counted from the bytes of the texts, so that their size stays, however large the input is.
    parts = max(parts, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), "text")
    dealt = by_batches(rows, _deal(8 * parts, heavy_anchors(docs)), "bucket int, segments binary, hashes binary, marks binary")
    found = dealt.repartition(min(4 * parts, MOST_TASKS), "bucket").sortWithinPartitions("bucket").mapInArrow(_find(2 * parts), "target int, marks binary")
    return found.repartition(min(parts, MOST_TASKS), "target").sortWithinPartitions("target").mapInArrow(_gather, "doc long, marks binary")


def _kept(text: bytes, marks: bytes | None) -> tuple[int, list[bytes]]:
    """Number of words; the words that stay."""
    words = text.split()  # of bytes: at ASCII white space only
    if not marks:
        return len(words), words
    m = np.frombuffer(marks, MARK)
    edge = np.zeros(len(words) + 1, np.int64)
    # Marks of a longer text with the same doc_id can reach beyond this one.
    np.add.at(edge, np.minimum(m["start"], len(words)), 1)
    np.add.at(edge, np.minimum(m["start"] + m["count"] + np.uint32(N - 1), len(words)), -1)
    return len(words), [w for w, c in zip(words, (np.cumsum(edge)[:-1] > 0).tolist()) if not c]


def _clean(batches):
    for b in batches:
        texts = b.column(1).cast(pa.large_string()).cast(pa.large_binary())
        n, kept, out = [], [], []
        for text, marks in zip(texts, b.column(2)):
            total, words = _kept(text.as_py() or b"", marks.as_py())
            n.append(total)
            kept.append(total - len(words))
            out.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(kept, pa.int64()), pc.cast(pa.array(out, pa.binary()), pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) by row of docs."""
    marks = written(repeat_marks(docs))
    held = marks.agg(F.count("*").alias("n"), F.sum(F.length("marks")).alias("b")).first()
    if held["n"] <= BROADCAST_MARK_ROWS and (held["b"] or 0) <= BROADCAST_MARK_BYTES:
        marks = F.broadcast(marks)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.join(marks, F.coalesce("doc_id", F.lit(LAST_ID)) == F.col("doc"), "left").select("doc_id", "text", "marks")
    return by_batches(rows, _clean, "doc_id long, n_words long, n_removed long, kept string")


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM w, unnest(range(1, greatest(len(w) - 18, 1))) t(i)),
l AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, p FROM l, unnest(range(i, i + 20)) t(p)),
k AS (SELECT w.doc_id, string_agg(w.w[t.p], ' ' ORDER BY t.p) AS kept, count(*) AS n FROM w, unnest(range(1, len(w) + 1)) t(p) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = w.doc_id AND c.p = t.p) GROUP BY w.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
