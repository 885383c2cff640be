"""N-gram Jaccard join by signature trees.

A document's set are the distinct K-word shingles of its whole lower-cased text (SPACE_WORD words); with
fewer words, the whole sequence. Rows with equal sets form a class, and classes are joined; two link when
100 * intersection >= 75 * union. Sets are 64-bit shingle hashes.

1. Lossless candidates. Of a class with n shingles, linked classes share at least L = 3n//32 + 1 of the
   n//4 + n//8 + 1 smallest hashes of each (prefix principle with a margin). Only these are counted by
   shingle. Shingles that no second class has drop out; of the m others a class needs L, and one of its
   m - L + 1 rarest is shared with each partner. So frequent lines and passages, the most frequent
   shingles of a document, propose nothing unless the document consists of them. Texts are hashed once for that; Spark
   sorts the entries by shingle and Python sees them as a stream, so a shingle of very many classes is never held as a whole.
2. Classes that share such a shingle, with sizes within the ratio, form candidate groups (components).
   A group is a task; one of over BUDGET shingles (a class counts as LEAST at least) becomes a grid of pairs of chunks, sorted by size.
3. In a group, a signature tree: leaves of LEAF classes sorted by their smallest hashes, nodes with
   OR-combined bitmaps, size ranges and the most shingles hidden by bit collisions. The tree is traversed
   against itself; pairs of nodes whose greatest possible overlap is too small are pruned, also those
   whose classes are all in one component already. Classes that remain are intersected exactly.

Nulls: a null or empty text has an empty set and no links. A null doc_id takes part; component_id is the
smallest doc_id that isn't null, else null. Repeated rows are in one class. Only doc_id and text are read.
near_duplicates() keeps one row of each component: the smallest doc_id (nulls last), of its texts the one with the smallest hash, of
rows equal in both the one with the smallest hash of all its columns. Rows without words all stay. Other columns, whatever their
names, pass through unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, by_batches, dropped, fitted, table, written
from .components import Forest, components
from .words import U, Words, mix, row_groups, windows

K = 5
LEAF, FAN = 16, 8
#: Shingles of a task (8 bytes each), and what a class counts for at least: 4096 classes at most.
BUDGET, LEAST = 1 << 22, 1 << 10
#: A shingle of more classes than this counts as one of very many; they rank behind all others.
VERY_MANY = 100_000


def shingle_sets(column: pa.Array, k: int = K):
    """(row, sorted distinct hashes) of every row of a text column."""
    for at, end, raw, offs in row_groups(column):
        words = Words(raw, offs, lower=True)
        h, first = words.hash, words.first
        s = windows(h, k)
        for r in range(end - at):
            a, b = first[r], first[r + 1]
            if b - a >= k:
                yield at + r, np.unique(s[a : b - k + 1])
            else:
                yield at + r, windows(h[a:b], int(b - a)) if b > a else np.zeros(0, U)


def _class_id(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def _classes(batches):
    for b in batches:
        n, cls, seen = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), set()
        prefix = [np.zeros(0, np.int64)] * b.num_rows
        for r, s in shingle_sets(b.column(2)):
            n[r], cls[r] = len(s), _class_id(s)
            if len(s) and cls[r] not in seen:  # once a batch
                seen.add(cls[r])
                prefix[r] = s[: len(s) // 4 + len(s) // 8 + 1].astype(np.int64)
        edges = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([*prefix, np.zeros(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(cls), lists], ["doc_id", "key", "n", "cls", "prefix"])


def document_classes(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), n (size of the set), cls (hash of the set), prefix (its smallest shingles, at some row of each class) by row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    return by_batches(rows, _classes, "doc_id long, key long, n long, cls long, prefix array<long>")


class _Open:
    """The last shingle of a stream, which may go on: its entries are held until they are very many."""

    def __init__(self, tok):
        self.tok, self.held, self.count, self.many = tok, [], 0, False

    def add(self, *entries):
        self.held.append(entries)
        self.count += len(entries[0])
        self.many = self.many or self.count >= VERY_MANY
        if self.many:
            yield from self.flush()

    def flush(self):
        if self.held and self.count > 1:
            t, c, n = (np.concatenate(x) for x in zip(*self.held))
            yield _entries(t, c, n, np.full(len(t), VERY_MANY if self.many else self.count))
        self.held = []


def _entries(*columns):
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["tok", "cls", "n", "df"])


def _shared(batches):
    """Rows (tok, cls, n) sorted by tok and cls; of them, once each, those whose shingle a second class has, with df, the number of its classes."""
    now, last = None, None
    for b in batches:
        t, c, n = (np.asarray(b.column(i)).astype(np.int64) for i in range(3))
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
        if len(t):
            new[0], last = last != (t[0], c[0]), (t[-1], c[-1])
        t, c, n = t[new], c[new], n[new]
        if not len(t):
            continue
        edges = np.concatenate(([0], np.flatnonzero(t[1:] != t[:-1]) + 1, [len(t)]))
        if now is None or now.tok != t[0]:
            if now:
                yield from now.flush()
            now = _Open(t[0])
        first, end = edges[1], edges[-2]
        yield from now.add(t[:first], c[:first], n[:first])
        if end:  # there are other shingles behind the first
            yield from now.flush()
            df = np.repeat(np.diff(edges), np.diff(edges))
            keep = first + np.flatnonzero(df[first:end] > 1)
            yield _entries(t[keep], c[keep], n[keep], df[keep])
            now = _Open(t[end])
            yield from now.add(t[end:], c[end:], n[end:])
    if now:
        yield from now.flush()


def candidate_groups(classes: DataFrame) -> DataFrame:
    """cls, n, grp, k (classes of the group) of every class that has candidates. classes: as document_classes() makes them."""
    entries = classes.where("n > 0").select(F.explode("prefix").alias("tok"), "cls", "n")
    shared = entries.repartition("tok").sortWithinPartitions("tok", "cls").mapInArrow(_shared, "tok long, cls long, n long, df long")
    by_class = Window.partitionBy("cls")
    need = F.floor(F.col("n") * 3 / 32) + 1
    rare = shared.withColumn("m", F.count("*").over(by_class)).where(F.col("m") >= need)
    rare = rare.withColumn("at", F.row_number().over(by_class.orderBy("df", "tok"))).where(F.col("at") <= F.col("m") - need + 1)
    # Of a shingle, classes whose sizes are within the ratio of a neighbour's hang together.
    by_tok = Window.partitionBy("tok").orderBy("n", "cls")
    runs = rare.select("tok", "cls", "n").withColumn("gap", (F.col("n") * 3 > F.lag("n", 1, 1 << 40).over(by_tok) * 4).cast("int"))
    runs = runs.withColumn("run", F.sum("gap").over(by_tok))
    pairs = runs.withColumn("low", F.min("cls").over(Window.partitionBy("tok", "run"))).select("cls", "low", "n")
    pairs = written(pairs.where("cls <> low").unionByName(pairs.where("cls = low")).distinct())
    roots = components(pairs.select("cls", "low").where("cls <> low"))
    linked = pairs.select("cls", "n").distinct().join(roots.withColumnRenamed("v", "cls"), "cls", "left")
    linked = linked.select("cls", "n", F.coalesce("root", "cls").alias("grp"))
    sizes = linked.groupBy("grp").agg(F.count("*").alias("k"), F.sum(F.greatest("n", F.lit(LEAST))).alias("weight")).where("k > 1")
    return linked.join(sizes, "grp").select("cls", "n", "grp", "k", "weight")


def _grid(groups: DataFrame) -> DataFrame:
    """cls, grp, a, b: a class of a large group goes to every pair of chunks that may hold a partner."""
    small = groups.where(F.col("weight") <= BUDGET).select("cls", "grp", F.lit(0).alias("a"), F.lit(0).alias("b"))
    large, own = groups.where(F.col("weight") > BUDGET), F.greatest("n", F.lit(LEAST))
    before = F.sum(own).over(Window.partitionBy("grp").orderBy("n", "cls")) - own
    at = large.withColumn("chunk", F.floor(before / (BUDGET // 2)).cast("int"))
    span = at.groupBy("grp", "chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    p, q = (span.select("grp", *[F.col(c).alias(f"{c}_{x}") for c in ("chunk", "lo", "hi")]) for x in "ab")
    pairs = p.join(q, "grp").where("chunk_a <= chunk_b AND lo_b * 3 <= hi_a * 4").select("grp", F.col("chunk_a").alias("a"), F.col("chunk_b").alias("b"))
    tasks = pairs.withColumn("chunk", F.explode(F.array_distinct(F.array("a", "b"))))
    return small.unionByName(at.join(tasks, ["grp", "chunk"]).select("cls", "grp", "a", "b"))


class Tree:
    """A signature tree over the sets of a group."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.forest = sets, Forest()
        size = np.array([len(s) for s in sets])
        bits = 1 << max(9, min(16, int(4 * size.max()).bit_length()))
        maps = np.zeros((len(sets), bits // 8), np.uint8)
        for r, s in enumerate(sets):
            spots = np.unique(mix(s) & U(bits - 1)).astype(np.int64)
            np.bitwise_or.at(maps[r], spots >> 3, (1 << (spots & 7)).astype(np.uint8))
        maps = maps.view(np.uint64)
        hidden = size - np.bitwise_count(maps).sum(1)
        # A level: bitmaps, least and greatest size, most hidden shingles, and (first, end) below.
        self.levels = [(maps, size, size, hidden, None)]
        while len(self.levels) < 2 or len(self.levels[-1][0]) > 1:
            m, lo, hi, hid, _ = self.levels[-1]
            cut = np.arange(0, len(m), LEAF if len(self.levels) == 1 else FAN)
            ends = np.append(cut[1:], len(m))
            self.levels.append((np.bitwise_or.reduceat(m, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(hid, cut), np.stack((cut, ends), 1)))
        self.one: dict[tuple[int, int], int] = {}

    def _root(self, level: int, node: int) -> int | None:
        """The component that holds all classes below, if one does; that stays so."""
        if level == 0:
            return self.forest.find(node)
        known = self.one.get((level, node))
        if known is None:
            a, b = self.levels[level][4][node]
            known = self._root(level - 1, a)
            for x in range(a + 1, b):
                if known is None or self._root(level - 1, x) != known:
                    return None
            self.one[level, node] = known
        return self.forest.find(known)

    def join(self) -> None:
        """Traverses the tree against itself and unites the linked classes."""
        todo = [(len(self.levels) - 1, 0, 0)]
        while todo:
            level, x, y = todo.pop()
            root = self._root(level, x)
            if root is not None and root == self._root(level, y):
                continue
            m, lo, hi, hid, _ = self.levels[level]
            (a, b), (c, d) = self.levels[level][4][x], self.levels[level][4][y]
            m, lo, hi, hid, _ = self.levels[level - 1]
            most = np.bitwise_count(m[a:b, None] & m[None, c:d]).sum(2, dtype=np.int64) + np.minimum(hid[a:b, None], hid[None, c:d])
            fits = (7 * most >= 3 * (lo[a:b, None] + lo[None, c:d])) & (4 * hi[a:b, None] >= 3 * lo[None, c:d]) & (4 * hi[None, c:d] >= 3 * lo[a:b, None])
            i, j = np.nonzero(fits)
            i, j = i + a, j + c
            keep = i <= j if level > 1 else i < j
            pairs = list(zip(i[keep].tolist(), j[keep].tolist()))
            if level > 1:
                pairs.sort(key=lambda p: p[0] != p[1])  # a node against itself comes first
                todo += [(level - 1, i, j) for i, j in reversed(pairs)]
                continue
            for i, j in pairs:
                if self.forest.find(i) != self.forest.find(j) and self._linked(self.sets[i], self.sets[j]):
                    self.forest.join(i, j)

    @staticmethod
    def _linked(s: np.ndarray, t: np.ndarray) -> bool:
        both = np.concatenate((s, t))
        both.sort()
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        return 100 * common >= 75 * (len(both) - common)


def _join_group(key, group):
    rows = {c: s for c, s in zip(group["cls"].to_pylist(), group["s"].to_pylist())}  # repeated rows fall together
    rows = sorted(((np.frombuffer(s, U), c) for c, s in rows.items()), key=lambda x: (int(x[0][0]), len(x[0]), x[1]))
    tree = Tree([s for s, _ in rows])
    tree.join()
    found = [(rows[i][1], rows[r][1]) for i in range(len(rows)) if (r := tree.forest.find(i)) != i]
    return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["cls", "low"])


def _group_sets(batches):
    for b in batches:
        cls, keep, out = b.column(1).to_pylist(), [], []
        for r, s in shingle_sets(b.column(0)):
            if _class_id(s) == cls[r]:
                keep.append(r)
                out.append(s.tobytes())
        rest = b.select([1, 2]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([rest.column(0), rest.column(1), pa.array(out, pa.binary())], ["cls", "tasks", "s"])


TASKS = "array<struct<grp:bigint,a:int,b:int>>"


def class_components(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """cls, component_id, keep_key of every class with shingles: of its component, the smallest doc_id and the hash of the text to keep."""
    firsts = classes.where("n > 0").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))).alias("f"))
    firsts = written(firsts.select("cls", F.col("f.doc_id").alias("d"), F.col("f.key").alias("key")))
    groups = written(candidate_groups(classes))
    tasks = _grid(groups).groupBy("cls").agg(F.collect_list(F.struct("grp", "a", "b")).alias("tasks"))
    wanted = wanted_table = written(firsts.join(tasks, "cls"))
    # A class of a large group has many tasks, so they are counted, not the rows.
    if (wanted.agg(F.sum(F.size("tasks"))).first()[0] or 0) <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("key"))).select("text", "cls", "tasks")
    sets = by_batches(texts, _group_sets, f"cls long, tasks {TASKS}, s binary")
    sets = sets.select("cls", "s", F.inline("tasks"))
    edges = written(sets.groupBy("grp", "a", "b").applyInArrow(_join_group, "cls long, low long"))
    roots = components(edges).withColumnRenamed("v", "cls")
    for done in (groups, wanted_table, edges):
        dropped(done)
    comp = firsts.join(roots, "cls", "left").select("cls", "d", "key", F.coalesce("root", "cls").alias("root"))
    least = comp.groupBy("root").agg(F.min(F.struct(F.col("d").isNull(), F.col("d"), F.col("key"))).alias("f"))
    return comp.join(least, "root").select("cls", F.col("f.d").alias("component_id"), F.col("f.key").alias("keep_key"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, key (hash of the text), keep (the row is one that near_duplicates() may keep) by row of docs."""
    classes = written(document_classes(docs))
    comp = written(class_components(docs, classes))
    out = classes.select("doc_id", "key", "n", "cls").join(comp, "cls", "left")
    some = F.col("n") > 0
    keep = ~some | (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("keep_key")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "key", keep.alias("keep"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one of each component, and all without shingles."""
    found = written(jaccard_components(docs.select("doc_id", "text")))
    marks = found.where("n_shingles > 0").groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.bool_and("keep").alias("keep"), F.count("*").alias("n"))
    marks = fitted(written(marks.where("NOT keep OR n > 1")))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"))
    rows = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    # Rows that are there more than once: one of them, chosen before the shuffle.
    first = rows.where("keep").groupBy("doc_id", "key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return rows.where("keep IS NULL").select("row.*").unionAll(first.select("row.*"))


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
r AS (SELECT x AS doc_id, x AS dest FROM (SELECT DISTINCT x FROM e) UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.dest = e.x),
m AS (SELECT doc_id, min(dest) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
