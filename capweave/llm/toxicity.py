"""Toxicity by a chain of linear classifiers.

Each category (of a chain, in order) has a logistic model over the presence of words and, as further
features, the log odds that the models before it give. Later models are trained on out-of-fold
predictions of the earlier ones (FOLDS folds by a hash of doc_id), so they learn what those predictions are worth
on unseen rows. The last model's threshold maximises F1 on its own out-of-fold predictions.

The fit uses at most SAMPLE labelled ids, those with the smallest hash of doc_id, one text each (of several, the one with the smallest hash). Words are 64-bit hashes
(no folding into buckets); each category uses the WORDS with the greatest log-odds z-score among those in
MIN_DF sample rows or more. The driver gets these words and the sample's hits on them, nothing else; the model
is some thousand numbers, and scoring is one pass over all texts.

Nulls: a null or empty text has no words and gets the base rate. Labels that are null are left out; of
repeated labels of a doc_id, the greatest holds. Without both classes in the sample a category has no model
and its probability is the class share (0 without labels). Scores depend on the text alone, so
repeated rows agree. An empty table gives an empty result. Only doc_id and text of the documents are read; other columns, whatever
their names, pass through clean() unchanged, and classify() adds columns with a prefix of the caller's choice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_batches, table, written
from .words import U, Words, mix, plain, row_groups

SAMPLE, WORDS, MIN_DF, FOLDS, RIDGE, LEAST_Z = 20_000, 1_500, 4, 5, 0.3, 2.0
#: The chain over the label table: poor quality first, then toxic.
CHAIN = (("low_quality", "1 - quality"), ("toxic", "toxic"))
_SEED = 71


def word_sets(column: pa.Array):
    """(first row, end row, row of each word within, hash) for runs of rows; words repeat."""
    for at, end, raw, offs in row_groups(column):
        words = Words(raw, offs, lower=True, word=plain())
        yield at, end, np.repeat(np.arange(end - at), np.diff(words.first)), words.hash


def _sample_words(batches):
    for b in batches:
        out = []
        for at, end, row, h in word_sets(b.column(1)):
            first = np.searchsorted(row, np.arange(end - at + 1))
            out += [np.unique(h[i:j]).astype(np.int64) for i, j in zip(first[:-1], first[1:])]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in out]))), pa.int32()), pa.array(np.concatenate([*out, np.zeros(0, np.int64)]), pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), lists, b.column(2)], ["doc_id", "words", "y"])


@dataclass
class Link:
    """One model of the chain: words and before (the weights of earlier models' log odds), or a share alone."""

    name: str
    share: float
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    before: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    fitted: bool = False

    def odds(self, row: np.ndarray, h: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        """Log odds of n rows; row, h: the distinct words of each row that any model knows."""
        if not self.fitted:
            return np.full(n, _logit(self.share))
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        hit = self.words[at] == h
        return self.bias + np.bincount(row[hit], self.weights[at[hit]], n) + earlier[:, : len(self.before)] @ self.before


@dataclass
class Chain:
    links: list[Link]
    threshold: float = 0.5

    def known(self) -> np.ndarray:
        return np.unique(np.concatenate([link.words for link in self.links]))

    def score(self, row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
        """Probabilities, a column a category."""
        odds = np.zeros((n, len(self.links)))
        for k, link in enumerate(self.links):
            odds[:, k] = np.clip(link.odds(row, h, n, odds[:, :k]), -12, 12)
        return 1 / (1 + np.exp(-odds))


def _logit(p: float) -> float:
    p = min(max(p, 1e-5), 1 - 1e-5)
    return float(np.log(p / (1 - p)))


def logistic(row, col, n, words, dense, y, ridge=RIDGE, steps=200):
    """(weights, dense weights, bias) of a ridge logistic model, by accelerated gradient steps. row, col: ones of a sparse matrix."""
    scale = np.concatenate((np.ones(words), 1 / np.maximum(dense.std(0), 1e-6) if dense.size else np.zeros(dense.shape[1]), [1.0]))
    z = dense * scale[words:-1]
    per_row = np.bincount(row, minlength=n).max(initial=0) + (z**2).sum(1).max(initial=0) + 1
    # A bound of the curvature: a power iteration would be tighter, this one is safe for word presence.
    v = np.ones(words + dense.shape[1] + 1)
    times = lambda w: np.bincount(row, w[col], n) + z @ w[words:-1] + w[-1]
    back = lambda r: np.concatenate((np.bincount(col, r[row], words), z.T @ r, [r.sum()]))
    for _ in range(20):
        v = back(times(v / np.linalg.norm(v)))
    step = 1 / (0.3 * min(np.linalg.norm(v), per_row * n) + ridge)
    w = np.zeros(len(v))
    w[-1] = _logit(y.mean())
    ahead, speed = w.copy(), 1.0
    keep = np.append(np.full(len(w) - 1, ridge), 0.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(ahead), -30, 30)))
        new = ahead - step * (back(p - y) + keep * ahead)
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead, w, speed = new + (speed - 1) / faster * (new - w), new, faster
    w = w * scale
    return w[:words], w[words:-1], float(w[-1])


def _fit_link(name, known, row, h, n, earlier, y, use):
    """A model from the rows in `use` (a mask)."""
    share = float(y[use].mean()) if use.any() else 0.0
    if not 0 < share < 1:
        return Link(name, share)
    at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
    hit = (known[at] == h) & use[row] if len(known) else np.zeros(len(h), bool)
    place = np.cumsum(use) - 1
    w, before, bias = logistic(place[row[hit]], at[hit], int(use.sum()), len(known), earlier[use], y[use])
    return Link(name, share, known, w, before, bias, bool(len(known)) or bool(earlier.shape[1]))


def fit_chain(names, known, doc_ids, row, h, y) -> Chain:
    """known: of each category, its sorted words. row, h: distinct words of the sample's rows. y: rows x categories, NaN unknown."""
    n = len(doc_ids)
    fold = (mix(doc_ids.astype(U) + U(_SEED)) % U(FOLDS)).astype(int)
    odds, links, threshold = np.zeros((n, len(names))), [], 0.5
    for k, name in enumerate(names):
        there = ~np.isnan(y[:, k])
        for f in range(FOLDS):
            part = _fit_link(name, known[k], row, h, n, odds[:, :k], np.nan_to_num(y[:, k]), there & (fold != f))
            odds[fold == f, k] = np.clip(part.odds(row, h, n, odds[:, :k]), -12, 12)[fold == f]
        links.append(_fit_link(name, known[k], row, h, n, odds[:, :k], np.nan_to_num(y[:, k]), there))
        if k == len(names) - 1 and links[-1].fitted:
            p, truth = 1 / (1 + np.exp(-odds[there, k])), y[there, k] > 0
            cuts = np.linspace(0.1, 0.9, 81)
            score = [2 * (truth & (p >= c)).sum() / max(1, truth.sum() + (p >= c).sum()) for c in cuts]
            threshold = float(np.median(cuts[np.array(score) >= max(score) - 1e-9]))
    return Chain(links, threshold)


def train(docs: DataFrame, labels: DataFrame, chain=CHAIN, sample: int = SAMPLE) -> Chain:
    names = [name for name, _ in chain]
    y = F.array(*[F.max(F.expr(value).cast("double")) for _, value in chain])
    chosen = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(y.alias("y")).orderBy(F.xxhash64(F.lit(_SEED), "doc_id"), "doc_id").limit(sample)
    chosen = written(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # `sample` rows at most
    rows = by_batches(texts.select("doc_id", "text", "y"), _sample_words, "doc_id long, words array<bigint>, y array<double>")
    # One row an id, however often the documents repeat it.
    rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("words", "y"), F.xxhash64("words")).alias("r"))
    rows = written(rows.select("doc_id", "r.words", "r.y"))
    n_pos = rows.select(*[F.count_if(F.col("y")[k] > 0).alias(f"p{k}") for k in range(len(chain))], *[F.count_if(F.col("y")[k] <= 0).alias(f"n{k}") for k in range(len(chain))]).first()
    counts = rows.select(F.explode("words").alias("word"), "y").groupBy("word")
    counts = counts.agg(*[F.count_if(F.col("y")[k] > 0).alias(f"p{k}") for k in range(len(chain))], *[F.count_if(F.col("y")[k] <= 0).alias(f"n{k}") for k in range(len(chain))])
    counts, known = written(counts.where(f"p0 + n0 >= {MIN_DF}")), []
    for k in range(len(chain)):
        p, n, all_p, all_n = F.col(f"p{k}"), F.col(f"n{k}"), n_pos[f"p{k}"], n_pos[f"n{k}"]
        z = (F.log((p + 0.5) / (all_p - p + 0.5)) - F.log((n + 0.5) / (all_n - n + 0.5))) / F.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
        best = counts.where(F.abs(z) >= LEAST_Z).orderBy(F.abs(z).desc(), "word").limit(WORDS).collect()
        known.append(np.unique(np.array([r["word"] for r in best], np.int64).astype(U)))
    wanted = docs.sparkSession.createDataFrame([(int(w),) for w in np.unique(np.concatenate(known)).astype(np.int64)], "word long")
    # At most len(chain) * WORDS words, and at most `sample` rows with these words alone.
    hits = rows.select("doc_id", F.explode("words").alias("word")).join(F.broadcast(wanted), "word").groupBy("doc_id").agg(F.collect_list("word").alias("words"))
    hits = rows.select("doc_id", "y").join(hits, "doc_id", "left").select("doc_id", F.coalesce("words", F.array().cast("array<bigint>")).alias("words"), "y").toArrow()
    ids, ys = hits["doc_id"].to_numpy(), np.array([[np.nan if v is None else v for v in x] for x in hits["y"].to_pylist()], float).reshape(-1, len(chain))
    lists = hits["words"].combine_chunks() if hits.num_rows else pa.array([], pa.list_(pa.int64()))
    row = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
    h = np.asarray(pc.list_flatten(lists)).astype(np.int64).astype(U)
    return fit_chain(names, known, ids, row, h, ys)


def _scorer(model: Chain, text: int, names: list[str]):
    """Batches of rows (one struct column, whose field `text` is scored): the probabilities and the verdict are added."""

    def run(batches):
        known = model.known()
        for b in batches:
            p = np.zeros((b.num_rows, len(model.links)))
            for at, end, row, h in word_sets(b.column(0).field(text)):
                if len(known):
                    hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                    pair = np.unique(np.stack((row[hit].astype(U), h[hit])), axis=1)
                    row, h = pair[0].astype(np.int64), pair[1]
                else:
                    row, h = row[:0], h[:0]
                p[at:end] = model.score(row, h, end - at)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(p[:, k]) for k in range(p.shape[1])], pa.array(p[:, -1] >= model.threshold)], names)

    return run


def _scored(docs: DataFrame, model: Chain) -> DataFrame:
    """row (all columns of docs), p0, p1..., rejected."""
    rows = docs.select(F.struct("*").alias("row"))
    found = [T.StructField(f"p{k}", T.DoubleType()) for k in range(len(model.links))] + [T.StructField("rejected", T.BooleanType())]
    schema = T.StructType([*rows.schema.fields, *found])
    return by_batches(rows, _scorer(model, docs.columns.index("text"), schema.names), schema)


def classify(docs: DataFrame, model: Chain, prefix: str = "") -> DataFrame:
    """docs with <prefix>p_<category>... and <prefix>rejected."""
    out = _scored(docs, model)
    return out.select("row.*", *[F.col(f"p{k}").alias(f"{prefix}p_{x.name}") for k, x in enumerate(model.links)], F.col("rejected").alias(f"{prefix}rejected"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that a chain trained on labels doesn't reject."""
    return _scored(docs, train(docs, labels)).where("NOT rejected").select("row.*")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "p_low_quality", "p_toxic", F.col("rejected").alias("toxic"))
