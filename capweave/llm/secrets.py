"""Secret scans with an incremental blob ledger.

Every version of a path is content-addressed (SHA-256 of its text). The ledger holds which (blob, rule,
rule version) were scanned and what was found. scan() takes the distinct pairs that the ledger lacks and
reads one row of each such blob; updated() appends the result to a ledger in the shared folder, which later
increments read. Findings are joined back to every row, so copies and re-committed versions cost one look-up. A raised rule
version is scanned anew on all blobs.

Rules: `assign`, `access` and `hex` (the base), then `private_key`, `github_token` and `jwt`. Spans are
(rule, start, end) in code points, end exclusive; matches of a rule are leftmost and don't overlap.

Nulls: a null text is the empty blob and has no findings; null or repeated path keys are rows like any
other. An empty table gives an empty result and an empty ledger. Columns of the input named blob or found are replaced by
findings(); others, whatever their names, pass through.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stages import shared_dir
from .common import by_batches, dropped, fitted, table, written

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_KEYWORD = re.compile(r"(?ai:passw|secret|token|api_?key)")
#: Greedy runs of at least the wanted length are the runs that are long enough.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")
_GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")


def _assignments(text: str) -> Iterator[tuple[int, int]]:
    if _KEYWORD.search(text):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                yield m.span()


def _plain(pattern: re.Pattern) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text))


@dataclass(frozen=True)
class Rule:
    name: str
    version: int
    find: Callable[[str], Iterator[tuple[int, int]]]


BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", 1, _assignments),
    Rule("access", 1, _plain(_ACCESS)),
    Rule("hex", 1, _plain(_HEX)),
    Rule("private_key", 1, _plain(_KEY)),
    Rule("github_token", 1, _plain(_GITHUB)),
    Rule("jwt", 1, _plain(_JWT)),
)
SPANS = "array<struct<start:int,`end`:int>>"
#: The ledgers of op2 in the shared folder, one a run.
OP2_LEDGERS = "capweave-ledgers"
LEDGER = f"blob string, rule string, version int, spans {SPANS}"


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def blob_of(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _scanner(rules: tuple[Rule, ...]):
    known = {(r.name, r.version): r.find for r in rules}
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            out = []
            for blob, text, wanted in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                text = text.as_py() or ""
                for rule, version in ((w["rule"], w["version"]) for w in wanted):
                    out.append((blob, rule, version, [{"start": s, "end": e} for s, e in known[rule, version](text)]))
            kinds = (pa.string(), pa.string(), pa.int32(), spans)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["blob", "rule", "version", "spans"])

    return run


def scan(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The entries that ledger lacks: one for each unseen blob of docs (doc_id, text) and rule version."""
    docs = docs.select("doc_id", "text")
    firsts = docs.select("doc_id", blob_of(F.col("text")).alias("blob")).groupBy("blob").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id"))["doc_id"].alias("first_id"))
    wanted = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("seen"))
    todo = firsts.join(seen, "blob", "left").select("blob", "first_id", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<struct<rule:string,version:int>>"))).alias("wanted"))
    todo = written(todo.where(F.size("wanted") > 0))
    texts = docs.join(fitted(todo), F.col("doc_id").eqNullSafe(F.col("first_id")) & (blob_of(F.col("text")) == F.col("blob")))
    found = by_batches(texts.select("blob", "text", "wanted"), _scanner(rules), LEDGER)
    return found.dropDuplicates(["blob", "rule", "version"])  # a row that is there twice


def updated(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger at path in the shared folder, with what it lacked of docs appended; runs at the same time may append an entry twice, so it is read once."""
    spark = docs.sparkSession
    at = f"{shared_dir(spark)}/{path}"
    empty_ledger(spark).write.mode("ignore").parquet(at)
    ledger = lambda: spark.read.schema(LEDGER).parquet(at).dropDuplicates(["blob", "rule", "version"])
    new = written(scan(docs, ledger(), rules))
    new.write.mode("append").parquet(at)
    dropped(new)
    return ledger()


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of docs with blob and found: its spans of the current rule versions, by start, then rule."""
    rank = F.array(*[F.lit(r.name) for r in rules])
    current = F.array_contains(F.array(*[F.lit(f"{r.name}@{r.version}") for r in rules]), F.concat_ws("@", "rule", "version"))
    hits = ledger.where((F.size("spans") > 0) & current).select("blob", "rule", F.inline("spans"))
    hits = hits.groupBy(F.col("blob").alias("of")).agg(F.sort_array(F.collect_list(F.struct("start", F.array_position(rank, F.col("rule")).alias("kind"), "end", "rule"))).alias("found"))
    rest = docs.drop("blob", "found")
    rows = rest.select(F.struct("*").alias("row"), blob_of(F.col("text")).alias("blob"))
    return rows.join(fitted(hits), F.col("blob") == F.col("of"), "left").select("row.*", "blob", "found")


def _joined(found) -> F.Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Two increments into a new ledger, so that each run does the whole work: a first delivery of some documents, then all of them, of
    which only unseen blobs are scanned. A service would give updated() one path for good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{OP2_LEDGERS}/{uuid.uuid4().hex}"
    updated(docs.where(F.hash("doc_id") < 0), path)
    ledger = updated(docs, path)
    out = findings(docs, ledger).select("doc_id", "blob", F.coalesce("found", F.array().cast("array<struct<start:int,kind:bigint,`end`:int,rule:string>>")).alias("found"))
    base = F.filter("found", lambda s: s["kind"] <= len(BASE))
    of = lambda k: F.size(F.filter("found", lambda s: s["rule"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(of, BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), "blob")


#: The rules for DuckDB. A span's start follows from the lengths of what stands between the matches.
OP2_SQL = r"""
WITH r(kind, name, re) AS (VALUES
(1, 'assign', '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
(2, 'access', 'AKIA[A-Z0-9]+'), (3, 'hex', '[0-9a-f]+'), (4, 'private_key', '-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----'),
(5, 'github_token', 'gh[pousr]_[A-Za-z0-9]{36,}'), (6, 'jwt', 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}')),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT rid, kind, name, regexp_extract_all(t, re) AS hit, string_split_regex(t, re) AS gap FROM d, r WHERE regexp_matches(t, re)),
s AS (SELECT rid, kind, name, hit[i] AS h, coalesce(list_sum(list_transform(gap[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0) AS b FROM m, unnest(range(1, len(hit) + 1)) u(i)),
k AS (SELECT rid, kind, name, CAST(b AS BIGINT) AS b, CAST(b + length(h) AS BIGINT) AS e FROM s WHERE CASE kind WHEN 1 THEN length(regexp_extract(h, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6 WHEN 2 THEN length(h) >= 20 WHEN 3 THEN length(h) >= 24 ELSE true END),
g AS (SELECT rid, count(*) FILTER (kind = 1) AS a, count(*) FILTER (kind = 2) AS c, count(*) FILTER (kind = 3) AS x, string_agg(name || ':' || b || ':' || e, ',' ORDER BY b, kind) FILTER (kind <= 3) AS base, string_agg(name || ':' || b || ':' || e, ',' ORDER BY b, kind) AS spans FROM k GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(x, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob FROM d LEFT JOIN g USING (rid)
"""
