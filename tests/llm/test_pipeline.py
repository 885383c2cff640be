from collections import Counter

import pytest
from pyspark.sql import functions as F

from capweave.llm import queries
from helpers import DATA, duck, same_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, DATA).toArrow(), duck(queries.ORACLE_SQL[name]))


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, now = docs.columns, docs
    seen = {}
    for name, stage in p.STAGES[:-1]:
        now = p.written(stage(spark, now, DATA))
        assert now.columns == names
        seen[name] = Counter(r["doc_id"] for r in now.collect())
    ids = {r["doc_id"] for r in docs.collect()}
    assert set(seen["toxicity"]) <= ids and set(seen["ngram_jaccard"]) <= set(seen["toxicity"])
    assert max(seen["mixing"].values()) <= 3
    out = p.run(spark, DATA).collect()
    assert Counter(r["doc_id"] for r in out) == seen["mixing"]
    load = Counter(r["shard"] for r in out)
    assert max(load.values()) - min(load.get(s, 0) for s in range(p.SHARDS)) <= 1


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages_with_odd_rows(spark):
    """Nulls, repeated rows, empty and long texts, an empty table, and columns with the names that operators use."""
    import brute
    import corpus_pipeline as p

    rows = brute.corpus(2, 40) + [(None, None, None, None, None), (7, None, "en", "s1", 0)]
    names = {c: F.lit(c) for c in ("row", "key", "keep", "d", "k", "__d", "__k", "__id", "__text", "__cell", "copies", "cell", "rank", "size", "weight", "draw", "cls", "spot", "rejected", "taken_copies")}
    docs = spark.createDataFrame(rows, ODD).withColumns(names)
    empty = docs.limit(0)
    for name, stage in p.STAGES:
        after, none = p.written(stage(spark, docs, DATA)), stage(spark, empty, DATA)
        more = ["shard", "slot", "home_shard"] if name == "sharding" else []
        assert after.columns == docs.columns + more and none.columns == after.columns and none.count() == 0, name
        assert {tuple(r) for r in after.select(*names).distinct().collect()} <= {tuple(names)}, name
        before, got = Counter(map(tuple, docs.select("doc_id", "text").collect())), Counter(map(tuple, after.select("doc_id", "text").collect()))
        if name == "ngram_jaccard":
            want = Counter({c for _, n, c in brute.jaccard(rows_of(docs)) if n})
            assert Counter(d for (d, t), n in got.items() for _ in range(n) if brute.shingles(t)) == want
            assert sum(n for (_, t), n in got.items() if not brute.shingles(t)) == sum(n for (_, t), n in before.items() if not brute.shingles(t))
        elif name == "mixing":
            assert set(got) <= set(before) and all(n <= 3 * before[x] for x, n in got.items())
        elif name == "sharding":
            assert got == before
        else:
            assert all(n == before[x] for x, n in got.items()), name
        docs = after.select(*docs.columns)


def rows_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
