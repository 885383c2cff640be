"""URL filters, hard negatives, periodic runs: against plain versions, with odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from capweave.llm import negatives, periods, urls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# URL filters

PAGES = "page_id bigint, url string, html string, rule string, host int"
LONG = "http://" + "a." * 5_000 + "example.com/en/" + "x/" * 5_000
URLS = [
    "http://example.com/en/a", "https://WWW.Example.COM/en/", "http://www.example.com/EN/x", "http://a.www.example.com/en/x?y=/fr/", "http://notexample.com/en/x", "http://example.com/en", "http://com/x",
    "http://x.net/es/", "http://x.net/fr/a/b#c", "http://net/es", "http://x.net?/es/", "http://x.org/en/", "http://x.net#/es/", "no scheme.net/es/", "", None, "://x.net/es/", "http://", "http://com", "http://.com/",
    "http://a..net/fr/", "ftp://u@x.net:80/es/", "http://x.net/es/://y.com/", "http://x.net\n/es/", "http://例.com/en/", "http://x.com//en/", LONG, "http://sub.example.com/en/x", "http://example.com/enx", "http://EXAMPLE.com/en/x",
]
RULES = [*urls.RULES, ("example.com", "/enx", "block"), ("example.com", "/e", "allow"), ("X.net", None, "block"), ("x.com", "/", "block"), ("x.com", "/", "allow"), (None, "/", "block"), ("y", "/", None), ("org", "", "block"), ("例.com", "/en/", "block")]


def plain_verdict(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
    fit = []
    for h, p, v in rules:
        if h is not None and v is not None:
            h, p = h.translate(LOWER), p or ""
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                fit.append((len(h) + len(p), len(h), v, h + p))
    return host, path, *((max(fit)[3], max(fit)[2]) if fit else (None, default))


def judged_rows(spark, links, rules, default="allow", **kw):
    pages = spark.createDataFrame([(i if i % 5 else None, u, "h", "r", 1) for i, u in enumerate(links)], PAGES).repartition(3)
    out = urls.judged(pages, urls.rule_table(spark, rules), default)
    return Counter((r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect())


@pytest.mark.parametrize("shuffled", [False, True])
def test_urls_equal_plain_rules(spark, shuffled, monkeypatch):
    if shuffled:
        monkeypatch.setattr(urls, "fitted", lambda df: df)
    links = URLS + URLS[:7] * 3
    for rules in (RULES, urls.RULES):
        assert judged_rows(spark, links, rules) == Counter((u, *plain_verdict(u, rules)) for u in links)


def test_urls_without_rules_or_rows(spark):
    assert judged_rows(spark, URLS[:4], RULES[:1], "block") == Counter((u, *plain_verdict(u, RULES[:1], "block")) for u in URLS[:4])
    assert {x[4] for x in judged_rows(spark, URLS, [(None, None, None)])} == {"allow"}
    pages = spark.createDataFrame([], PAGES)
    assert urls.judged(pages, urls.rule_table(spark)).count() == 0


def test_allowed_pages_keep_their_columns(spark):
    pages = spark.createDataFrame([(i, u, "h", "r", 1) for i, u in enumerate(URLS + URLS)], PAGES)
    out = urls.allowed(pages, urls.rule_table(spark, RULES))
    assert out.columns == pages.columns
    assert Counter(r["url"] for r in out.collect()) == Counter(u for u in URLS + URLS if plain_verdict(u, RULES)[3] == "allow")


def test_urls_random_rules(spark):
    r = random.Random(4)
    name = lambda n: ".".join(r.choice(["a", "b", "com"]) for _ in range(r.randint(1, n)))
    path = lambda n: "/" + "".join(r.choice(["a/", "b/", "a", ""]) for _ in range(r.randint(0, n)))
    rules = list({(h, p): (h, p, r.choice(["allow", "block"])) for h, p in ((name(3), path(2)) for _ in range(60))}.values())
    links = [f"http://{name(4)}{path(4)}?q" for _ in range(300)]
    assert judged_rows(spark, links, rules) == Counter((u, *plain_verdict(u, rules)) for u in links)


# Hard negatives

VECTORS = "vec_id bigint, embedding array<double>, label int, w string, lo string"


def plain_negatives(rows, anchor, positives=5, negatives_=3, least=50, most=95):
    used = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) and abs(256 * x) < 2**24 for x in v)]
    out = Counter()
    for ai, al, av in used:
        if not anchor(ai):
            continue
        scored = [(-sum(x * y for x, y in zip(av, v)), i, lab) for i, lab, v in used if len(v) == len(av)]
        for ps, p, _ in sorted(x for x in scored if x[2] == al and x[1] != ai)[:positives]:
            fit = sorted(x for x in scored if x[2] != al and least * -ps <= 100 * -x[0] <= most * -ps)[:negatives_]
            out.update((ai, p, k + 1, n, -ps, -s) for k, (s, n, _) in enumerate(fit))
    return out


def mined(spark, rows, every, **kw):
    df = spark.createDataFrame([(i, v, lab, "w", "lo") for i, v, lab in rows], VECTORS).repartition(3)
    return Counter(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % every == 0, **kw).collect()))


def vectors(n, seed, dim=6):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, dim))
    return [(i, (centres[r.integers(4)] + r.normal(size=dim) * r.choice([0.0, 0.1, 1.0])).tolist(), int(r.integers(3))) for i in range(n)]


@pytest.mark.parametrize("block,bits", [(2_048, 9), (16, 4)])
def test_negatives_equal_plain_version(spark, monkeypatch, block, bits):
    for name in ("BLOCK", "ANCHORS"):
        monkeypatch.setattr(negatives, name, block)
    monkeypatch.setattr(negatives, "RADIX_BITS", bits)
    rows = vectors(150, 1)
    odd = [(None, [1.0] * 6, 1), (1000, None, 1), (1010, [1.0] * 6, None), (1020, [None] + [1.0] * 5, 1), (1030, [float("nan")] * 6, 1), (1040, [float("inf")] * 6, 2), (1050, [0.0] * 6, 0), (1060, [], 1), (1061, [], 2), (1070, [1.0, 2.0], 1), (1071, [1.0, 1.9], 2), (1072, [1.0, 2.0], 1), (1080, [1e9] * 6, 1)]
    odd += [(2000 + i, [0.5] * 6, i % 2) for i in range(40)] + [(30, [0.4] * 6, 1), (rows[0][0], *rows[0][1:])]
    assert mined(spark, rows + odd, 10) == plain_negatives(rows + odd, lambda i: i % 10 == 0)


def test_negatives_with_large_components_and_few_rows(spark):
    big = [(i, [60_000.0 - 1_500.5 * i, -3.0 * (i % 3)], i % 2) for i in range(24)]
    assert mined(spark, big, 3) == plain_negatives(big, lambda i: i % 3 == 0) != Counter()
    assert mined(spark, big, 3, positives=2, negatives=1, least=10, most=99) == plain_negatives(big, lambda i: i % 3 == 0, 2, 1, 10, 99)
    assert mined(spark, [], 3) == mined(spark, big[:1], 3) == mined(spark, big[1:3], 50) == Counter()


def test_a_common_vector_is_not_gathered(spark):
    """Half of all rows tie: a task sends k of them and one digit."""
    rows = [(i, [1.0, 1.0], 0) for i in range(400)] + [(1000 + i, [1.0, 0.5], 1) for i in range(400)]
    assert mined(spark, rows, 200) == plain_negatives(rows, lambda i: i % 200 == 0)
    cell = {"block": 0, "dim": 2, "ids": np.arange(1).tobytes(), "labels": np.zeros(1, np.int64).tobytes(), "vecs": np.full(2, 256, np.int32).tobytes(), "windows": [{"w": 0, "at": 0, "lo": 0, "hi": 1 << 18, "top": 1 << 18, "above": 0}]}
    many = (np.arange(1, 1001), np.zeros(1000, np.int64), np.full((1000, 2), 256, np.int32))
    for shift, sent in ((10, 1), (None, 5)):
        c = negatives._Cell(cell, True, 5, shift)
        c.meet(*many)
        assert c.sent().num_rows == sent


# Periodic runs

def plain_runs(w, least=24, times=3):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, times * q) and not any(w[i : i + size - d] == w[i + d : i + size] for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def pieces(r):
    out = []
    for _ in range(r.randint(1, 5)):
        part = [r.choice("abc") for _ in range(r.randint(1, 12))]
        out += part * r.randint(1, 6) + part[: r.randint(0, len(part))]
    return out


def test_runs_equal_brute_force():
    r = random.Random(2)
    for _ in range(1_500):
        w, least = pieces(r), r.choice([4, 9, 24])
        assert periods.runs(np.array([ord(x) for x in w], np.int64), least) == plain_runs(w, least)


def test_stretches_and_planes():
    r = random.Random(3)
    for _ in range(300):
        numbers = np.array([r.randrange(5) for _ in range(r.randint(1, 60))], np.int64)
        lag, least = r.randint(1, 20), r.randint(1, 9)
        same = "".join("1" if i + lag < len(numbers) and numbers[i] == numbers[i + lag] else "0" for i in range(len(numbers)))
        bits = periods.Planes(numbers).equal(lag)
        assert bits == int(same[::-1], 2)
        assert periods.stretches(bits, least) == [(m.start(), len(m[0])) for m in re.finditer("1+", same) if len(m[0]) >= least]


def test_long_texts_of_few_words_take_no_quadratic_time():
    assert periods.runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert periods.runs(np.arange(200_001, dtype=np.int64) % 2) == [(0, 200_001, 2)]
    assert periods.runs(np.tile(np.arange(50_000), 4)) == [(0, 200_000, 50_000)]


DOC = "doc_id bigint, text string, runs string, best int, a int"


def test_runs_query_equals_plain_version(spark):
    r = random.Random(7)
    texts = [" ".join(pieces(r)) for _ in range(120)] + [None, "", " \t\n", "ha " * 24, "ha " * 23, "x y " * 30, "\x1c " * 25, "a\x0bb\x0c" * 30, "é ü " * 15, "w " * 5_000]
    rows = [(i if i % 9 else None, t, "r", 1, 2) for i, t in enumerate(texts)] + [(5, texts[5], "r", 1, 2)] * 2
    got = Counter(map(tuple, periods.periodic_runs(periods.with_repeats(spark.createDataFrame(rows, DOC).repartition(3))).select("doc_id", "n_words", F.col("runs").cast("string"), "collapsed").collect()))
    want = Counter()
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        found = plain_runs(w) if len(w) < 1_000 else [(0, len(w), 1)]
        want[(i, len(w), "[" + ", ".join(f"{{{s}, {n}, {q}}}" for s, n, q in found) + "]", collapsed(w, found))] += 1
    assert got == want
    assert periods.periodic_runs(spark.createDataFrame([], DOC)).count() == 0


def test_best_run_is_exact(spark):
    rows = [([(0, 100, 3), (5, 200, 6), (9, 67, 2)],), ([(0, 10**9 + 1, 10**8), (4, 10**9, 10**8)],), ([],), ([(7, 24, 3), (9, 24, 3)],)]
    df = spark.createDataFrame(rows, "runs array<struct<start:bigint,length:bigint,period:bigint>>")
    assert [r["b"] and tuple(r["b"]) for r in df.select(periods.best_run(F.col("runs")).alias("b")).collect()] == [(9, 67, 2), (0, 10**9 + 1, 10**8), None, (7, 24, 3)]
    with pytest.raises(ValueError):
        periods.periodic_runs(df.select(F.lit(1).alias("doc_id"), F.lit("").alias("text")), times=2)


# Changes of this round to earlier operators


def test_names_behind_the_bitmap_are_all_found(spark, monkeypatch):
    """The joins shuffled, and a bitmap so small that most bits are set: rows are the same."""
    from capweave.llm import decontamination as d

    r = random.Random(5)
    text = lambda n: " ".join(r.choice("abcdefgh") + str(r.randrange(9)) for _ in range(n))
    items = [(i, text(r.choice([3, 10, 14]))) for i in range(40)] + [(99, None), (98, "")]
    docs = [(i, f"{text(15)} {items[i % 40][1]} {text(5)}" if i % 3 else text(30)) for i in range(120)] + [(None, None), (7, "")]
    rows, bench = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")
    found = lambda: Counter((x["doc_id"], x["n_words"], x["n_hit"], tuple(x["items"])) for x in d.find_hits(rows, bench).collect())
    want = found()
    monkeypatch.setattr(d, "fitted", lambda df, *a: df)
    for bits in (1 << 28, 64):
        monkeypatch.setattr(d, "FILTER_BITS", bits)
        assert found() == want
    names = d.item_windows(bench).select(F.col("name").alias("wanted")).distinct()
    monkeypatch.setattr(d, "FILTER_BITS", 1 << 28)
    other = names.select(F.lit(1).alias("n"), F.explode(F.array("wanted", F.col("wanted") + 1)).alias("name"))
    assert names.count() <= d._maybe_named(other, names).count() < 1.1 * names.count()


def test_rows_that_differ_in_one_column_keep_their_slots(spark):
    from capweave.llm import sharding

    df = spark.createDataFrame([(i % 3 if i % 4 else None, "same", f"x{i}") for i in range(60)], "doc_id bigint, text string, lang string")
    runs = {tuple(sorted(((r["lang"], r["shard"], r["slot"]) for r in sharding.shard_documents(df.repartition(k), 5).collect()))) for k in (1, 4, 7)}
    assert len(runs) == 1


def test_planted_links_are_found(spark):
    from capweave.llm import queries
    from helpers import DATA, duck, same_rows

    got = queries.QUERIES["embedding_links"](spark, DATA).toArrow()
    same_rows(got, duck(queries.ORACLE_SQL["embedding_links"]))
    assert sorted(set(got.column("n_links").to_pylist())) == [1, 2]


@pytest.mark.parametrize("name", ["op11_url_filter", "op12_hard_negatives", "op13_periodic_runs"])
def test_new_queries_equal_sql(spark, name):
    from capweave.llm import queries
    from helpers import DATA, duck, same_rows

    same_rows(queries.QUERIES[name](spark, DATA).toArrow(), duck(queries.ORACLE_SQL[name]))
