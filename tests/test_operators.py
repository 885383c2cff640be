import math

import pytest
from pyspark.sql import functions as F

from capweave.operators import captable, drafts, evaluate, layout, reconcile
from capweave.operators import relational as R

ROWS = "doc_id string, page_num int, row_index int, name string, share_type string, share_count bigint, source string, confidence double, flags array<string>, raw_cells array<string>"


def rows(spark, *items, page=1, source="vlm"):
    """items: (name, type, count) or (name, type, count, cells)."""
    return spark.createDataFrame([("d", page, i, n, t, c, source, 1.0, [], list(cells[0]) if cells else [n, t, str(c)] if t else [n, str(c)]) for i, (n, t, c, *cells) in enumerate(items)], ROWS)


def names(df, *cols):
    cols = cols or ("name", "share_type", "share_count")
    return [tuple(r) for r in df.orderBy(*[c for c in ("page_num", "row_index", "ord") if c in df.columns]).select(*cols).collect()]


def totals(spark, n=None):
    return spark.createDataFrame([("d", 1, n)] if n else [], "doc_id string, page_num int, ocr_total bigint")


def request(spark, pre, held, invested):
    kind = "doc_id string, pre_money decimal(20,0), shareholders array<struct<name:string,share_type:string,share_count:bigint>>, investors array<struct<name:string,share_type:string,amount:decimal(20,0)>>"
    from decimal import Decimal

    return spark.createDataFrame([("d", Decimal(pre), held, [(n, t, Decimal(a)) for n, t, a in invested])], kind)


def test_cap_table_sample(spark):
    r = request(spark, 9_500_000_000, [("홍길동", "", 60_000), ("김철수", "", 30_000), ("가나펀드", "", 10_000)], [("lead", None, 500_000_000)])
    got = captable.cap_table(r).orderBy("kind", "ord").collect()
    assert [x["shares"] for x in got] == [60_000, 30_000, 10_000, 5_264]
    assert [x["pre_ownership"] for x in got] == [0.6, 0.3, 0.1, None]
    assert got[0]["price"] == 95_000 and got[0]["pre_total"] == 100_000 and got[0]["post_total"] == 105_264
    assert got[3]["value"] == 500_080_000 and got[3]["share_type"] == "RCPS"
    assert math.isclose(sum(x["post_ownership"] for x in got), 1)
    cells = {(x["section"], x["row_no"]) for x in captable.cells(r).collect()}
    assert {("pre", 14), ("pre_total", 17), ("amount", 21), ("issue", 22), ("post", 25), ("post", 28), ("post_total", 29)} <= cells


def test_cap_table_six_holders_one_investor(spark):
    r = request(spark, 600, [(f"h{i}", "", 1) for i in range(6)], [("lead", None, 100)])
    by = {}
    for x in captable.cells(r).collect():
        by.setdefault(x["section"], []).append(x["row_no"])
    assert by["pre_total"] == [20] and by["amount"] == [24] and sorted(by["post"])[-1] == 34 and by["post_total"] == [35]


@pytest.mark.parametrize(("pre", "counts", "amount", "price", "new"), [(1_000_000_000, [30_007], 100, 33_326, 1), (10, [0], 5, None, None), (10, [1_000], 5, 0, None)])
def test_cap_table_edges(spark, pre, counts, amount, price, new):
    r = request(spark, pre, [("a", "", c) for c in counts], [("lead", None, amount)])
    got = {x["kind"]: x for x in captable.cap_table(r).collect()}
    assert got["holder"]["price"] == price and got["investor"]["shares"] == new


def test_invalid_requests_are_left_out(spark):
    assert captable.cap_table(request(spark, 0, [("a", "", 1)], [("l", None, 1)])).count() == 0
    assert captable.cap_table(request(spark, 10, [], [("l", None, 1)])).count() == 0


def test_deduplicated(spark):
    df = spark.createDataFrame([("d", i, *x) for i, x in enumerate([("홍길동", "", 1000), ("김", "", 5), ("홍길동", "보통주", 1000), ("홍 길동", "우선주", 1000), ("김", "", 5), ("이", "", 7), ("이 ", "", 7)])], "doc_id string, ord int, name string, share_type string, share_count bigint")
    got = reconcile.deduplicated(df)
    assert names(got) == [("홍길동", "보통주", 1000), ("홍 길동", "우선주", 1000), ("김", "", 5), ("이", "", 7)]
    assert names(reconcile.deduplicated(got)) == names(got)


def test_aggregates_go(spark):
    df = rows(spark, ("A", "보통주", 10), ("B", "보통주", 20), ("X", "보통주", 30))
    assert names(reconcile.drop_aggregates(df, totals(spark)), "name") == [("A",), ("B",)]
    assert len(names(reconcile.drop_aggregates(rows(spark, ("A", "", 10), ("X", "", 10)), totals(spark)))) == 2
    df = rows(spark, ("A", "", 10), ("B", "", 20), ("C", "", 500))
    assert names(reconcile.drop_aggregates(df, totals(spark, 20)), "name") == [("A",), ("C",)]


def test_insert_and_override(spark):
    model = rows(spark, ("홍길동", "보통주", 1000), ("김철수", "보통주", 2000))
    ocr = rows(spark, ("홍길동", "우선주", 1000), ("이영희", "RCPS", 3000), ("박", "", 4000), ("최가나", "", 5000), ("최나나", "", 5000), ("정다라 부산 해운대구", "", 6000), source="ocr")
    got = reconcile.insert_from_ocr(model, ocr, totals(spark))
    assert names(got, "name", "share_type", "share_count", "flags")[2:] == [("이영희", "RCPS", 3000, ["count_only_match"]), ("정다라", "", 6000, ["count_only_match", "address_trimmed"])]
    got = reconcile.override_types(model, ocr)
    assert names(got, "name", "share_type", "flags") == [("홍길동", "우선주", ["type_ocr_override"]), ("김철수", "보통주", [])]
    assert [r["name"] for r in reconcile.missing_details(model, ocr).collect()].count("이영희") == 1


def test_face_values(spark):
    model, ocr = rows(spark, ("A", "", 5000), ("B", "", 10_000)), rows(spark, ("A", "", 5000), ("B", "", 10_100), source="ocr")
    faces = spark.createDataFrame([("d", 1, 500)], "doc_id string, page_num int, face_value bigint")
    assert names(reconcile.correct_face_values(model, ocr, faces), "share_count", "flags") == [(10, ["face_value_corrected"]), (20, ["face_value_corrected"])]
    other = rows(spark, ("A", "", 10), ("B", "", 20), source="ocr")
    assert names(reconcile.correct_face_values(model, other, faces), "share_count") == [(5000,), (10_000,)]
    w = [("d", 1, i, t, 1.0, x, x + 5.0, 10.0 * i, 10.0 * i + 8, 10.0 * i + 4) for i, (t, x) in enumerate([("500", 50.0), ("500", 51.0), ("1,000", 90.0), ("500", 50.0)])]
    words = spark.createDataFrame(w, "doc_id string, page_num int, word_idx int, text string, conf double, x1 double, x2 double, y1 double, y2 double, yc double")
    assert [r["face_value"] for r in layout.face_values(words, rows(spark, ("A", "", 1), ("B", "", 2), ("C", "", 3))).collect()] == [500]
    assert layout.face_values(words, rows(spark, ("A", "", 1))).count() == 0


def test_validated(spark):
    df = rows(spark, ("대표이사 홍", "", 1), ("별지 1", "", 1), ("합계", "", 1), ("홍길순 서울시 마포구", "", 0), ("서울시 마포구", "", 5), ("김", "", 0), ("이", "", 20_000_000_000), ("박가나", "", 7))
    got = reconcile.validated(df)
    assert names(got, "name", "flags", "needs_review") == [("홍길순", ["address_trimmed"], True), ("박가나", [], True)]


def test_deficits_and_retry(spark):
    one, two = rows(spark, ("A", "", 10)), rows(spark, ("A", "", 10), ("B", "", 5))
    pages = one.select("doc_id", "page_num")
    got = reconcile.deficits(one, two, totals(spark, 15), pages).first()
    assert got["sum_deficit"] and got["count_deficit"] and got["needs_retry"]
    assert reconcile.pick_attempt(one, two).count() == 2 and reconcile.pick_attempt(two, one).count() == 2


def test_pages(spark):
    p = lambda page, *x: rows(spark, *x, page=page)
    df = p(1, ("A", "", 1), ("B", "", 2)).unionByName(p(2, ("A", "", 9), ("C", "", 8))).unionByName(p(3, ("C", "", 80), ("D", "", 7), ("E", "", 6)))
    assert {r["page_num"] for r in reconcile.drop_repeated_pages(df).collect()} == {1, 3}
    ocr = p(1, ("법인세법", "", 1, ["법인세법 별지", "관리번호"])).unionByName(p(2, ("A", "", 9)))
    assert {r["page_num"] for r in reconcile.reject_forms(df.where("page_num < 3"), ocr).collect()} == {2}
    assert [r["doc_id"] for r in reconcile.low_confidence(df, ocr.limit(0)).collect()] == ["d"]
    final = df.withColumn("ord", F.col("row_index"))
    text = spark.createDataFrame([("d", 1, "x" * 21)], "doc_id string, page_num int, text string")
    assert {r["share_type"] for r in captable.fill_missing_types(final, layout.text_layers(text)).collect()} == {"보통주"}


def test_layout(spark):
    w = lambda i, t, x, y, width=30.0: ("d", 1, i, t, 1.0, float(x), x + float(width), float(y), y + 10.0, y + 5.0)
    items = [
        w(0, "성명", 10, 0), w(1, "주식수", 300, 0),
        w(2, "박", 10, 30, 10), w(3, "가나", 25, 30), w(4, "보통주", 200, 31), w(5, "1,000", 300, 30),
        w(6, "가나펀드", 10, 60), w(7, "우선", 200, 60), w(8, "2,500주", 300, 60),
        w(9, "김철수", 10, 90), w(10, "800", 302, 90, 20),
        w(11, "이영희", 10, 120), w(12, "우선주식 7,000주", 250, 120, 80),
        w(13, "합계", 10, 160), w(14, "11,300", 300, 160),
    ]
    words = spark.createDataFrame(items, "doc_id string, page_num int, word_idx int, text string, conf double, x1 double, x2 double, y1 double, y2 double, yc double")
    got = layout.rows_from_words(words)
    assert names(got, "name", "share_type", "share_count", "flags") == [("박 가나", "보통주", 1000, []), ("가나펀드", "우선주", 2500, []), ("김철수", "", 800, ["small_sc_2nd_pass"]), ("이영희", "우선주", 7000, ["embedded_sc_3rd_pass"])]
    assert layout.page_totals(words).collect()[0]["ocr_total"] == 11_300
    assert layout.prompt_hints(got).first()["hint"].startswith("1: 박 가나 | 보통주 | 1,000\n2: ")
    assert [r["cells"] for r in layout.ocr_lines(words).orderBy("line").collect()][1] == ["박", "가나", "보통주", "1,000"]
    cells = layout.ocr_cells(words.withColumn("line", F.floor(F.col("y1") / 30)))
    broken = layout.break_lines(words.withColumn("line_break", F.col("word_idx").isin(1, 5, 8)))
    assert [r["line"] for r in broken.orderBy("word_idx").collect()][:10] == [0, 0, 1, 1, 1, 1, 2, 2, 2, 3]
    assert [r["text"] for r in cells.where("line = 1").orderBy("cell").collect()] == ["박 가나", "보통주", "1,000"]


def test_documents(spark):
    t = spark.createDataFrame([("d", 1, "a 합계 99\n총계 1,234 5,678"), ("d", 2, "합계 9,999"), ("e", 1, "x")], "doc_id string, page_num int, text string")
    assert [tuple(r) for r in layout.document_totals(t).collect()] == [("d", 1234)]
    s = spark.createDataFrame([("d", 1, 100.0, 100.0), ("d", 2, 9000.0, 9000.0)], "doc_id string, page_num int, w_pt double, h_pt double")
    assert layout.document_dpi(s).first()["dpi"] == 240
    r = spark.createDataFrame([("d", 1, [("a", 1.0, [(0.0, 1.0), (5.0, 1.0), (5.0, 3.0), (0.0, 3.0)]), (" ", 1.0, [(0.0, 1.0)] * 4), ("b", 1.0, [(0.0, 0.0)])])], "doc_id string, page_num int, fields array<struct<text:string,conf:double,vertices:array<struct<x:double,y:double>>>>")
    assert [tuple(x)[3:] for x in layout.ocr_words(r).collect()] == [("a", 1.0, 0.0, 5.0, 1.0, 3.0, 2.0)]


DRAFT = "=== 페이지 1 ===\n[데이터 행]\n1. 홍길동 / 보통 / 1,000\n2. 합계 / 9,999\n3. 김철수 / 2,000주\n[제외 행]\n4. x / 5\n=== 페이지 2 ===\n5. y / 6\n[데이터 행]\n6. 가조합 / 700"


def test_drafts(spark):
    d = spark.createDataFrame([("d", DRAFT), ("e", "nothing")], "doc_id string, text string")
    got = drafts.structured(d)
    assert names(got) == [("홍길동", "보통주", 1000), ("김철수", "", 2000), ("가조합", "", 700)]
    # A dropped line shifts the draft's numbering: the second kept row meets the aggregate line.
    assert names(drafts.verified_counts(got, d), "share_count", "flags") == [(1000, []), (9999, ["count_mismatch_with_draft"]), (2000, ["count_mismatch_with_draft"])]
    total = spark.createDataFrame([("d", 100_000)], "doc_id string, text_total bigint")
    c = {r["doc_id"]: r for r in drafts.completeness(d, total).collect()}
    assert (c["d"]["draft_count"], c["d"]["draft_sum"]) == (4, 13_699) and c["d"]["issues"] == ["sum_deficit: draft=13699, expected=100000", "truncation_suspect: 가조합"]
    assert c["e"]["issues"] == ["no_data_rows"] and not c["e"]["passed"]
    assert drafts.trusted(got, total).count() == 0 and drafts.trusted(got, total.limit(0)).count() == 1


REG = "doc_id string, ord int, name string, share_type string, share_count bigint"


def register(spark, *items, doc="d"):
    return spark.createDataFrame([(doc, i, *x) for i, x in enumerate(items)], REG)


def test_scoring(spark):
    truth = register(spark, ("홍길동", "보통주", 10), ("가나투자조합", "우선주", 20), ("김철수", "", 30), ("이영희", "", 40), ("박", "", 50), ("최", "", 60))
    got = register(spark, ("홍길동", "보통주", 10), ("가나 투자 조합", "보통주", 20), ("김", "", 30), ("이영희abc", "", 40), ("박", "", 55))
    found = evaluate.classified(truth, got)
    assert [r["type"] for r in found.orderBy("g").collect()] == ["correct", "share_type_mismatch", "name_truncation", "name_corruption", "share_count_mismatch", "row_omission"]
    counts = {r["type"]: r["n"] for r in evaluate.failure_counts(found).collect()}
    assert counts["correct"] == 1 and counts["row_hallucination"] == 0 and len(counts) == 7
    assert evaluate.accuracy(found).first()["accuracy"] == pytest.approx(1 / 6)
    assert not evaluate.passed(truth, got).first()["passed"] and evaluate.passed(truth, truth).first()["passed"]
    sides = evaluate.missing_and_extra(truth, got)
    assert sides.where("side = 'missing'").count() == 5 and sides.where("side = 'extra'").count() == 4


def test_matching_cascade(spark):
    truth = register(spark, ("홍길동", "보통주", 10), ("김철수", "우선주", 20), ("이영희", "", 30), ("가나다라", "", 40), ("박", "", 50))
    got = register(spark, ("홍길둥", "보통주", 10), ("김철수", "", 20), ("이영희", "", 300), ("가나", "", 40), ("정말로", "", 60))
    e = {(r["g"], r["e"], r["error"]) for r in evaluate.errors(truth, got).collect()}
    assert e == {(1, 1, "share_type_mismatch"), (2, 2, "share_count_mismatch"), (3, 3, "name_truncation"), (4, None, "row_omission"), (None, 4, "row_hallucination")}
    x = {(r["g"], r["e"], r["diff"]) for r in evaluate.discrepancies(truth, got).collect()}
    assert x == {(1, 1, "type_diff"), (3, 3, "name_diff"), (2, None, "missing"), (4, None, "missing"), (None, 2, "extra"), (None, 4, "extra")}
    p = evaluate.root_causes(evaluate.error_profile(truth, got)).first()
    assert p["total"] == 5 and p["cause"] == "type column misread" and p["buckets"] == ["hard"]
    assert {r["error"]: r["documents"] for r in evaluate.error_report(evaluate.errors(truth, got)).collect()}["row_omission"] == 1


def test_nearest_index_takes_the_lower_of_two(spark):
    left = spark.createDataFrame([("d", 6), ("d", 7)], "doc_id string, ord int")
    right = spark.createDataFrame([("d", 4), ("d", 8)], "doc_id string, ord int")
    assert {(r["g"], r["e"]) for r in evaluate.nearest_index(left, right).collect()} == {(6, 4), (7, 8)}


def test_nearest_index_equals_the_plain_search(spark):
    import random

    r = random.Random(5)
    sides = [(d, r.randrange(400)) for d in ("x", "y") for _ in range(150)], [(d, r.randrange(400)) for d in ("x", "y", "z") for _ in range(140)]
    sides = [sorted(set(s)) for s in sides]
    want = set()
    for d in ("x", "y"):
        free = [o for k, o in sides[1] if k == d]
        for g in (o for k, o in sides[0] if k == d):
            if free:
                best = min(free, key=lambda e: (abs(e - g), e))
                free.remove(best)
                want.add((d, g, best))
    left, right = (spark.createDataFrame(s, "doc_id string, ord int") for s in sides)
    assert {tuple(x) for x in evaluate.nearest_index(left, right).collect()} == want


def test_rows_without_counts_pair_by_place(spark):
    """Sixty rows of one count are paired one by one, not all with all."""
    truth = register(spark, *[(f"holder number {i}", "", None) for i in range(60)])
    got = register(spark, *[(f"another {i * 1000}", "", 0) for i in range(50)])
    m = evaluate.cascade(truth, got, by_name=False)
    assert sorted((x["g"], x["e"], x["pass_no"]) for x in m.collect()) == [(i, i, 3) for i in range(50)]


def test_hints_keep_all_cells(spark):
    cells = ["홍길순 서울시 마포구", *[str(i) for i in range(20)]]
    got = layout.prompt_hints(rows(spark, ("홍길순", "", 1, cells)))
    assert got.first()["hint"] == "1: 홍길순... | " + " | ".join(cells[1:])


def test_reports_have_sections(spark):
    from capweave.sources import sinks

    truth, got = register(spark, ("가나다", "", 10), ("라마바", "", 20)), register(spark, ("가나다", "", 10))
    report = sinks.report_sections(evaluate.accuracy(evaluate.classified(truth, got)), evaluate.passed(truth, got), evaluate.error_report(evaluate.errors(truth, got)), evaluate.root_causes(evaluate.error_profile(truth, got)))
    lines = [r["value"] for r in report.orderBy("part", "line").collect()]
    assert lines == ["# Documents", "d | FAIL | 1/2", "# Errors", "row_omission | 1 | 1", "# Causes", "rows left out | 1"]


def test_relational_edges(spark):
    v = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (2, 7), (2, None)], "k int, v int")
    assert {tuple(r) for r in v.groupBy("k").agg(R.upper_median(F.col("v"))).collect()} == {(1, 3), (2, 7)}
    assert {tuple(r) for r in R.upper_medians(v, ["k"], "v").collect()} == {(1, 3), (2, 7)}
    g = spark.createDataFrame([([1.0, 1.6, 2.2, 5.0],), ([],)], "v array<double>")
    assert [r[0] for r in g.select(R.anchored_groups(F.col("v"), F.lit(1.0))).collect()] == [[0, 0, 1, 2], []]
    n = spark.createDataFrame([("d", i) for i in (1, 2, 5, 9, 12)], "doc_id string, n int")
    assert [r["n"] for r in R.in_ranges(n, F.col("n"), "1,5-9").orderBy("n").collect()] == [1, 5, 9]
    e = spark.createDataFrame([("d", 0, "a"), ("d", 1, "b"), ("d", 2, "c")], "doc_id string, ord int, name string")
    assert [tuple(r) for r in R.removed(e, ["doc_id"], "ord", 1).orderBy("ord").select("ord", "name").collect()] == [(0, "a"), (1, "c")]
    assert [r["name"] for r in R.edited(e, "ord", 1, name="z").orderBy("ord").collect()] == ["a", "z", "c"]
