import json

from capweave.plans import documents
from capweave.sources import readers, sinks
from capweave.streaming import registers as streams

WORD = "doc_id string, page_num int, word_idx int, text string, conf double, x1 double, x2 double, y1 double, y2 double, yc double"
REG = "doc_id string, ord int, name string, share_type string, share_count bigint"


def _words(spark, doc="d"):
    lines = [("박가나", "보통주", "1,000"), ("김철수", "보통주", "2,000"), ("이영희", "우선주", "4,500")]
    out = []
    for i, (n, t, c) in enumerate(lines):
        y = 30.0 * (i + 1)
        out += [(doc, 1, 3 * i + k, x, 1.0, at, at + 30.0, y, y + 10, y + 5) for k, (x, at) in enumerate(((n, 10.0), (t, 200.0), (c, 300.0)))]
    return spark.createDataFrame(out, WORD)


def _reply(*items):
    return json.dumps({"shareholders": [{"name": n, "shareType": t, "shareCount": c} for n, t, c in items]}, ensure_ascii=False)


def test_page_plan_and_choice(spark):
    replies = spark.createDataFrame([("d", 1, 1, _reply(("박가나", "보통주", 1000), ("김철수", None, "2,000"))), ("e", 1, 1, None)], readers.MODEL_REPLY)
    text = spark.createDataFrame([("d", 1, "합계 7,500"), ("e", 1, "")], "doc_id string, page_num int, text string")
    pages = documents.by_pages(_words(spark), replies, text)
    got = [tuple(r) for r in pages["shareholders"].orderBy("ord").select("name", "share_type", "share_count").collect()]
    assert got == [("박가나", "보통주", 1000), ("김철수", "보통주", 2000), ("이영희", "우선주", 4500)]
    read = spark.createDataFrame([("e", "[데이터 행]\n1. 가나펀드 / 우선 / 500\n2. 다라펀드 / 400")], "doc_id string, text string")
    reading = documents.by_reading(read, read.limit(0), text)
    every = replies.select("doc_id", "page_num")
    out = documents.chosen(pages, reading, every)
    assert {(r["doc_id"], r["name"]) for r in out.collect()} == {("d", "박가나"), ("d", "김철수"), ("d", "이영희"), ("e", "가나펀드"), ("e", "다라펀드")}
    assert {r["doc_id"]: r["success"] for r in documents.results(out, every).collect()} == {"d": True, "e": True}


def test_repair_replaces_incomplete_drafts(spark):
    text = spark.createDataFrame([("e", 1, "합계 1,000")], "doc_id string, page_num int, text string")
    first = spark.createDataFrame([("e", "[데이터 행]\n1. 가나다라마바사 / 500")], "doc_id string, text string")
    fixed = spark.createDataFrame([("e", "[데이터 행]\n1. 가나다라마바사 / 500\n2. 박가나 / 500")], "doc_id string, text string")
    assert documents.by_reading(first, fixed.limit(0), text)["shareholders"].count() == 0
    assert documents.by_reading(first, fixed, text)["shareholders"].count() == 2


def test_register_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("Test2", 0, "박가나", "", 10), ("Test2", 1, "김", "우선주", 5), ("Test10", 0, "이", "", 1)], REG)
    sinks.write_registers(rows, str(tmp_path / "out"))
    line = next(x for p in (tmp_path / "out").glob("*.json") for x in map(json.loads, p.read_text().splitlines()) if x["document_id"] == "Test2")
    assert line["total_shares"] == 15 and line["shareholders"][0]["share_type"] is None
    back = readers.registers(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert readers.register_of(spark, str(tmp_path / "out"), "Test10").count() == 1
    assert [r["doc_id"] for r in readers.in_natural_order(rows.select("doc_id").distinct(), "doc_id").collect()] == ["Test2", "Test10"]


def test_sources(spark, tmp_path):
    (tmp_path / "Test3.PDF").write_bytes(b"x")
    (tmp_path / "Test4.pdf").write_bytes(b"")
    (tmp_path / "Test12.pdf").write_bytes(b"y")
    assert readers.uploads(spark, str(tmp_path)).count() == 2
    assert [r["doc_id"] for r in readers.numbered_files(spark, str(tmp_path), "Test*.pdf", "10-13").collect()] == ["Test12"]
    (tmp_path / "r.jsonl").write_text('\n{"document_id": "a", "shareholders": [{"name": "x", "shareType": "", "share_type": "RCPS", "shareCount": "1,000"}]}\nbroken\n{"document_id": "a", "shareholders": [{"name": "y", "share_count": 7}]}\n')
    assert [tuple(r) for r in readers.registers(spark, str(tmp_path / "r.jsonl")).collect()] == [("a", 0, "y", "", 7)]
    (tmp_path / "one.json").write_text('{\n"shareholders": [{"name": "x", "share_count": 7}]\n}')
    assert readers.register_of(spark, str(tmp_path / "one.json"), "q").first()["doc_id"] == "q"
    (tmp_path / "o.jsonl").write_text(json.dumps({"doc_id": "d", "page_num": 1, "images": [{"fields": [{"inferText": "a", "boundingPoly": {"vertices": [{"x": 0, "y": 0}] * 4}}]}]}))
    assert readers.ocr_replies(spark, str(tmp_path / "o.jsonl")).first()["fields"][0]["text"] == "a"


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(3):
        (src / f"{i}.json").write_text(json.dumps({"doc_id": f"d{i}", "page_num": 1, "attempt": 1, "content": _reply((f"n{i}", "보통", 5))}, ensure_ascii=False))
    q = streams.each_batch(streams.reply_stream(spark, str(src), 1), readers.model_rows, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = readers.model_rows(readers.model_replies(spark, str(src)))
    assert sorted(r["name"] for r in got.collect()) == sorted(r["name"] for r in want.collect()) == ["n0", "n1", "n2"]


def test_jobs_run_out(spark):
    jobs = spark.createDataFrame([("a", 0), ("b", 1000)], "job_id string, created bigint")
    assert [r["job_id"] for r in streams.live_jobs(jobs, 2000).collect()] == ["b"]
