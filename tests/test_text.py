import json
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from capweave.functions import rules, text
from helpers import values


def test_parse_count(spark):
    got = values(spark, text.parse_count, "8,000주", "1234.56", "0", "abc", None, "1.2.3", "-100", "", " 12 ", "1,000,000")
    assert got == [8000, 1234, None, None, None, None, 100, None, 12, 1000000]


def test_clean_name(spark):
    given_ = ["1. 홍길동", "홍길동(000000-*******)", "이 해 성 펀드", "2) 가나  다라", " 홍 길 동 ", "펀드 Ⅲ", "펀드ⅳ", "A B C", "홍길동 (주)", "홍길동(000000)", "\t홍길동\n펀드", ""]
    assert values(spark, text.clean_name, *given_) == ["홍길동", "홍길동", "이해성 펀드", "가나 다라", "홍길동", "펀드 III", "펀드iv", "A B C", "홍길동 (주)", "홍길동", "홍길동 펀드", ""]


def test_join_single_syllables(spark):
    assert values(spark, text.join_single_syllables, "홍 길 동", "가나 다 라 마바", "가 나다 라", "a 가 b", "가", "가 나 A 다 라") == ["홍길동", "가나 다라 마바", "가 나다 라", "a 가 b", "가", "가나 A 다라"]


def test_normal_share_type(spark):
    got = values(spark, text.normal_share_type, "상환전환우선주", "RCPS", "", "보통", "우선주", " 전환우선주 ", "종류주식", "기타", "보통우선", "의결권없는주식")
    assert got == ["우선주", "RCPS", "보통주", "보통주", "우선주", "우선주", "종류주식", "기타", "보통주", "의결권없는주식"]
    assert values(spark, text.known_share_type, "기타", "우선", "", "RCPS") == ["", "우선주", "", "RCPS"]


def test_nothing_is_cut_off(spark):
    many = "가" + " (주식회사 나)" * 12
    assert values(spark, text.strip_parentheses, many, many + " (A)", "가", None, "", ")(") == ["가", many + " (A)", "가", None, "", ")("]
    long = " ".join(["홍길순", *["가나"] * 30, "부산"])
    assert values(spark, rules.name_has_address, long, "", " ") == [True, False, False]


def test_strip_parentheses(spark):
    got = values(spark, text.strip_parentheses, "가펀드 (업무집행조합원 나)", "가(주)", "가 (재단법인 (나)) (123-45-67890)", "가펀드(A 주식회사) (B 유한회사)", "가 (SUP)", "가 (123-45-67890)", "가")
    assert got == ["가펀드", "가(주)", "가 (재단법인 (나))", "가펀드", "가 (SUP)", "가", "가"]


def test_scoring_names(spark):
    pairs = [("㈜가나", "주식회사 가나", True), ("가나 투자 조합", "가나투자조합", True), ("홍길동", "홍길둥", True), ("홍길동", "김철수", False), ("가펀드 (자기주식)", "가펀드", True), ("가 ( 나 )", "가(나)", True), ("홍길동", "홍길동가나", False)]
    match = lambda a, b: text.names_match(text.scoring_keys(a), text.scoring_keys(b))
    assert values(spark, match, *[p[:2] for p in pairs]) == [p[2] for p in pairs]


def test_name_prefix(spark):
    assert values(spark, text.name_prefix, "홍길순 서울 마포구", "가나펀드", "서울 홍길순 강남구", "서울 강남구", "", "가나 다라 부산시 x") == ["홍길순", "가나펀드", "홍길순", "", "", "가나 다라"]


def test_replies(spark):
    good = '```json\n{"shareholders":[{"name":"1. 홍길동","shareType":null,"shareCount":"1,000주"},{"name":"","shareType":"","shareCount":3},{"name":"김철수","shareType":"우선","shareCount":5},{"name":"가","shareType":"","shareCount":"x"}]}\n```'
    got = values(spark, text.reply_rows, good, "not json", None, '{"shareholders": []}')
    assert [tuple(r) for r in got[0]] == [(0, "홍길동", "", 1000), (2, "김철수", "우선주", 5)]
    assert got[1:] == [[], None, []]


def test_counts_and_names_of_every_json_type(spark):
    row = lambda **k: json.dumps({"shareholders": [k]}, ensure_ascii=False)
    raw = lambda count: f'{{"shareholders": [{{"name": "가나", "shareCount": {count}}}]}}'
    counts = {"10000000.0": 10_000_000, "1e7": 10_000_000, "5.9": 5, "-5": None, "0.9": None, "true": 1, "false": None, "null": None, "[7]": None, '{"a": 7}': None, '"1,234주"': 1234, '"-5"': 5, '"1.9"': 1, '""': None, "9007199254740993": 9007199254740993, "1e300": None, "99999999999999999999": None}
    got = values(spark, text.reply_rows, *map(raw, counts))
    assert [r[0]["share_count"] if r else None for r in got] == list(counts.values())
    names = {"홍": "홍", 5: "5", 2.5: "5", 1e7: "0", -2.5: "-2.5", -1e7: "-10000000.0", True: "True", None: "None"}  # a leading number and its point go
    got = values(spark, text.reply_rows, *[row(name=n, shareCount=1) for n in names], row(shareCount=1))
    assert [r[0]["name"] if r else None for r in got] == [*names.values(), None]
    got = values(spark, text.reply_rows, *[row(name="가", shareType=t, shareCount=1) for t in ("", " ", None, "보통", 3)], row(name="가", shareCount=1))
    assert [r[0]["share_type"] for r in got] == ["보통주", "보통주", "", "보통주", "3", ""]


def test_fences_shapes_and_states(spark):
    body = '{"shareholders": [{"name": "가", "shareCount": 1}]}'
    replies = [f"```JSON\n{body}\n```", f"```\n{body}```", f"  ```Json {body} ```  ", body, f"[{body}]", "7", '{"shareholders": 7}', '{"shareholders": [7]}', '{"a": 1}', "{", "```", " \n", None, body + "x", body + body, body + "," + body]
    states = ["read"] * 4 + ["shape", "shape", "read", "shape", "read", "broken", "broken", "failed", "failed", "broken", "broken", "broken"]
    assert values(spark, lambda x: text.parsed_reply(x)["state"], *replies) == states
    rows = values(spark, text.reply_rows, *replies)
    assert [None if r is None else len(r) for r in rows] == [1] * 4 + [None, None, 0, None, 0, 0, 0, None, None, 0, 0, 0]


def test_drafts_totals_keys(spark):
    got = values(spark, text.draft_line, "1. 홍길동 / 보통 / 1,000주", "2. 김 / 20", "x", "3. 하나", "4. 가 / 이상 / 7")
    assert [tuple(g) if g else None for g in got] == [("홍길동", "보통주", 1000), ("김", "", 20), None, None, ("가", "", 7)]
    assert values(spark, text.totals_in, "합계 1,234 99 100 12345678901234 5000") == [[1234, 5000]]
    assert values(spark, text.natural_key, "Test12b3", "x", None) == [12, None, None]
    assert values(spark, text.thousands, 1234567) == ["1,234,567"]
    assert values(spark, text.from_millions, 95) == [95_000_000]
    assert values(spark, lambda a, b: text.first_given(a, b), ("", "b"), ("a", "b"), (None, None)) == ["b", "a", ""]
    assert values(spark, text.safe_dpi, (595, 842), (2000, 3000), (10000, 10000)) == [300, 240, 240]


def test_aggregate_labels(spark):
    got = values(spark, rules.is_aggregate_label, "합 계", "홍길동", "", "계", "총주식수 10", "total", "Total", "계양", "소계1", "합")
    assert got == [True, False, False, True, True, True, False, False, True, True]


@pytest.mark.parametrize(
    ("name", "count", "median", "total", "ok"),
    [
        ("홍길동", 100, 50, None, True), ("등기부", 1, None, None, False), ("a@b", 1, None, None, False), ("1 홍길동", 1, None, None, False), ("홍 000000-***", 1, None, None, False),
        ("12월 가나", 1, None, None, False), ("홍길동", 5001, 50, None, False), ("홍길동", 5000, 50, None, True), ("홍길동", 100_000_000, None, None, False), ("5명", 1, None, None, False),
        ("홍", 1, None, None, False), ("홍길동", 10, None, 10, False), ("홍길동", 10, 0, 11, True), ("2024년", 1, None, None, False), ("10", 1, None, None, False),
    ],
)
def test_may_insert(spark, name, count, median, total, ok):
    row = spark.createDataFrame([(name, count, median, total)], "n string, c bigint, m bigint, t bigint")
    assert row.select(rules.may_insert(F.col("n"), F.col("c"), F.col("m"), F.col("t"))).first()[0] is ok


def test_row_predicates(spark):
    assert values(spark, rules.is_address, "101동 202호", "가나", "서울시 마포구", "동") == [True, False, True, False]
    assert values(spark, rules.name_has_address, "홍길순", "홍길순 부산", "홍길순 마포구 동교로", "부산 가나") == [False, True, True, False]
    assert values(spark, rules.is_digit_heavy, "12345", "1234", "12ab5", "000-00-00000", "a1234567") == [True, False, False, True, True]
    assert values(spark, rules.is_signature_row, "2024년 12월 11일", "홍길동 (인)", "홍길동 100", "서기 홍길동") == [True, True, False, True]
    lines = spark.createDataFrame([(0, ["합계", "10"]), (1, ["성명"]), (2, ["홍길동", "10"]), (3, ["가" * 31]), (4, ["1234567890123"])], "i int, c array<string>")
    assert [r[0] for r in lines.orderBy("i").select(rules.keeps_line(F.col("c"))).collect()] == [False, False, True, False, False]
    form = spark.createDataFrame([(3, 0.0, 0.0), (2, 0.3, 0.5), (2, 0.2, 0.9), (0, None, None)], "h int, l double, u double")
    assert [r[0] for r in form.select(rules.is_form_page(F.col("h"), F.col("l"), F.col("u"))).collect()] == [True, True, False, False]
    ready = spark.createDataFrame([(["a"], [1]), ([""], [1]), (["a"], [0]), ([], [])], "n array<string>, c array<bigint>")
    assert [r[0] for r in ready.select(rules.ready_rows(F.col("n"), F.col("c"))).collect()] == [True, False, False, False]
    up = spark.createDataFrame([("a/B.PDF", 3), ("a.pdf", 0), ("a.txt", 3)], "p string, n bigint")
    assert [r[0] for r in up.select(rules.is_pdf_upload(F.col("p"), F.col("n"))).collect()] == [True, False, False]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="가나다 ab1.()", max_size=12), min_size=1, max_size=20))
def test_clean_name_is_stable_without_numbers(spark, names):
    names = [n.replace("1", "") for n in names]
    once = values(spark, text.clean_name, *names)
    assert values(spark, text.clean_name, *once) == once
