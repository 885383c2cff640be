"""Tables on which queries differed from their SQL, or steps grew too fast."""

import duckdb
import pytest
from pyspark.sql import functions as F

from capweave.llm import queries as llm
from capweave.operators import evaluate, layout
from capweave.plans import document_queries, service_queries  # noqa: F401  they add their queries
from capweave.plans import queries as register
from capweave.sources import readers
from helpers import duck, same_rows


def test_links_within_dense_groups(spark, tmp_path):
    """Places of the planted components decide here, and groups are wider than a beam."""
    duckdb.sql(f"""COPY (SELECT CAST(i AS BIGINT) AS vec_id, list_transform(range(8), lambda j: CAST(CASE WHEN j = i % 3 THEN 1 ELSE ((i * 7 + j * 13) % 11 - 5) * 0.03 END AS FLOAT)) AS embedding FROM range(240) t(i)) TO '{tmp_path}/embeddings.parquet'""")
    same_rows(llm.QUERIES["embedding_links"](spark, str(tmp_path)).toArrow(), duck(llm.ORACLE_SQL["embedding_links"], str(tmp_path)))


def test_folders_of_parts_are_listed_by_their_names(spark, tmp_path):
    for name in ("a.parquet/part-0.parquet", "a.parquet/part-1.parquet", "b.parquet", "c.txt", "d/e.parquet", "part.1.parquet/x.bin"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = document_queries.readers.numbered_files(spark, str(tmp_path), "*.parquet").collect()
    assert sorted((r["doc_id"], r["path"].rsplit("/", 1)[1]) for r in got) == [("a", "a.parquet"), ("b", "b.parquet"), ("part.1", "part.1.parquet")]
    assert [r["doc_id"] for r in document_queries.readers.numbered_files(spark, f"{tmp_path}/a*", "*1.parquet").collect()] == ["part-1"]


def free_shares(tmp_path) -> str:
    """Customers whose round has a price of 0, so that its new shares are unknown, and one whose price isn't."""
    duckdb.sql(f"""COPY (SELECT CAST(1000 * i + c AS BIGINT) AS o_orderkey, CAST(c AS BIGINT) AS o_custkey, CASE WHEN c = 3 THEN 90000.0 ELSE 1.0 END AS o_totalprice, 'p' || i AS o_orderpriority FROM range(1, 4) t(i), range(1, 4) u(c)) TO '{tmp_path}/orders.parquet'""")
    return str(tmp_path)


def _same(spark, name, at):
    same_rows(register.QUERIES[name](spark, at).toArrow(), duck(register.ORACLE[name], at))


def test_sheet_cells_with_unknown_shares(spark, tmp_path):
    _same(spark, "sheet_cells", free_shares(tmp_path))


def test_sheet_layout_with_unknown_shares(spark, tmp_path):
    _same(spark, "sheet_layout", free_shares(tmp_path))


def test_workbook_layout_with_unknown_shares(spark, tmp_path):
    at = free_shares(tmp_path)
    _same(spark, "workbook_layout", at)
    _same(spark, "workbook_cells", at)


def odd_orders(tmp_path) -> str:
    """By customer, keys and prices: none (no customer), money of 0, below 0 or unknown, keys that sum to 0 or less though one is positive, and to more though one is
    negative or unknown, and a sheet that is read as a stream."""
    rows = [(None, 11, 50), (None, 12, 60), (1, 13, 0), (1, 14, 0), (2, 15, -9000), (3, 16, None), (4, -5, 70), (4, 3, 80), (5, -4, 90), (5, 4, 90), (6, -3, 900), (6, 5, 900), (7, None, 10), (7, 8, 900), (8, None, 5), (9, 0, 5), (10, 21, 5000)]
    at = ", ".join(f"({c}, {k}, {p})".replace("None", "NULL") for c, k, p in rows)
    duckdb.sql(f"""COPY (SELECT CAST(k AS BIGINT) AS o_orderkey, CAST(c AS BIGINT) AS o_custkey, CAST(p AS DOUBLE) AS o_totalprice, 'p' || k AS o_orderpriority FROM (VALUES {at}) t(c, k, p)
    UNION ALL SELECT 100 + i, 11, 5000.0, '5-LOW' FROM range(4000) t(i)) TO '{tmp_path}/orders.parquet'""")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["workbook_layout", "sheet_cells", "sheet_layout"])
def test_sheets_of_odd_orders(spark, tmp_path, name):
    _same(spark, name, odd_orders(tmp_path))


def test_names_meet_on_hashes_once(spark):
    """Rows don't go through the shuffle with each form of their names, and an equal pair isn't made by every form."""
    rows = spark.createDataFrame([("d", i, n, "", c) for i, (n, c) in enumerate([("abcdefghij", 1), ("abcdefghij", 2), ("abcdefghix", 3), ("bacdefghij", 4), ("abcdefghijk", 5), ("", 6), (None, 7)])], "doc_id string, ord int, name string, share_type string, share_count bigint")
    g, e = evaluate._rows(rows, "g", "a"), evaluate._rows(rows, "e", "b")
    assert set(evaluate._spread(g, "g", "a", ()).columns) == {"h", "i", "c", "doc_id", "g"}
    near = {(0, 1), (0, 2), (1, 2), (0, 4), (1, 4)}
    got = [(r["g"], r["e"]) for r in evaluate._named(g, e).collect()]
    assert sorted(got) == sorted({(i, i) for i in range(6)} | near | {(b, a) for a, b in near})
    assert len([r for r in evaluate._named(g, e, ["share_type", "share_count"]).collect()]) == 6


def test_a_page_meets_once_for_its_totals(spark):
    words = spark.createDataFrame([("d", 1, 2, "1,000", 0.0, 10.0, 5.0, 9.0), ("d", 1, 1, "합계", 0.0, 10.0, 4.0, 1.0), ("d", 1, 3, "9,999", 40.0, 50.0, 45.0, 9.0), ("d", 2, 1, "77777", 0.0, 10.0, 5.0, 1.0), ("d", 3, 1, None, 0.0, 10.0, 5.0, 1.0), ("d", 3, 2, "총계", 0.0, 10.0, 5.0, 1.0), ("d", 3, 3, "5,000", 0.0, 10.0, 5.0, 1.0)], "doc_id string, page_num int, word_idx int, text string, y1 double, y2 double, yc double, x1 double")
    out = layout.page_totals(words)
    assert sorted(tuple(r) for r in out.collect()) == [("d", 1, 1000), ("d", 3, 5000)]
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_a_reply_is_parsed_once(spark):
    replies = spark.createDataFrame([("d", 1, 1, '{"shareholders": [{"name": "a", "shareCount": "7"}, {"name": 2.0, "shareCount": 1.5}]}'), ("e", 1, 1, "[]"), ("f", 1, 1, "{")], readers.MODEL_REPLY)
    for out, want in ((readers.model_rows(replies), [("d", "0"), ("d", "a")]), (readers.unread_replies(replies), [("e", "shape"), ("f", "broken")])):
        assert sorted((r["doc_id"], r["name" if "name" in out.columns else "state"]) for r in out.collect()) == want
        assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") + out._jdf.queryExecution().optimizedPlan().toString().lower().count("parse_json") == 1


def test_a_small_file_is_dealt_to_all_tasks(spark):
    for name in ("row_rules", "reply_rows", "unread_replies"):
        assert register.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 8
