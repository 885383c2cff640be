"""SQL functions against the rules that they are made from; plans by name."""

from pyspark.sql import functions as F

from capweave.functions import sql

TEXTS = ["1. ㈜ 가 나", "합 계", "1,234주", "홍길동 (주식회사 가)", "서울시 마포구 3층", "2021년 3월 4일", "대표이사 (인)", "010-1234-5678", "'q' \\ \"d\" `x`", "", " 우선주 ", "```JSON\n{}```", "Test12b", "12 박가", "Ⅰ 호", None]


def test_functions_are_the_rules(spark):
    assert sql.register(spark) == list(sql.FUNCTIONS)
    t = spark.createDataFrame([(x, i * 1_234_567, [None, 500, 7][i % 3], [None, 1_234_567][i % 2]) for i, x in enumerate(TEXTS)], "s string, b bigint, median bigint, total bigint")
    for name, (parameters, kind, rule) in sql.FUNCTIONS.items():
        given = ["s", "b", "median", "total"] if "," in parameters else ["b" if "BIGINT" in parameters else "s"]
        both = t.select(F.expr(f"{name}({', '.join(given)})").alias("f"), rule(*map(F.col, given)).alias("r"))
        assert both.schema["f"].dataType.simpleString() == kind.lower()
        assert [r["f"] for r in both.collect()] == [r["r"] for r in both.collect()], name
        assert "Python" not in both._jdf.queryExecution().executedPlan().toString()


def test_a_plan_is_chosen_by_name_and_read_alone(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, "x", "", 1), ("b", 0, "y", "", 2)], "doc_id string, ord int, name string, share_type string, share_count bigint")
    plans = {}
    for i, name in enumerate(("pages", "reading")):
        rows.where(F.col("share_count") > i).write.parquet(str(tmp_path / name))
        plans[name] = spark.read.parquet(str(tmp_path / name))
    sql.register_plans(spark, plans)
    got = spark.sql("SELECT * FROM register_rows('reading')")
    assert [r["doc_id"] for r in got.collect()] == ["b"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
    assert spark.sql("SELECT * FROM register_rows('pages') WHERE doc_id = 'a'").count() == 1 and spark.sql("SELECT * FROM register_rows('none')").count() == 0
