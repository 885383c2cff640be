"""The rules as SQL functions, and the plans' rows as a table function that is chosen by name.

A function's body is the Catalyst expression of its Column, as SQL, so queries inline it: it stays in the JVM, is optimised with the query, and is the
same rule that the plans use. Rules with lambdas over arrays have no SQL form and are left out. Functions are temporary: they belong to the session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules, text

#: name: (parameters, type, rule).
FUNCTIONS: dict[str, tuple[str, str, Callable[..., Column]]] = {
    "parse_count": ("x STRING", "BIGINT", text.parse_count),
    "clean_name": ("x STRING", "STRING", text.clean_name),
    "normal_share_type": ("x STRING", "STRING", text.normal_share_type),
    "known_share_type": ("x STRING", "STRING", text.known_share_type),
    "scoring_name": ("x STRING", "STRING", text.scoring_name),
    "thousands": ("x BIGINT", "STRING", text.thousands),
    "from_millions": ("x BIGINT", "BIGINT", lambda x: text.from_millions(x).cast("bigint")),
    "natural_key": ("x STRING", "BIGINT", lambda x: text.natural_key(x).cast("bigint")),
    "unfenced": ("x STRING", "STRING", text.unfenced),
    "is_aggregate_label": ("x STRING", "BOOLEAN", rules.is_aggregate_label),
    "is_signature_row": ("x STRING", "BOOLEAN", rules.is_signature_row),
    "is_address": ("x STRING", "BOOLEAN", rules.is_address),
    "is_digit_heavy": ("x STRING", "BOOLEAN", rules.is_digit_heavy),
    "may_insert": ("name STRING, n BIGINT, median BIGINT, total BIGINT", "BOOLEAN", rules.may_insert),
}
PLAN = "doc_id STRING, ord INT, name STRING, share_type STRING, share_count BIGINT"


def body(spark: SparkSession, parameters: str, rule: Callable[..., Column]) -> str:
    """The SQL of a rule over its parameters."""
    names = [p.split()[0] for p in parameters.split(", ")]
    plan = spark.createDataFrame([], parameters).select(rule(*map(F.col, names)).alias("__rule"))._jdf.queryExecution().analyzed()
    return plan.expressions().apply(0).child().sql()


def register(spark: SparkSession) -> list[str]:
    """Makes FUNCTIONS known to the session's SQL; their names."""
    for name, (parameters, kind, rule) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body(spark, parameters, rule)}")
    return list(FUNCTIONS)


def register_plans(spark: SparkSession, plans: dict[str, DataFrame], name: str = "register_rows") -> None:
    """A table function name(plan): PLAN rows of the plan of that name, and none for another. Catalyst sees the name as a constant, so only that plan is read."""
    parts = []
    for plan, df in plans.items():
        view = f"{name}_{plan}"
        df.select("doc_id", F.col("ord").cast("int").alias("ord"), "name", "share_type", "share_count").createOrReplaceTempView(view)
        parts.append(f"SELECT * FROM {view} WHERE plan = '{plan}'")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(plan STRING) RETURNS TABLE ({PLAN}) RETURN {' UNION ALL '.join(parts)}")
