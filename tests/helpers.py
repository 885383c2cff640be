"""Small tables and comparison with DuckDB."""

import os

DATA = "/root/testdata/sf0.001"


def values(spark, function, *args):
    """function over the rows of args (tuples or single values), in order."""
    from pyspark.sql import functions as F

    rows = [(i, *(a if isinstance(a, tuple) else (a,))) for i, a in enumerate(args)]
    width = len(rows[0]) - 1
    kinds = ", ".join(f"c{k} {'bigint' if any(isinstance(r[k + 1], int) for r in rows) else 'string'}" for k in range(width))
    df = spark.createDataFrame(rows, f"i int, {kinds}")
    return [r["x"] for r in df.select("i", function(*[F.col(f"c{k}") for k in range(width)]).alias("x")).orderBy("i").collect()]


def duck(sql, sf_dir=DATA):
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return c.sql(sql).to_arrow_table()


def same_rows(a, b):
    assert sorted(a.schema.names) == sorted(b.schema.names)
    cols = sorted(a.schema.names)
    flat = lambda t: sorted(map(repr, t.select(cols).to_pandas().itertuples(index=False, name=None)))
    assert flat(a) == flat(b)
