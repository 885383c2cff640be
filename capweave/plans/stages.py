"""Stage tables: Parquet in the folder that all executors share, so that lineage is cut and a lost executor loses nothing."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local master without one, a temporary folder is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", at := tempfile.mkdtemp(prefix="capweave-"))
    return at.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """The path of a new folder in the shared one."""
    return f"{shared_dir(spark)}/capweave/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._capweave_path = path
    return out


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key to as many tasks as a shuffle has. A small file is one task, however long what is made of its rows takes."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a written() table that no later plan reads."""
    if path := getattr(df, "_capweave_path", None):
        cleared(df.sparkSession, path)


def cleared(spark: SparkSession, path: str) -> None:
    """Deletes a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
