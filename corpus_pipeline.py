"""The training-data pipeline: toxicity, near duplicates, benchmark passages, source mix, shards.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents;
the last adds shard, slot and home_shard. No stage can be written in SQL as a whole (a fitted model, hash
draws and a hash ring among them), so ORACLE_SQL is None; tests/llm holds each against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from capweave.llm import decontamination, jaccard, mixing, sharding, toxicity
from capweave.llm.common import table, written

SHARDS = 24
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go. A null or empty text has no words and gets the base rate; a very long text is read
    whole; equal texts get the same verdict, so repeated rows stay or go together; without both classes among the labels no model is fitted."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the smallest doc_id (null last), then the smallest hashes of text and columns. A null or empty text is in no group; repeated
    rows are one."""
    return jaccard.near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go. A null or empty text has no window and stays; repeated rows stay or go together; an empty
    benchmark takes nothing."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights; a document appears as often as it is taken. A document with a null or empty text
    has no words and isn't taken; a null source is one of its own; rows equal in doc_id and text are taken alike."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets a shard and a slot there; shards differ by one row at most. Nulls, empty texts and repeated rows take slots like others; rows that are equal
    in all columns are interchangeable."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
