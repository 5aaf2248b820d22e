"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, token files.

Each stage reads what its predecessor kept, decides with one operator, and returns
the columns of `documents`; the last returns what the token files hold.  A stage's
rows are written and read again before the next, so no lineage crosses stages.

Defined results are the operators' own: null, empty and blank texts fail the rules;
rows with equal or null ids are judged by their own texts, and of rows equal in both
one goes on from near-dedup; an empty table gives no rows; other columns pass through
to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moraine.llm import decontaminate, mixing, neardup, quality, tokens
from moraine.llm.common import scratch, settled


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that with the smallest id."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten consecutive words with a benchmark item go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.sample(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, written and read back."""
    return tokens.query(docs)


STAGES = [("quality_rules", rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mix), ("token_ids", token_files)]

#: Signatures and tokenization can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
