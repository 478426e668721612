"""A corpus from raw documents to token files: each stage works on what the one before kept.

``run`` applies the stages to ``documents``; each result is written to the
shared folder as Parquet and read again, so a lost executor costs a stage's
tasks only. SQL can't express the stages, so there is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quintet.llm import decontaminate, mixing, simhash, tokens, toxicity
from quintet.llm.common import materialize

ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones among them, does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    return simhash.keep_one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated; their texts stay as they are."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' targets take them."""
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents, and where each lies in them."""
    return tokens.read_tokens(spark, *tokens.write_tokens(docs))


STAGES = [("toxicity", toxic), ("simhash", near_duplicates), ("decontamination", benchmark_passages), ("mixing", mixture), ("tokens", token_files)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
