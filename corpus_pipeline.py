"""Corpus pipeline: quality rules, language, near duplicates, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterstream.llm import decontaminate, langid, neardup, packing, quality
from meterstream.llm.common import forget, saved, scratch


def settled(spark: SparkSession) -> None:
    """What the stages ask of the session: few rows in a batch for Python, as a task holds a batch of whole texts on either side."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the base rule and the thresholds of their language and source."""
    settled(spark)
    return quality.kept_documents(docs)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    settled(spark)
    return langid.kept_documents(docs)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.kept_documents(docs)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    settled(spark)
    return packing.pack(docs, with_ids=False)


STAGES = [("quality", keep_quality), ("language", keep_languages), ("near_duplicates", keep_distinct), ("decontamination", keep_unleaked), ("packing", pack)]

#: Trained models, signatures and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a stage has written goes when the next one is done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch():
            docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}", outlive=True)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
