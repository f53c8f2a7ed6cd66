"""Corpus preparation in five stages; each works on all rows that its predecessor kept.

Every stage is written as Parquet in the shared folder and read again, so a lost executor costs one stage's work.
Stages learn from and compare with the labels and benchmark tables of the same folder. Each sets the session's limits of
Arrow batches to small ones, as its rows are computed when they are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mentora.llm.decontam import drop_contaminated
from mentora.llm.ngram_join import keep_one
from mentora.llm.packing import pack_documents
from mentora.llm.pii import redact
from mentora.llm.quality import keep_good
from mentora.llm.storage import small_batches, write_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    small_batches(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    small_batches(spark)
    return keep_one(docs, words=5, num=4, den=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage near a benchmark item."""
    small_batches(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    small_batches(spark)
    return redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 1024."""
    small_batches(spark)
    return pack_documents(docs, capacity=1024, end_id=2)


STAGES = [(f.__name__, f) for f in (quality_classifier, ngram_jaccard_join, benchmark_decontamination, pii, best_fit_packing)]
#: SQL can't express the learned and hashed stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return docs
