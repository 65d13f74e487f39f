"""From raw documents to sharded training text: quality, duplicates, leaks, mixture, placement.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of ``documents``;
the last one adds ``slot`` and ``shard``. What a stage returns is written as Parquet into the
shared folder and read again by the next, so a lost executor costs the running stage at most.

Defined results: null, empty and blank texts fail the quality rules; repeated rows become one in the
second stage; null ids and sources go through as values of their own; an empty table stays empty. Extra
columns go through every stage unchanged whatever their names, but for ``slot`` and ``shard``, which
the last stage sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import decontaminate, jaccard, mixing, quality, sharding
from orrery.session import fresh_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every class of near copies."""
    return jaccard.keep_first(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents drawn to the sources' targets: a document comes up to twice, or not at all."""
    return mixing.mix(docs)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every drawn document with its slot and shard."""
    return sharding.place(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", dedup_stage),
    ("benchmark_decontamination", decontaminate_stage),
    ("source_mixing", mix_stage),
    ("sharding", shard_stage),
]

ORACLE_SQL = None  # the fitted classifier and the drawn quotas have no SQL form; tests compare with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
