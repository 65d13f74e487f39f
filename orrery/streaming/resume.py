"""Embedding and naming that pick up where an interrupted run stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.operators.clusters import still_unnamed
from orrery.operators.embed import embed_text
from orrery.sources.readers import path_exists


def embed_incrementally(spark: SparkSession, source: str, schema: str, out: str, state: str,
                        prepare: Callable[[DataFrame], DataFrame],
                        embed: Callable[[DataFrame], DataFrame] = embed_text,
                        file_format: str = "parquet", name_filter: str | None = None,
                        files_per_batch: int = 1000) -> int:
    """Embed the files of ``source`` not seen by an earlier run; returns the number of batches run.

    ``prepare`` turns source rows into (id, text). The stream's checkpoint remembers the files
    done. A batch owns the folder of its number and overwrites it, so one that is replayed after
    a failure replaces its partial output.
    """
    reader = spark.readStream.schema(schema).format(file_format).option("maxFilesPerTrigger", files_per_batch)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)

    stored: list[int] = []

    def store(batch: DataFrame, number: int) -> None:
        stored.append(number)
        embed(prepare(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        reader.load(source).writeStream.foreachBatch(store)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return len(set(stored))


def embedded(spark: SparkSession, out: str) -> DataFrame:
    """Vectors of all batches so far; an id that came in again has its latest vector."""
    rows = spark.read.option("basePath", out).parquet(out)
    latest = rows.groupBy("id").agg(F.max_by("embedding", "batch").alias("embedding"))
    return latest


def name_incrementally(clusters: DataFrame, texts: DataFrame, path: str,
                       name: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Name the clusters that have no stored name yet, append them, and return all names."""
    spark = clusters.sparkSession
    schema = "cluster int, name string"
    done = spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)
    todo = still_unnamed(clusters, done)
    named = name(texts.join(todo, "cluster", "left_semi"))
    named.select(F.col("cluster").cast("int"), "name").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
