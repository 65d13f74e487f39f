"""The test tables in the shape of the catalogue, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def interactions(spark: SparkSession, folder: str) -> DataFrame:
    """All line items as ratings of parts by suppliers: every 7th line undated, every 20th part unknown."""
    rows = table(spark, folder, "lineitem")
    part = F.col("l_partkey")
    return rows.select(
        F.when(part % 20 == 0, -part).otherwise(part).alias("recipe_id"),
        F.col("l_suppkey").alias("user_id"),
        F.when(F.col("l_linenumber") != 7, F.col("l_shipdate").cast("date")).alias("date"),
        (F.col("l_quantity").cast("int") % 6).alias("rating"),
    )


def recipes(spark: SparkSession, folder: str) -> DataFrame:
    """All parts as records, some without a name or a duration."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, folder, "part").select(
        key.alias("id"),
        F.when(key % 97 != 0, F.col("p_name")).alias("name"),
        F.when(key % 31 != 0, size * 6).alias("minutes"),
        (key % 25 + 1).cast("int").alias("n_steps"),
        (size % 24 + 1).cast("int").alias("n_ingredients"),
        F.concat((F.lit(1999) + key % 20).cast("string"), F.lit("-06-15")).alias("submitted"),
    )


def recipe_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Nested size tags (tiny in mid in wide) and one type tag per part, in one scan."""
    size = F.col("p_size")
    tags = F.array(
        F.when(size < 40, "wide"), F.when(size < 25, "mid"), F.when(size < 10, "tiny"), F.lower("p_type")
    )
    long = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.explode(tags).alias("tag"))
    return long.filter(F.col("tag").isNotNull())


def recipe_items(spark: SparkSession, folder: str) -> DataFrame:
    """All line items as ingredients of parts, with repeats."""
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("id"),
        F.concat(F.lit("item-"), (F.col("l_suppkey") % 40).cast("string")).alias("ingredient"),
    )


def baskets(spark: SparkSession, folder: str) -> DataFrame:
    """Part names per order."""
    names = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("ingredient"))
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey").join(
        names, "l_partkey").select("id", "ingredient")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def points(spark: SparkSession, folder: str) -> DataFrame:
    """The first three vector components as coordinates; label 0 counts as noise."""
    at = F.col("embedding")
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        *[at[i].cast("double").alias(axis) for i, axis in enumerate(("x", "y", "z"))],
        F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("cluster"),
    )


def papers(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as papers: source as title, some without a title or an identifier."""
    key = F.col("doc_id")
    return table(spark, folder, "documents").select(
        key.cast("string").alias("id"),
        F.when(key % 5 == 0, "").otherwise(F.col("source")).alias("title"),
        F.col("text").alias("abstract"),
        F.when(key % 3 == 0, F.concat(F.lit("10.1000/"), key.cast("string")))
        .when(key % 3 == 1, F.concat(F.lit(" https://doc.example/"), key.cast("string"), F.lit(" "))).alias("doi"),
    )
