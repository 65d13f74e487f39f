"""File sinks. Every one is a partitioned write by the executors.

The rebalance hint sizes the write tasks at run time: a large folder is written by several
tasks, small ones share a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orrery.functions.text import shard_key, slug
from orrery.operators.documents import with_folder
from orrery.operators.explore import systematic_sample
from orrery.operators.ratings import rating_lists, summary


def json_lines(df: DataFrame, path: str) -> None:
    """Records as JSON lines, lists as arrays, nulls left out."""
    df.write.mode("overwrite").json(path)


def vectors(df: DataFrame, path: str) -> None:
    """Vector table keyed by id."""
    df.select("id", "embedding").write.mode("overwrite").parquet(path)


def features(df: DataFrame, path: str) -> None:
    """Feature vectors, one folder per family."""
    df.select("id", "family", "vector").hint("rebalance", F.col("family")).write.mode("overwrite").partitionBy(
        "family").parquet(path)


def sharded_metrics(summaries: DataFrame, path: str) -> None:
    """Compressed JSON per id shard: {"id", "metrics"}, with empty metrics where nothing happened.

    Shards are folders; a large shard is several files in it.
    """
    metrics = F.struct(*[F.col(c) for c in summaries.columns if c not in ("id", "empty")])
    body = F.when(F.col("empty"), F.lit("{}")).otherwise(F.to_json(metrics))
    rows = summaries.select(shard_key(F.col("id")).alias("shard"), "id", body.alias("metrics"))
    line = F.concat(F.lit('{"id":"'), F.col("id").cast("string"), F.lit('","metrics":'), F.col("metrics"), F.lit("}"))
    rows.select("shard", line.alias("value")).hint("rebalance", F.col("shard")).write.mode("overwrite").partitionBy(
        "shard").option("compression", "gzip").text(path)


def per_category(rollup: DataFrame, path: str) -> DataFrame:
    """Category roll-ups in one folder per (family, slug); returns the index of labels to folders."""
    named = rollup.withColumn("slug", slug(F.col("category")))
    named.repartition("family", "slug").write.mode("overwrite").partitionBy("family", "slug").option(
        "compression", "gzip").json(path)
    return category_index(rollup)


def category_documents(documents: DataFrame, items: DataFrame, path: str) -> DataFrame:
    """Nested documents and, beside them, the items of every category in order, each in one folder per
    (family, slug), and the index of labels to files as one record per family; returns the index."""
    keys = ["family", "slug"]
    with_folder(documents).hint("rebalance", *[F.col(k) for k in keys]).write.mode("overwrite").partitionBy(*keys).option(
        "compression", "gzip").json(f"{path}/documents")
    with_folder(items).repartitionByRange(*keys, "position").sortWithinPartitions(*keys, "position").write.mode(
        "overwrite").partitionBy(*keys).option("compression", "gzip").json(f"{path}/items")
    index = category_index(documents)
    entry = F.struct("label", "file")
    index.groupBy("family").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("files")).coalesce(1).write.mode(
        "overwrite").json(f"{path}/index")
    return index


def category_index(rollup: DataFrame) -> DataFrame:
    """(family, label, file) of every category."""
    file = F.concat("family", F.lit("_"), slug(F.col("category")), F.lit(".json.gz"))
    return rollup.select("family", F.col("category").alias("label"), file.alias("file")).distinct()


def chunks(df: DataFrame, path: str, chunks_per_folder: int = 1) -> None:
    """Records in Z-order, one folder per chunk, or per run of chunks where there would be too many."""
    ordered = df.repartitionByRange("chunk_id", "position").sortWithinPartitions("chunk_id", "position")
    folder = "chunk_id" if chunks_per_folder == 1 else "chunk_run"
    if chunks_per_folder > 1:
        ordered = ordered.withColumn(folder, F.floor(F.col("chunk_id") / chunks_per_folder).cast("long"))
    ordered.write.mode("overwrite").partitionBy(folder).option("compression", "gzip").json(path)


def entity_documents(recipes: DataFrame, interactions: DataFrame, path: str, extra: tuple[str, ...] = ()) -> None:
    """Per-record metrics and, beside them, the record's ratings in order.

    The ratings are rows (recipe_id, position, ...) sorted in each file rather than one array in
    the document: a record with very many ratings stays readable and writable.
    """
    head = summary(recipes, interactions).join(recipes.select("id", "name"), "id")
    head.withColumn("shard", shard_key(F.col("id"))).hint("rebalance", F.col("shard")).write.mode(
        "overwrite").partitionBy("shard").json(f"{path}/metrics")
    known = recipes.select(F.col("id").alias("recipe_id"))
    lists = rating_lists(interactions.join(known, "recipe_id", "left_semi"), extra)
    order = ["shard", "recipe_id", "position"]
    lists.withColumn("shard", shard_key(F.col("recipe_id"))).repartitionByRange(*order).sortWithinPartitions(
        *order).write.mode("overwrite").partitionBy("shard").json(f"{path}/ratings")


def lookup_table(df: DataFrame, key: str, path: str, group_bytes: int = 8 * 1024 * 1024) -> None:
    """A Parquet table for reading single keys: rows in key order, small row groups, a bloom filter per group.

    The order gives every group its own range of keys, so a lookup opens the one group that can hold the key;
    the bloom filter spares even that one for most keys that are not there.
    """
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").option(
        f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.block.size", str(group_bytes)).parquet(path)


def small_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def chart_points(points: DataFrame, x: str, y: str, path: str) -> None:
    """All [x, y] pairs of a scatter chart as rows in x order, however many there are."""
    rows = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows.repartitionByRange("x", "y").sortWithinPartitions("x", "y").write.mode("overwrite").json(path)


def chart_values(values: DataFrame, column: str, path: str) -> None:
    """All values of a column as rows in order, nulls left out: the raw form of a histogram's data."""
    rows = values.select(F.col(column).cast("double").alias("value")).filter("value is not null")
    rows.repartitionByRange("value").sortWithinPartitions("value").write.mode("overwrite").json(path)


def chart_pairs(points: DataFrame, x: str, y: str, limit: int) -> DataFrame:
    """{"data": [[x, y], ...], bounds} of a scatter chart as one JSON row.

    A chart of more than ``limit`` points shows every N/limit-th one in x order (``chart_points`` writes
    all); the bounds are those of all points.
    """
    shown = systematic_sample(points.select(x, y), [x, y], limit)
    box = points.agg(F.struct(*[
        f(c).alias(n) for n, f, c in (("xMin", F.min, x), ("xMax", F.max, x), ("yMin", F.min, y), ("yMax", F.max, y))
    ])).scalar()
    entries = F.array_sort(F.collect_list(F.struct("position", F.col(x).alias("x"), F.col(y).alias("y"))))
    held = shown.agg(F.transform(entries, lambda e: F.array(e["x"].cast("double"), e["y"].cast("double"))).alias("data"))
    return held.withColumn("_box", box).select(F.to_json(F.struct("data", "_box.*")).alias("json"))


def chart_series(counts: DataFrame, label: str, value: str, order: Column | str) -> DataFrame:
    """{"labels", "counts", bounds} of a binned chart as one JSON row; one entry per bin."""
    entry = F.struct(F.col("_o"), F.col(label).alias("l"), F.col(value).alias("v"))
    column = order if isinstance(order, Column) else F.col(order)
    held = counts.withColumn("_o", column).agg(
        F.array_sort(F.collect_list(entry)).alias("e"), F.min(value).alias("low"), F.max(value).alias("high")
    )
    return held.select(F.to_json(F.struct(
        F.transform("e", lambda x: x["l"]).alias("labels"), F.transform("e", lambda x: x["v"]).alias("counts"),
        F.col("low").alias("yMin"), F.col("high").alias("yMax"),
    )).alias("json"))
