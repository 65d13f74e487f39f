"""Item (ingredient) frequencies, ratings and co-occurrence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from orrery.operators.ratings import partials
from orrery.session import cut

LIGHT = 256  # items of a record that are handled as one combination


def item_counts(items: DataFrame, stop_words: Sequence[str] = ()) -> DataFrame:
    """Occurrences of every item over all records."""
    kept = items.filter(~F.col("ingredient").isin(list(stop_words))) if stop_words else items
    return kept.groupBy("ingredient").agg(F.count(F.lit(1)).alias("n"))


def most_common(items: DataFrame, count: int, stop_words: Sequence[str] = ()) -> DataFrame:
    return item_counts(items, stop_words).orderBy(F.col("n").desc(), "ingredient").limit(count)


def previews(items: DataFrame, limit: int) -> DataFrame:
    """(id, items, more): the first ``limit`` distinct items of a record by name, and how many more it has.

    Only the shown items of a record are ever put in one array.
    """
    distinct = items.select("id", "ingredient").distinct()
    order = Window.partitionBy("id").orderBy("ingredient")
    shown = distinct.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= limit)
    lists = shown.groupBy("id").agg(F.array_sort(F.collect_list("ingredient")).alias("items"))
    counts = distinct.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    return lists.join(counts, "id").select("id", "items", F.greatest(F.lit(0), F.col("_n") - limit).alias("more"))


def item_ratings(items: DataFrame, interactions: DataFrame, count: int = 25) -> DataFrame:
    """Mean rating and interaction count of the most common items (0 ratings and repeats included).

    Interactions are summed per record and repeats per (record, item) before they meet, so the
    join never holds interactions times items.
    """
    best = most_common(items, count).select("ingredient")
    uses = items.join(F.broadcast(best), "ingredient", "left_semi").groupBy("id", "ingredient").agg(
        F.count(F.lit(1)).alias("times")
    )
    rated = partials(interactions, ["recipe_id"]).select(
        F.col("recipe_id").alias("id"), "n_values", "rating_sum"
    )
    weighted = uses.join(rated, "id").groupBy("ingredient").agg(
        F.sum(F.col("times") * F.col("rating_sum")).alias("total"),
        F.sum(F.col("times") * F.col("n_values")).alias("n"),
    )
    return weighted.filter("n > 0").select(
        "ingredient", F.round(F.col("total") / F.col("n"), 6).alias("avg_rating"), "n"
    )


def pair_counts(items: DataFrame, vocabulary: DataFrame, item: str = "tag", as_set: bool = True, light: int = LIGHT) -> DataFrame:
    """How many records hold item a and item b, for every ordered pair a ≠ b of a vocabulary.

    Rows outside the vocabulary go first; a record then has one entry per item (with its
    multiplicity when repeats count). Records of up to ``light`` items are counted once per distinct
    combination. A larger record is never one value: its items meet in pieces of about ``light``
    left items, so neither the record nor its pairs are in one task.
    """
    held = items.join(vocabulary.select(item).distinct(), item, "left_semi")
    if as_set:
        counted = held.select("id", item).distinct().withColumn("times", F.lit(1).cast("long"))
    else:
        counted = held.groupBy("id", item).agg(F.count(F.lit(1)).alias("times"))
    counted = cut(counted.withColumnRenamed(item, "item"))
    sizes = counted.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    few = counted.join(sizes.filter(F.col("n") <= light).select("id"), "id")
    pairs = paired(combinations(few)).unionByName(_long_pairs(counted, sizes.filter(F.col("n") > light), light))
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def combinations(counted: DataFrame) -> DataFrame:
    """(held, records): every distinct combination of (item, times) and how many records have it."""
    return (
        counted.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("item", "times"))).alias("held"))
        .groupBy("held").agg(F.count(F.lit(1)).alias("records"))
    )


def _long_pairs(counted: DataFrame, large: DataFrame, light: int) -> DataFrame:
    """(a, b, n) of the records (id, n) in ``large``, joined piece by piece."""
    pieces = large.select("id", F.ceil(F.col("n") / light).cast("int").alias("pieces"))
    held = counted.join(pieces, "id")
    piece = F.pmod(F.xxhash64("item"), F.col("pieces")).cast("int")
    left = held.select("id", piece.alias("piece"), F.col("item").alias("a"), F.col("times").alias("x"))
    right = held.select(
        "id", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("item").alias("b"), F.col("times").alias("y"))
    met = left.join(right, ["id", "piece"]).filter("a <> b")
    return met.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("n"))


def paired(combos: DataFrame) -> DataFrame:
    """(a, b, n) for every ordered pair inside the combinations, weighted by their records."""
    left = combos.filter(F.size("held") > 1).select("held", "records", F.explode("held").alias("a"))
    both = left.select("a", "records", F.explode("held").alias("b")).filter(F.col("a.item") != F.col("b.item"))
    weight = F.col("a.times") * F.col("b.times") * F.col("records")
    return both.groupBy(F.col("a.item").alias("a"), F.col("b.item").alias("b")).agg(F.sum(weight).alias("n"))


def pair_matrix(items: DataFrame, count: int) -> DataFrame:
    """Dense co-occurrence of the most common items, repeats multiplying, zeros included."""
    best = cut(most_common(items, count).select("ingredient"))
    counted = pair_counts(items, best, "ingredient", as_set=False)
    names = best.agg(F.collect_list("ingredient")).scalar()  # ``count`` names
    cells = best.select(F.col("ingredient").alias("a"), F.explode(names).alias("b"))
    return cells.join(counted, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
