"""Documents of categories: one nested row per category, and its items as rows beside it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from orrery.functions.text import slug
from orrery.operators.categories import items_per_category, rollup, rollup_years, secondary_distribution
from orrery.operators.positions import with_rank_in_group
from orrery.operators.ratings import STARS


def category_documents(assignments: DataFrame, interactions: DataFrame, classes: DataFrame,
                       secondary: Sequence[str]) -> DataFrame:
    """(family, category, recipe_count, reviews, distributions) of every declared category.

    ``reviews`` has the mean rating, the number of reviews, the stars and ``n_per_year``; ``distributions``
    maps every secondary family to its labels and their counts, zeros included. Years and declared
    labels bound a document; a category without records has zeros and no mean.
    """
    head = rollup(assignments, interactions, classes)
    per_year = rollup_years(assignments, interactions).groupBy("family", "category").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "n")))).alias("n_per_year"))
    per_label = secondary_distribution(assignments, classes, secondary).groupBy("family", "category", "secondary").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("labels"))
    spread = per_label.groupBy("family", "category").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("secondary", F.to_json("labels").alias("labels"))))).alias("held"))
    # maps do not compare, so they travel as text until every family is in place
    spread = spread.select("family", "category", F.transform_values(
        "held", lambda _, labels: F.from_json(labels, "map<string,bigint>")).alias("distributions"))
    joined = head.join(per_year, ["family", "category"], "left").join(spread, ["family", "category"], "left")
    none = F.create_map().cast("map<int,bigint>")
    reviews = F.struct("avg_rating", "total_reviews", *[f"count_{star}" for star in sorted(STARS, reverse=True)],
                       F.coalesce("n_per_year", none).alias("n_per_year"))
    return joined.select("family", "category", "recipe_count", reviews.alias("reviews"), "distributions")


def category_items(assignments: DataFrame, items: DataFrame) -> DataFrame:
    """(family, category, position, ingredient, n): the items of every category, most frequent first.

    Rows, not one list: a category may hold any number of items.
    """
    counted = items_per_category(assignments, items).withColumn("_least", -F.col("n"))
    ranked = with_rank_in_group(counted, ["family", "category"], ["_least", "ingredient"])
    return ranked.select("family", "category", "position", "ingredient", "n")


def with_folder(df: DataFrame) -> DataFrame:
    """Rows of categories with the ``slug`` their files are stored under."""
    return df.withColumn("slug", slug(F.col("category")))
