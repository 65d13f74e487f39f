"""Visibility counts, facet order and sampling of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.config import SYSTEMATIC_SAMPLE
from orrery.operators.density import NOISE
from orrery.operators.numbers import at_ranks
from orrery.operators.positions import with_position
from orrery.session import cut

UNRATED = -1.0


def passes_filter(rating: Column, low: float, high: float) -> Column:
    """Display filter: a point without a rating always shows."""
    return (rating < 0) | rating.between(low, high)


def counts_in_filter(rating: Column, low: float, high: float) -> Column:
    """Counting filter: a point without a rating is not counted."""
    return (rating >= 0) & rating.between(low, high)


def visible_stats(points: DataFrame, low: float, high: float) -> DataFrame:
    """Shown points, counted points and clusters among the shown, in one row."""
    shown = passes_filter(F.col("rating"), low, high)
    counted = counts_in_filter(F.col("rating"), low, high)
    per_cluster = points.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(shown, 1)).alias("shown"), F.count(F.when(counted, 1)).alias("counted")
    )
    return per_cluster.agg(
        F.sum("n").alias("n_total"), F.sum("shown").alias("n_shown"), F.sum("counted").alias("n_counted"),
        F.count(F.when((F.col("shown") > 0) & (F.col("cluster") != NOISE), 1)).alias("n_clusters"),
    )


def facet_order(mode: str) -> list[Column]:
    """Sort keys of a facet list: ``count``, ``reversed``, ``natural`` or ``name``; noise is first by name."""
    return {
        "count": [F.col("n").desc(), F.col("idx")],
        "reversed": [F.col("idx").desc()],
        "natural": [F.col("idx")],
        "name": [(F.col("label") != "Unclustered"), F.lower("label"), F.col("idx")],
    }[mode]


def facet_positions(facets: DataFrame, mode: str) -> DataFrame:
    """Facet rows with their place in the list; one row per declared label."""
    order = Window.partitionBy("family").orderBy(*facet_order(mode))
    return facets.withColumn("place", F.row_number().over(order))


def first_rows(df: DataFrame, order: str, count: int) -> DataFrame:
    return df.orderBy(order).limit(count)


def _draw(key: str, seed: int) -> Column:
    """A number below 2 ** 60 that depends on the key and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def sample(df: DataFrame, count: int, seed: int, key: str = "id") -> DataFrame:
    """Uniform sample without replacement, the same for the same seed on any cluster.

    The rows with the ``count`` smallest draws: their largest is found by counting, so the sample is a filter
    of the rows where they are, however many it takes. Rows of equal keys have equal draws, of which
    any that are wanted are taken.
    """
    if count <= 0:
        return df.limit(0)
    drawn = df.withColumn("_draw", _draw(key, seed))
    counted = cut(drawn.groupBy(F.col("_draw").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    if (counted.agg(F.sum("n")).first()[0] or 0) <= count:
        return df
    last = at_ranks(counted, [count - 1])[count - 1]
    below = counted.filter(F.col("v") < last).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ties = drawn.filter(F.col("_draw") == last).limit(count - below)
    return drawn.filter(F.col("_draw") < last).unionByName(ties).drop("_draw")


def one_at_random(df: DataFrame, seed: int, key: str = "id") -> DataFrame:
    return df.orderBy(_draw(key, seed), key).limit(1)


def sample_per_group(df: DataFrame, group: str, count: int, seed: int, key: str = "id") -> DataFrame:
    """At most ``count`` random rows of every group; tasks drop the rest before the shuffle."""
    order = Window.partitionBy(group).orderBy(_draw(key, seed), key)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def systematic_sample(df: DataFrame, order: list, count: int = SYSTEMATIC_SAMPLE) -> DataFrame:
    """Every ⌊i·N/count⌋-th row of the order; all rows when there are no more than ``count``."""
    placed = with_position(df, order)
    held = placed.withColumn("_n", df.agg(F.count(F.lit(1))).scalar())
    step = F.ceil(F.col("position") * F.lit(count) / F.col("_n")).cast("long")
    hit = (step < count) & (F.floor(step * F.col("_n") / F.lit(count)).cast("long") == F.col("position"))
    return held.filter((F.col("_n") <= count) | hit).drop("_n")
