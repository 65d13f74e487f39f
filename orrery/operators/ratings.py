"""Roll-ups of interactions per record, per year and over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from orrery.config import POPULARITY_EDGES, POPULARITY_LABELS, POPULARITY_TIERS
from orrery.functions.encode import bin_index
from orrery.operators.positions import with_rank_in_group

STARS = (5, 4, 3, 2, 1)


def rated(interactions: DataFrame) -> DataFrame:
    """Interactions that carry a rating (0 stands for none)."""
    return interactions.filter(F.col("rating") > 0)


def starred(interactions: DataFrame) -> DataFrame:
    """Interactions with a rating of 1 to 5."""
    return interactions.filter(F.col("rating").between(1, 5))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def contrib(interactions: DataFrame) -> DataFrame:
    """Average rating (3 places) and rating count of every record with a rating."""
    return (
        rated(interactions)
        .groupBy(F.col("recipe_id").alias("id"))
        .agg(F.round(F.avg("rating"), 3).alias("avg_rating"), F.count(F.lit(1)).alias("n_ratings"))
    )


def partials(interactions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Additive rating sums per key: every roll-up is a sum of these, so they are built once, early."""
    rating = F.col("rating")
    return interactions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.count("date").alias("n_dated"),
        count_where(rating > 0).alias("n_ratings"),
        F.count("rating").alias("n_values"),
        F.sum(F.coalesce(rating, F.lit(0))).cast("long").alias("rating_sum"),
        *[count_where(rating == star).alias(f"count_{star}") for star in STARS],
        count_where(rating == 0).alias("count_no_rating"),
    )


def mean_of(total: str, count: str, places: int) -> Column:
    return F.round(F.when(F.col(count) > 0, F.col(total) / F.col(count)), places)


def year_counts(interactions: DataFrame, key: str = "recipe_id") -> DataFrame:
    """Dated interactions per record and year."""
    dated = interactions.filter(F.col("date").isNotNull())
    return dated.groupBy(key, F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def summary(recipes: DataFrame, interactions: DataFrame, include_zero: bool = False) -> DataFrame:
    """Every record with its interaction counts; records without interactions keep nulls and ``empty``.

    Interactions are grouped before the join, so a record with very many of them is one row by then.
    """
    count = "n_values" if include_zero else "n_ratings"
    per_record = partials(interactions, ["recipe_id"]).select(
        F.col("recipe_id").alias("id"),
        mean_of("rating_sum", count, 4 if include_zero else 3).alias("avg_rating"),
        "n_reviews", "n_dated", "n_ratings", *[f"count_{star}" for star in STARS], "count_no_rating",
    )
    joined = recipes.select("id").distinct().join(per_record, "id", "left")
    return joined.withColumn("empty", F.col("n_reviews").isNull())


def summary_documents(recipes: DataFrame, interactions: DataFrame) -> DataFrame:
    """The summary with its year counts as a map, ordered by year."""
    per_year = (
        year_counts(interactions)
        .groupBy(F.col("recipe_id").alias("id"))
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "n")))).alias("n_per_year"))
    )
    return summary(recipes, interactions).join(per_year, "id", "left")


def unrated_counts(summaries: DataFrame) -> DataFrame:
    """Reviews without a rating, both counted and derived from the totals."""
    return summaries.filter(~F.col("empty")).select(
        "id", "count_no_rating",
        F.greatest(F.lit(0), F.col("n_reviews") - F.col("n_ratings")).alias("derived_no_rating"),
    )


def popularity(interactions: DataFrame, recipes: DataFrame) -> DataFrame:
    """Mean, count and sample deviation of all ratings, 0 included, per named record."""
    per_record = interactions.groupBy("recipe_id").agg(
        F.round(F.avg("rating"), 2).alias("avg_rating"),
        F.count("rating").alias("num_reviews"),
        F.stddev_samp("rating").alias("rating_std"),
    )
    named = recipes.filter(F.col("name").isNotNull()).select(F.col("id").alias("recipe_id"), "name")
    return per_record.join(named, "recipe_id")


def top(df: DataFrame, by: str, count: int, ties: Sequence[str]) -> DataFrame:
    """The first ``count`` rows by a column, largest first; each task keeps only its own best."""
    return df.orderBy(F.col(by).desc_nulls_last(), *ties).limit(count)


def top_records(interactions: DataFrame, recipes: DataFrame, min_count: int = 100, count: int = 10) -> DataFrame:
    """Best average (0 included) among records with enough ratings, with their names."""
    averages = interactions.groupBy("recipe_id").agg(
        F.avg("rating").alias("avg_rating"), F.count("rating").alias("rating_count")
    )
    best = top(averages.filter(F.col("rating_count") >= min_count), "avg_rating", count, ["recipe_id"])
    # ``count`` rows by now
    return F.broadcast(best).join(recipes.select(F.col("id").alias("recipe_id"), "name"), "recipe_id", "left")


def totals(recipes: DataFrame, interactions: DataFrame) -> DataFrame:
    """Record, interaction and user counts and the mean rating in one row."""
    by_user = interactions.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("rating").alias("n_values"), F.sum("rating").alias("s")
    )
    of_users = by_user.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_interactions"),
        F.count("user_id").alias("n_users"),
        F.round(F.sum("s") / F.sum("n_values"), 4).alias("avg_rating"),
    )
    return of_users.withColumn("n_recipes", recipes.agg(F.count(F.lit(1))).scalar())


def monthly(interactions: DataFrame) -> DataFrame:
    """Count and mean per calendar month, labelled by its last day; empty months inside the range appear."""
    dated = interactions.filter(F.col("date").isNotNull())
    month = F.trunc("date", "month")
    per_month = dated.groupBy(month.alias("month")).agg(
        F.count("rating").alias("n"), F.round(F.avg("rating"), 6).alias("avg_rating")
    )
    # one row per month: small however many interactions there are
    spine = per_month.agg(F.min("month").alias("a"), F.max("month").alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("month")
    )
    return spine.join(per_month, "month", "left").select(
        F.last_day("month").alias("month_end"), F.coalesce("n", F.lit(0)).alias("n"), "avg_rating"
    )


def shares(df: DataFrame, key: str, places: int = 4, percent: bool = False) -> DataFrame:
    """Rows per value and their share of all rows; a null value is a bucket of its own."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return with_share(counts, places, percent)


def with_share(counts: DataFrame, places: int = 4, percent: bool = False) -> DataFrame:
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", F.round(F.col("n") * F.lit(100.0 if percent else 1.0) / total, places))


def popularity_buckets(interactions: DataFrame) -> DataFrame:
    """How many records have 1, 2, 3–5, ... interactions."""
    per_record = interactions.groupBy("recipe_id").agg(F.count(F.lit(1)).alias("n"))
    bucket = bin_index(F.col("n"), POPULARITY_EDGES)
    counts = per_record.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    labels = F.array(*[F.lit(label) for label in POPULARITY_LABELS])
    tiers = F.array(*[F.lit(tier) for tier in POPULARITY_TIERS])
    return with_share(counts, 2, percent=True).select(
        "bucket", F.element_at(labels, F.col("bucket") + 1).alias("label"), "n", "pct",
        F.element_at(tiers, F.col("bucket") + 1).alias("tier"),
    )


def lifecycle(interactions: DataFrame) -> DataFrame:
    """Volume, users, averages with and without 0, five-star and zero shares per year.

    Grouped by (year, user) first: the distinct user count of a year is then a row count,
    and no year is a single group of raw rows.
    """
    dated = interactions.filter(F.col("date").isNotNull()).withColumn("year", F.year("date"))
    per_user = dated.groupBy("year", "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rating").alias("s"),
        count_where(F.col("rating") > 0).alias("n_rated"),
        count_where(F.col("rating") == 5).alias("n_five"), count_where(F.col("rating") == 0).alias("n_zero"),
    )
    n, zero = F.sum("n"), F.sum("n_zero")
    return per_user.groupBy("year").agg(
        n.alias("n"),
        F.count("user_id").alias("users"),
        F.round(F.sum("s") / n, 4).alias("avg_with"),
        F.round(F.sum("s") / F.nullif(F.sum("n_rated"), F.lit(0)), 4).alias("avg_without"),
        F.round(F.sum("n_five") * 100.0 / n, 1).alias("pct5"),
        zero.alias("n_zeros"),
        F.round(zero * 100.0 / n, 2).alias("pct_zero"),
    )


def year_spine(interactions: DataFrame, records: DataFrame, first: int, last: int) -> DataFrame:
    """Interactions per record and year for every year of a fixed range, zero where there are none."""
    years = records.select(F.col("id").alias("recipe_id")).distinct().select(
        "recipe_id", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year")
    )
    counted = year_counts(interactions)
    return years.join(counted, ["recipe_id", "year"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rating_lists(interactions: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Ratings of a record in (date, rating, review) order as positioned rows.

    Rows instead of one array per record: a record with a third of all ratings would not fit
    in one array, and its rows are spread over as many tasks as they need.
    """
    kept = starred(interactions).withColumn("date", F.coalesce(F.col("date").cast("string"), F.lit("")))
    order = ["date", "rating", *extra]
    return with_rank_in_group(kept.select("recipe_id", *order), ["recipe_id"], order)
