"""Assignments, class lists and roll-ups per category."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from orrery.config import BinEncoder, RangeEncoder
from orrery.functions.encode import bin_assignment, bin_vector, encode_range, numeric_value
from orrery.functions.tags import quoted
from orrery.operators.ratings import STARS, mean_of, partials


def class_table(spark: SparkSession, classes: Mapping[str, Sequence[str]]) -> DataFrame:
    """(family, idx, label) of declared class lists."""
    rows = ", ".join(
        f"({quoted(family)}, {idx}, {quoted(label)})"
        for family, labels in classes.items() for idx, label in enumerate(labels)
    )
    # literal rows: the optimizer knows their size and broadcasts them by itself
    return spark.sql(f"SELECT * FROM VALUES {rows} AS classes(family, idx, label)")


def _per_family(records: DataFrame, encoders: Sequence[BinEncoder], encode, shape: str) -> DataFrame:
    """(id, family, of) with ``encode`` of every encoder, all of them in one scan of the records."""
    texts = {name for name, kind in records.dtypes if kind == "string"}
    wide = records.select("id", *[
        encode(numeric_value(F.col(e.field), e.field in texts), e).cast(shape).alias(e.field) for e in encoders
    ])
    rows = F.array(*[F.struct(F.lit(e.field).alias("family"), F.col(e.field).alias("of")) for e in encoders])
    return wide.select("id", F.explode(rows).alias("row")).select("id", "row.family", "row.of")


def assign_bins(records: DataFrame, encoders: Sequence[BinEncoder]) -> DataFrame:
    """(id, family, category, score, bin) of every record under every encoder."""
    long = _per_family(records, encoders, bin_assignment, "struct<category:string,score:double,bin:int>")
    return long.select("id", "family", "of.category", "of.score", "of.bin")


def encode_features(records: DataFrame, encoders: Sequence[BinEncoder]) -> DataFrame:
    """(id, family, vector) of every record under every encoder."""
    return _per_family(records, encoders, bin_vector, "array<double>").withColumnRenamed("of", "vector")


def scale_range(records: DataFrame, encoder: RangeEncoder, source: DataFrame | None = None) -> DataFrame:
    """(id, vector) scaled by the range over all source values."""
    text = dict(records.dtypes)[encoder.field] == "string"
    value = numeric_value(F.col(encoder.field), text)
    of = source if source is not None else records
    bounds = of.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high"))).scalar()
    return records.select("id", encode_range(value, encoder, bounds["low"], bounds["high"]).alias("vector"))


def zero_filled(counts: DataFrame, classes: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Every declared class with its counts, 0 where nothing was counted."""
    joined = classes.join(counts, list(keys), "left")
    for value in values:
        joined = joined.withColumn(value, F.coalesce(F.col(value), F.lit(0)))
    return joined


def rollup(assignments: DataFrame, interactions: DataFrame, classes: DataFrame | None = None,
           include_zero: bool = False) -> DataFrame:
    """Records, reviews, star counts and mean rating per category of every family.

    The mean is over interactions. They are summed per record before the join, so neither a
    hot record nor the number of families multiplies raw rows.
    """
    sums = ["n_reviews", "n_dated", "n_ratings", "n_values", "rating_sum", *[f"count_{s}" for s in STARS]]
    per_record = partials(interactions, ["recipe_id"]).withColumnRenamed("recipe_id", "id")
    member = assignments.filter(F.col("category").isNotNull()).select("id", "family", "category")
    grouped = member.join(per_record, "id", "left").groupBy("family", "category").agg(
        F.count(F.lit(1)).alias("recipe_count"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in sums],
    )
    if classes is not None:
        listed = classes.select("family", F.col("label").alias("category"))
        grouped = zero_filled(grouped, listed, ["family", "category"], ["recipe_count", *sums])
    return grouped.select(
        "family", "category", "recipe_count",
        mean_of("rating_sum", "n_values" if include_zero else "n_ratings", 4).alias("avg_rating"),
        F.col("n_dated" if include_zero else "n_reviews").alias("total_reviews"),
        *[f"count_{star}" for star in STARS],
    )


def rollup_years(assignments: DataFrame, interactions: DataFrame) -> DataFrame:
    """Dated interactions per category and year."""
    per_record = (
        interactions.filter(F.col("date").isNotNull())
        .groupBy(F.col("recipe_id").alias("id"), F.year("date").alias("year"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    member = assignments.filter(F.col("category").isNotNull()).select("id", "family", "category")
    return member.join(per_record, "id").groupBy("family", "category", "year").agg(F.sum("n").alias("n"))


def items_per_category(assignments: DataFrame, items: DataFrame) -> DataFrame:
    """Item occurrences per category; an item listed twice by a record counts twice."""
    per_record = items.groupBy("id", "ingredient").agg(F.count(F.lit(1)).alias("n"))
    member = assignments.filter(F.col("category").isNotNull()).select("id", "family", "category")
    return member.join(per_record, "id").groupBy("family", "category", "ingredient").agg(F.sum("n").alias("n"))


def secondary_distribution(assignments: DataFrame, classes: DataFrame, families: Sequence[str]) -> DataFrame:
    """Records of each category by the label they have in every other family, zero-filled.

    One row per record carries all of its labels (one per family), so pairing the families is
    an explode of that short array and not a join of the assignments with themselves.
    """
    label = F.struct("family", "category")
    per_record = (
        assignments.filter(F.col("category").isNotNull())
        .groupBy("id").agg(F.array_sort(F.collect_set(label)).alias("labels"))
        .groupBy("labels").agg(F.count(F.lit(1)).alias("n"))
    )
    pairs = per_record.select("labels", "n", F.explode("labels").alias("p")).select(
        F.col("p.family").alias("family"), F.col("p.category").alias("category"), "n",
        F.explode("labels").alias("s"),
    )
    counted = pairs.groupBy(
        "family", "category", F.col("s.family").alias("secondary"), F.col("s.category").alias("label")
    ).agg(F.sum("n").alias("n"))
    primary = classes.select("family", F.col("label").alias("category"))
    second = classes.filter(F.col("family").isin(list(families))).select(
        F.col("family").alias("secondary"), "label"
    )
    # the class lists are declared, so their pairs are one short array per label
    labels = second.agg(F.collect_list(F.struct("secondary", "label"))).scalar()
    spine = primary.withColumn("s", F.explode(labels)).select("family", "category", "s.secondary", "s.label")
    return zero_filled(counted, spine, ["family", "category", "secondary", "label"], ["n"])


def label_maps(assignments: DataFrame) -> DataFrame:
    """The family → category map of every record."""
    entry = F.struct("family", "category")
    return assignments.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_set(entry))).alias("labels"))


def facet(assignments: DataFrame, classes: DataFrame, family: str) -> DataFrame:
    """Records per label of one family, every declared label listed."""
    counted = (
        assignments.filter(F.col("family") == family)
        .groupBy(F.col("category").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    )
    return zero_filled(counted, classes.filter(F.col("family") == family).select("idx", "label"), ["label"], ["n"])


def drill_down(assignments: DataFrame, classes: DataFrame, family: str, within: tuple[str, str]) -> DataFrame:
    """Facet counts of one family over the records that have a label of another family.

    Both families are read in one pass and folded per record, so nothing is joined with itself.
    """
    outer_family, outer_label = within
    both = assignments.filter(F.col("family").isin(family, outer_family)).groupBy("id").agg(
        F.max(F.when(F.col("family") == family, F.col("category"))).alias("label"),
        F.max(F.when(F.col("family") == outer_family, F.col("category"))).alias("outer"),
    )
    counted = both.filter(F.col("outer") == outer_label).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return zero_filled(counted, classes.filter(F.col("family") == family).select("idx", "label"), ["label"], ["n"])


def highlighted(assignments: DataFrame, family: str, labels: Sequence[str]) -> DataFrame:
    """How many records carry one of several labels of a family."""
    return assignments.filter(F.col("family") == family).agg(
        F.count(F.when(F.col("category").isin(list(labels)), 1)).alias("n_visible"),
        F.count(F.lit(1)).alias("n_total"),
    )


def with_class_index(assignments: DataFrame, classes: DataFrame) -> DataFrame:
    """Assignments with their class index; an unknown label has index 0."""
    listed = classes.select("family", F.col("label").alias("category"), "idx")
    joined = assignments.join(listed, ["family", "category"], "left")
    return joined.withColumn("idx", F.coalesce("idx", F.lit(0)))


def ranked_in_group(df: DataFrame, group: Sequence[str], order: Sequence, name: str = "rank") -> DataFrame:
    """1-based rank inside groups that a class or vocabulary list bounds."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
