"""Joins and set operations between records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def lookup(facts: DataFrame, records: DataFrame, fact_key: str, record_key: str,
           defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Every fact with its record's fields; defaults stand in where no record is found."""
    found = records.withColumn("_found", F.lit(True)).withColumnRenamed(record_key, "_key")
    joined = facts.join(found, facts[fact_key] == found["_key"], "left")
    for name, value in (defaults or {}).items():
        joined = joined.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return joined.withColumn("found", F.col("_found").isNotNull()).drop("_found", "_key")


def keep_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id is in the set."""
    return df.join(ids.select(key), key, "left_semi")


def drop_ids(df: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id is not in the set."""
    return df.join(done.select(key), key, "left_anti")


def union_chunks(chunks: Sequence[DataFrame]) -> DataFrame:
    """Row chunks of one table put together by column name."""
    return reduce(lambda left, right: left.unionByName(right), chunks)


def merge_contribs(contribs: Sequence[DataFrame], key: str = "id") -> DataFrame:
    """Extra fields per id from several tables; for a shared field the later table wins.

    A field a later table does not have for an id (or has as null) keeps its earlier value.
    The tables are stacked and grouped once instead of being joined one after another.
    """
    fields = list(dict.fromkeys(c for df in contribs for c in df.columns if c != key))
    stacked = reduce(
        lambda left, right: left.unionByName(right, allowMissingColumns=True),
        [df.withColumn("_turn", F.lit(turn)) for turn, df in enumerate(contribs)],
    )
    latest = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("_turn"))).alias(f) for f in fields]
    return stacked.groupBy(key).agg(*latest)


def families_wide(assignments: DataFrame, families: Sequence[str], value: str = "category") -> DataFrame:
    """One row per id with one column per family."""
    return assignments.groupBy("id").agg(
        *[F.max(F.when(F.col("family") == family, F.col(value))).alias(family) for family in families]
    )


def record_of_shard(df: DataFrame, shard: str, item_id: int) -> DataFrame:
    """One record of a table stored by shard: the shard filter prunes to one partition."""
    return df.filter((F.col("shard") == shard) & (F.col("id") == item_id))


def record_of_table(df: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of a key in a stored table; the comparison is pushed into the scan as it stands."""
    return df.filter(F.col(key) == F.lit(value))
