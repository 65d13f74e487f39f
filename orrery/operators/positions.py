"""Global and per-group positions of sorted rows without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.session import cut

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def _laid_out(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Range-partitioned, sorted rows with their partition and their place in it.

    Range bounds are sampled, so the rows are checkpointed before anything is counted:
    a second sampling could place a row on another side of a bound.
    """
    laid = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    marked = laid.withColumn("_mark", F.monotonically_increasing_id())
    return (
        marked.withColumn("_part", F.shiftright("_mark", _LOCAL_BITS))
        .withColumn("_local", F.col("_mark").bitwiseAND(F.lit(2**_LOCAL_BITS - 1)))
        .drop("_mark")
    )


def _rows_before(per_part: DataFrame, group: Sequence[str]) -> DataFrame:
    """Running row count over the earlier partitions, over one small row per partition (and group)."""
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def with_position(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """0-based position of every row in the total order ``order``."""
    laid = _laid_out(df, order)
    offsets = _rows_before(laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")), []).drop("_n")
    placed = laid.join(F.broadcast(offsets), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


def with_running_total(df: DataFrame, order: Sequence[str | Column], weight: str, name: str = "before") -> DataFrame:
    """Sum of ``weight`` over all rows earlier in the order."""
    laid = _laid_out(df, order)
    offsets = _rows_before(laid.groupBy("_part").agg(F.sum(weight).alias("_n")), []).drop("_n")
    earlier = Window.partitionBy("_part").orderBy("_local").rowsBetween(Window.unboundedPreceding, -1)
    summed = laid.withColumn("_sum", F.coalesce(F.sum(weight).over(earlier), F.lit(0)))
    placed = summed.join(F.broadcast(offsets), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_sum")).drop("_part", "_local", "_before", "_sum")


def with_rank_in_group(df: DataFrame, group: Sequence[str], order: Sequence[str | Column],
                       name: str = "position") -> DataFrame:
    """0-based position of every row inside its group, however large one group is.

    A group may span many partitions. Only the first group of a partition can have begun
    earlier, so the offsets to add are at most one row per partition and can be broadcast.
    """
    laid = _laid_out(df, [*group, *order])
    local = Window.partitionBy("_part", *group).orderBy("_local")
    ranked = laid.withColumn("_rank", F.row_number().over(local) - 1)
    per_part = laid.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_local").alias("_first"))
    last_of_part = per_part.groupBy("_part").agg(F.max("_first").alias("_last"))
    # groups that touch the edge of a partition: at most two per partition
    edge = per_part.join(F.broadcast(last_of_part), "_part").filter(
        (F.col("_first") == 0) | (F.col("_first") == F.col("_last"))
    )
    offsets = _rows_before(edge, group).filter("_before > 0").select("_part", *group, "_before")
    keys = [F.col(f"r.{key}").eqNullSafe(F.col(f"o.{key}")) for key in ("_part", *group)]
    condition = keys[0]
    for key in keys[1:]:
        condition = condition & key
    joined = ranked.alias("r").join(F.broadcast(offsets.alias("o")), condition, "left")
    placed = joined.select(
        *[F.col(f"r.{column}") for column in df.columns],
        (F.col("r._rank") + F.coalesce(F.col("o._before"), F.lit(0))).alias(name),
    )
    return placed
