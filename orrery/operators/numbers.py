"""Histograms and summary statistics of one numeric column."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from orrery.config import DESCRIBE_PERCENTILES
from orrery.session import cut

SPLITS = 1024


def histogram(df: DataFrame, column: str, bins: int, low: float | None = None, high: float | None = None,
              cap: float | None = None) -> DataFrame:
    """Equal-width bins over the (clipped) value range, the last one closed, empty bins included."""
    value = F.col(column).cast("double")
    value = F.least(value, F.lit(float(cap))) if cap is not None else value
    values = df.select(value.alias("v")).filter(F.col("v").isNotNull())
    if low is not None:
        values = values.filter(F.col("v") >= low)
    if high is not None:
        values = values.filter(F.col("v") <= high)
    first = F.coalesce(F.lit(low).cast("double"), F.min("v"))
    last = F.coalesce(F.lit(high).cast("double"), F.max("v"))
    width = F.when(last > first, (last - first) / bins).otherwise(1.0)
    bounds = values.agg(first.alias("lo"), width.alias("width"))
    at = bounds.select(F.struct("lo", "width")).scalar()
    index = F.least(F.floor((F.col("v") - at["lo"]) / at["width"]), F.lit(bins - 1)).cast("int")
    counted = values.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = bounds.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "width")
    return spine.join(counted, "bin", "left").select(
        "bin",
        F.round(F.col("lo") + F.col("bin") * F.col("width"), 6).alias("lo"),
        F.round(F.col("lo") + (F.col("bin") + 1) * F.col("width"), 6).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(v, n) of the values of a column, nulls left out."""
    return df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull()).groupBy("v").agg(
        F.count(F.lit(1)).alias("n")
    )


def at_ranks(counted: DataFrame, ranks: Sequence[int]) -> dict[int, float]:
    """The values at 0-based ranks of (v, n) rows, by narrowing the range around each rank.

    A round splits the open ranges evenly, counts the pieces (``SPLITS`` rows a range, summed in the
    tasks) and goes on in the piece a rank falls into, between the least and the largest value found
    there. Nothing is sorted and no value moves; a range ends when it holds one value.
    """
    head = counted.agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
    found: dict[int, float] = {}
    open_ranks = {rank: (head["low"], head["high"], 0) for rank in ranks}
    while open_ranks:
        for rank, (low, high, _) in list(open_ranks.items()):
            if low == high:
                found[rank] = low
                del open_ranks[rank]
        bounds = sorted({(low, high, before) for low, high, before in open_ranks.values()})
        if not bounds:
            break
        piece, holds = F.lit(None).cast("struct<at:int,piece:int>"), F.lit(False)
        for at, (low, high, _) in enumerate(bounds):
            inside = F.col("v").between(F.lit(low), F.lit(high))
            half = 0.5 if math.isinf(high - low) else 1  # a range wider than the largest number
            share = (F.col("v") * half - F.lit(low * half)).cast("double") / F.lit(float(high * half - low * half))
            mine = F.struct(F.lit(at).alias("at"), F.least(F.floor(share * SPLITS), F.lit(SPLITS - 1)).cast("int").alias("piece"))
            piece, holds = F.when(inside, mine).otherwise(piece), holds | inside
        pieces = counted.filter(holds).groupBy(piece.alias("piece")).agg(
            F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        rows = sorted(pieces.select("piece.at", "low", "high", "n").collect(), key=lambda r: (r["at"], r["low"]))
        for rank, (low, high, before) in list(open_ranks.items()):
            at = bounds.index((low, high, before))
            for row in rows:
                if row["at"] != at:
                    continue
                if rank < before + row["n"]:
                    open_ranks[rank] = (row["low"], row["high"], before)
                    break
                before += row["n"]
    return found


def quantiles(counted: DataFrame, percents: Sequence[float]) -> DataFrame:
    """Exact linear-interpolation percentiles of (v, n) rows in one row; nulls without rows."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    places = [p / 100.0 * (total - 1) for p in percents]
    ranks = {rank for place in places for rank in (math.floor(place), math.ceil(place))} if total else set()
    values = at_ranks(cut(counted), sorted(ranks)) if ranks else {}
    points = []
    for percent, place in zip(percents, places, strict=True):
        low, high, at = math.floor(place), math.ceil(place), None
        if total:
            at = values[low] if low == high else values[low] * (high - place) + values[high] * (place - low)
        points.append(F.lit(at).cast("double").alias(f"p{percent:g}"))
    return counted.sparkSession.range(1).select(*points)


def describe(df: DataFrame, column: str, cap: float | None = None,
             percents: Sequence[float] = DESCRIBE_PERCENTILES, accuracy: int | None = None) -> DataFrame:
    """Count, range, mean, population deviation and percentiles, and how much lies above the cap.

    The column is read once into its value counts; everything else is taken from those. The cap
    is the 99th percentile if none is given. With ``accuracy`` the percentiles come from a
    bounded sketch instead of being exact.
    """
    counted = cut(value_counts(df, column))
    if accuracy is None:
        points = quantiles(counted, percents)
    else:
        raw = df.select(F.col(column).cast("double").alias("v"))
        points = raw.agg(*[
            F.expr(f"percentile_approx(v, {p / 100.0!r}, {accuracy})").alias(f"p{p:g}") for p in percents
        ]) if percents else counted.limit(0)
    stats = counted.agg(
        F.sum("n").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"),
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
    )
    row = stats.withColumn("p", points.select(F.struct("*")).scalar())
    if cap is None and 99 not in percents:
        raise ValueError("without a cap the 99th percentile must be among the percentiles")
    limit = F.lit(float(cap)) if cap is not None else F.col("p.p99")
    row = cut(row.select("n", "min", "max", "mean", "p.*", limit.alias("cap")))
    at = row.select(F.struct("mean", "cap")).scalar()
    rest = counted.agg(F.struct(
        F.sqrt(F.sum((F.col("v") - at["mean"]) * (F.col("v") - at["mean"]) * F.col("n")) / F.sum("n")).alias("std"),
        F.coalesce(F.sum(F.when(F.col("v") > at["cap"], F.col("n"))), F.lit(0)).alias("n_above"),
    )).scalar()
    return row.withColumn("std", rest["std"]).withColumn("n_above", rest["n_above"]).withColumn(
        "pct_above", F.col("n_above") * 100.0 / F.col("n")
    )
