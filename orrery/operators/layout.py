"""Coordinates, Z-order chunks and the exploration table."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from orrery.config import CHUNK_BYTES, CHUNK_SIZE, DEFAULT_CATEGORY_WEIGHT
from orrery.functions import geometry as G
from orrery.functions.vectors import weighted_concat
from orrery.operators.positions import with_position, with_running_total

AXES = ("x", "y", "z")
RANGE_CHUNKS = 1024


def augmented(embeddings: DataFrame, features: DataFrame, weights: Mapping[str, float],
              families: Sequence[str], fallback: float = DEFAULT_CATEGORY_WEIGHT) -> DataFrame:
    """(id, vector): embedding and the feature vectors of every family, weighted and joined on id."""
    per_id = features.filter(F.col("family").isin(list(families))).groupBy("id").agg(
        *[F.first(F.when(F.col("family") == name, F.col("vector")), ignorenulls=True).alias(name) for name in families]
    )
    joined = embeddings.join(per_id, "id")
    vector = weighted_concat(F.col("embedding"), {name: F.col(name) for name in families}, weights, fallback)
    return joined.select("id", vector.alias("vector"))


def project(vectors: DataFrame, dims: int = 3) -> DataFrame:
    """(id, x, y[, z]): the leading principal components, each with its largest loading positive.

    A distributed linear projection: it keeps large distances, not neighbourhoods, unlike the
    non-linear layouts it stands in for.
    """
    held = vectors.select("id", array_to_vector("vector").alias("features"))
    model = PCA(k=dims, inputCol="features", outputCol="projected").fit(held)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[np.argmax(np.abs(loadings[:, i])), i] >= 0 else -1.0 for i in range(dims)]
    placed = model.transform(held).select("id", vector_to_array("projected").alias("at"))
    return placed.select("id", *[
        (F.col("at")[i] * F.lit(signs[i])).alias(axis) for i, axis in enumerate(AXES[:dims])
    ])


def bounds(points: DataFrame) -> DataFrame:
    """Range, width and middle of every axis and the point count in one row."""
    columns = [F.count(F.lit(1)).alias("total")]
    for axis in AXES:
        low, high = F.min(axis), F.max(axis)
        columns += [
            low.alias(f"min_{axis}"), high.alias(f"max_{axis}"),
            (high - low).alias(f"extent_{axis}"), ((high + low) / 2).alias(f"centre_{axis}"),
        ]
    return points.agg(*columns)


def _with_bounds(points: DataFrame) -> DataFrame:
    limits = [f(a).alias(f"_{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max), ("mid", F.avg))]
    held = points.withColumn("_box", points.agg(F.struct(*limits)).scalar())
    return held.select(*points.columns, "_box.*")


def _span() -> Column:
    return F.greatest(*[F.col(f"_hi_{a}") - F.col(f"_lo_{a}") for a in AXES])


def recentred(points: DataFrame) -> DataFrame:
    """Coordinates around their centroid."""
    held = _with_bounds(points)
    rest = [c for c in points.columns if c not in AXES]
    return held.select(*rest, *[(F.col(a) - F.col(f"_mid_{a}")).alias(a) for a in AXES])


def normalised(points: DataFrame, half_width: float = 0.5) -> DataFrame:
    """Coordinates scaled by the widest axis to [-half_width, half_width]."""
    held = _with_bounds(points)
    rest = [c for c in points.columns if c not in AXES]
    return held.select(*rest, *[
        G.centred(F.col(a), F.col(f"_lo_{a}"), F.col(f"_hi_{a}"), _span(), half_width).alias(a) for a in AXES
    ])


def quantised(points: DataFrame, bits: int = 16) -> DataFrame:
    """Integer coordinates over one common range."""
    held = _with_bounds(points)
    rest = [c for c in points.columns if c not in AXES]
    return held.select(*rest, *[
        G.quantised(F.col(a), F.col(f"_lo_{a}"), _span(), bits).alias(f"q{a}") for a in AXES
    ])


def with_morton(points: DataFrame) -> DataFrame:
    """Points with the Z-order code of their place in the bounding box."""
    held = _with_bounds(points)
    steps = [G.grid_step(F.col(a), F.col(f"_lo_{a}"), F.col(f"_hi_{a}")) for a in AXES]
    return held.select(*points.columns, G.morton(*steps).alias("morton"))


def z_ordered(points: DataFrame, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Points with their Z-order position and the chunk it falls in."""
    placed = with_position(with_morton(points), ["morton", "id"])
    chunk = F.floor(F.col("position") / chunk_size).cast("long")
    return placed.withColumn("chunk_id", chunk)


def byte_chunks(rows: DataFrame, order: Sequence[str | Column], size: str,
                limit: int = CHUNK_BYTES, range_chunks: int = RANGE_CHUNKS) -> DataFrame:
    """Rows with (range, chunk): a chunk ends before the row that would take it over ``limit`` bytes.

    A range is a stretch of ``range_chunks * limit`` bytes of the whole order: a row belongs to the one
    that its first byte falls into. Chunks are filled in order inside a range and numbered from 0
    there, so neither depends on partitions, and anything up to one range is chunked as a whole. A
    row above the limit is a chunk of its own; a null size counts as 0.
    """
    names = rows.columns
    sized = rows.withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
    placed = with_running_total(sized, order, "_size", "_start")
    placed = placed.withColumn("range", F.floor(F.col("_start") / (limit * range_chunks)).cast("long"))
    ranged = placed.repartition("range").sortWithinPartitions("range", "_start", *order)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, chunk, used, rows_in = None, 0, 0, 0
        for batch in batches:
            numbers = np.empty(len(batch), dtype=np.int64)
            of_row, sizes = batch["range"].to_numpy(), batch["_size"].to_numpy(dtype=np.int64)
            edges = [0, *(np.flatnonzero(of_row[1:] != of_row[:-1]) + 1).tolist(), len(batch)]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if low < high and of_row[low] != last:
                    last, chunk, used, rows_in = of_row[low], 0, 0, 0
                ends = np.cumsum(sizes[low:high])
                start, before = 0, 0
                while start < high - low:
                    # rows up to here fit; a first row above the limit is taken alone
                    stop = int(np.searchsorted(ends, before + limit - used, side="right"))
                    if stop == start and not rows_in:
                        stop += 1
                    numbers[low + start : low + stop] = chunk
                    rows_in += stop - start
                    if stop > start:
                        used += int(ends[stop - 1]) - before
                        before = int(ends[stop - 1])
                    if stop < high - low:
                        chunk, used, rows_in = chunk + 1, 0, 0
                    start = stop
            yield batch.assign(chunk=numbers).drop(columns=["_size", "_start"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return ranged.select(*names, "range", "_size", "_start").mapInPandas(fill, f"{fields}, range long, chunk long")


def attributes(points: DataFrame, assignments: DataFrame, families: Sequence[str],
               scalars: DataFrame | None = None) -> DataFrame:
    """One row per point: id, chunk, one class index per family (0 if unknown) and the scalars."""
    indices = assignments.filter(F.col("family").isin(list(families))).groupBy("id").agg(*[
        F.max(F.when(F.col("family") == name, F.col("idx"))).alias(name) for name in families
    ])
    wide = points.select("id", "chunk_id").join(indices, "id", "left")
    for name in families:
        wide = wide.withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("short"))
    return wide.join(scalars, "id", "left") if scalars is not None else wide


def manifest(points: DataFrame, classes: DataFrame, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Totals, chunk count, coordinate bounds and class lists in one row."""
    lists = classes.groupBy("family").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "label"))), lambda c: c["label"]).alias("labels")
    )
    families = lists.agg(F.array_sort(F.collect_list(F.struct("family", "labels")))).scalar()
    box = bounds(points)
    shape = box.select(
        "total", F.ceil(F.col("total") / chunk_size).alias("n_chunks"), F.lit(chunk_size).alias("chunk_size"),
        F.array(*[F.col(f"min_{a}") for a in AXES]).alias("coord_min"),
        F.array(*[F.col(f"max_{a}") for a in AXES]).alias("coord_max"),
    )
    return shape.withColumn("categories", families)


def exploration_table(points: DataFrame, assignments: DataFrame, families: Sequence[str],
                      metadata: DataFrame, contrib: DataFrame, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """One wide row per point: coordinates, chunk, a label per family, metadata and extra fields."""
    placed = z_ordered(points, chunk_size)
    labels = assignments.filter(F.col("family").isin(list(families))).groupBy("id").agg(*[
        F.max(F.when(F.col("family") == name, F.col("category"))).alias(f"label_{name}") for name in families
    ])
    return placed.join(labels, "id", "left").join(metadata, "id", "left").join(contrib, "id", "left")
