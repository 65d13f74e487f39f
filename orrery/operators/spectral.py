"""Coordinates that keep neighbourhoods: leading eigenvectors of a neighbour graph.

The graph is a table of edges and never a matrix in one place. Multiplying it with a block of vectors is
a join of edges with rows and a sum per row; products of blocks are sums over rows of a few hundred
numbers. On these two a block Lanczos search with full reorthogonalisation is run and restarted from its
best vectors until the residuals are small. The driver sees the small projected matrix only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from orrery.operators.neighbours import nearest
from orrery.session import cut

AXES = ("x", "y", "z")
STEPS = 8
EXTRA = 3
CYCLES = 12
TOLERANCE = 1e-6
LEAST_WEIGHT = 1e-9
_SMALLEST = 1e-12


def affinities(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (i, j, w) in both directions and rows (id, root) of a neighbour table (id, neighbour, rank, distance).

    An edge weighs exp(-d² / (s_i s_j)) with the distance s of a point to its last neighbour, and
    ``LEAST_WEIGHT`` at least, so that a point next to many equal ones is not cut off; it is divided by the roots of the degrees of both ends; ``root`` is the root of a row's degree.
    """
    scale = table.groupBy("id").agg(F.greatest(F.max("distance"), F.lit(_SMALLEST)).alias("s"))
    ends = table.filter("id <> neighbour").select(F.col("id").alias("i"), F.col("neighbour").alias("j"), "distance")
    for end in ("i", "j"):
        ends = ends.join(scale.select(F.col("id").alias(end), F.col("s").alias(f"s_{end}")), end)
    weight = F.greatest(F.exp(-F.col("distance") * F.col("distance") / (F.col("s_i") * F.col("s_j"))), F.lit(LEAST_WEIGHT))
    pairs = ends.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max(weight).alias("w"))
    pairs = cut(pairs)
    both = pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    rows = cut(both.groupBy(F.col("i").alias("id")).agg(F.sqrt(F.sum("w")).alias("root")))
    edges = both
    for end in ("i", "j"):
        edges = edges.join(rows.select(F.col("id").alias(end), F.col("root").alias(f"r_{end}")), end)
    return cut(edges.select("i", "j", (F.col("w") / (F.col("r_i") * F.col("r_j"))).alias("w"))), rows


def _products(rows: DataFrame, width: int) -> np.ndarray:
    """q'q summed over all rows: ``width`` times ``width`` numbers."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                q = np.stack(batch["q"].to_numpy())
                total += q.T @ q
        yield pd.DataFrame({"at": np.arange(width * width, dtype=np.int32), "value": total.ravel()})

    sums = rows.select("q").mapInPandas(add, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    found = np.zeros(width * width)
    for row in sums.collect():  # the small matrix
        found[row["at"]] = row["value"]
    return found.reshape(width, width)


def _turned(rows: DataFrame, matrix: np.ndarray) -> DataFrame:
    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(q=list(np.stack(batch["q"].to_numpy()) @ matrix))

    return rows.select("id", "q").mapInPandas(turn, f"id {rows.schema['id'].dataType.simpleString()}, q array<double>")


def _orthonormal(rows: DataFrame, held: int, width: int) -> tuple[DataFrame, int, np.ndarray]:
    """Rows whose columns after the first ``held`` (orthonormal) ones are made orthonormal to all, their
    number, and the products of all columns before. Directions that are not new go."""
    first = None
    for _ in range(2):
        products = _products(rows, width)
        first = products if first is None else first
        overlap = products[:held, held:]
        rest = products[held:, held:] - overlap.T @ overlap
        values, vectors = np.linalg.eigh((rest + rest.T) / 2)
        kept = values > 1e-11 * max(float(np.trace(products[held:, held:])), 1e-300)
        turn = vectors[:, kept] / np.sqrt(values[kept])
        matrix = np.zeros((width, held + turn.shape[1]))
        matrix[:held, :held] = np.eye(held)
        matrix[:held, held:] = -overlap @ turn
        matrix[held:, held:] = turn
        rows, width = cut(_turned(rows, matrix)), matrix.shape[1]
        if width == held:
            break
    return rows, width, first


def _multiplied(edges: DataFrame, rows: DataFrame, low: int, width: int) -> DataFrame:
    """Rows with the graph's product of their columns from ``low`` on appended."""
    at = range(low, width)
    block = rows.select(F.col("id").alias("j"), *[F.col("q")[i].alias(f"v{i}") for i in at])
    summed = edges.join(block, "j").groupBy(F.col("i").alias("id")).agg(*[F.sum(F.col("w") * F.col(f"v{i}")).alias(f"v{i}") for i in at])
    product = F.array(*[F.col(f"v{i}") for i in at])
    return cut(rows.join(summed.select("id", product.alias("p")), "id").select("id", F.concat("q", "p").alias("q")))


def layout(table: DataFrame, dims: int = 2, steps: int = STEPS, extra: int = EXTRA, cycles: int = CYCLES,
           tolerance: float = TOLERANCE) -> DataFrame:
    """(id, x, y[, z]) of every point of a neighbour table: the leading eigenvectors after the constant one.

    Axes are scaled to a mean square of 1 (points weighed by degree), the sign is that with which the cubes
    sum to 0 or more. In a graph of several parts the first axes tell the parts apart.
    """
    edges, weights = affinities(table)
    total = weights.agg(F.sum(F.col("root") * F.col("root"))).first()[0]
    if total is None:
        return table.select("id", *[F.lit(0.0).alias(a) for a in AXES[:dims]]).limit(0)
    # the constant vector is known; it stands first and everything else is kept orthogonal to it
    start = [F.col("root") / float(np.sqrt(total))]
    start += [(F.xxhash64("id", F.lit(i)) / float(2**63)).alias(f"r{i}") for i in range(dims + extra)]
    rows = cut(weights.select("id", F.array(*start).alias("q")))
    rows, width, _ = _orthonormal(rows, 1, len(start))
    for cycle in range(cycles):
        projected = np.zeros((0, 0))
        low = 1
        for step in range(steps):
            grown = _multiplied(edges, rows, low, width)
            more = 2 * width - low
            last = step == steps - 1
            next_rows, next_width, products = (grown, width, _products(grown, more)) if last else _orthonormal(grown, width, more)
            overlap = products[1:width, width:]
            held = np.zeros((width - 1, width - 1))
            held[: len(projected), : len(projected)] = projected
            held[:, low - 1 :] = overlap
            held[low - 1 :, :] = overlap.T
            projected = (held + held.T) / 2
            rest = products[width:, width:] - products[:width, width:].T @ products[:width, width:]
            if last or next_width == width:
                break
            rows, low, width = next_rows, width, next_width
        values, vectors = np.linalg.eigh(projected)
        best = np.argsort(values)[::-1][: min(dims + extra, len(values))]
        tail = vectors[low - 1 :, best[:dims]]
        residual = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", tail, rest, tail), 0.0))
        matrix = np.zeros((width, len(best) + 1))
        matrix[0, 0] = 1.0
        matrix[1:, 1:] = vectors[:, best]
        rows, width = cut(_turned(rows, matrix)), matrix.shape[1]
        if not len(residual) or residual.max() <= tolerance:
            break
    axes = [F.coalesce(F.try_element_at("q", F.lit(i + 2)), F.lit(0.0)) * float(np.sqrt(total)) / F.col("root") for i in range(dims)]
    placed = cut(rows.join(weights, "id").select("id", *[axis.alias(name) for name, axis in zip(AXES, axes, strict=False)]))
    names = AXES[:dims]
    cubes = placed.agg(*[F.sum(F.col(a) * F.col(a) * F.col(a)).alias(a) for a in names]).first()
    return placed.select("id", *[(F.col(a) * (1.0 if cubes[a] >= 0 else -1.0)).alias(a) for a in names])


def neighbours_kept(table: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """One row: which share of the first ``k`` neighbours of a table are among the ``k`` nearest in the layout."""
    axes = [a for a in AXES if a in places.columns]
    at = places.select("id", F.array(*axes).alias("embedding"))
    near = nearest(at, at, k, skip_self=True, straight=True).select(F.col("query_id").alias("id"), F.col("neighbour_id").alias("neighbour"))
    wanted = table.filter(F.col("rank") <= k).select("id", "neighbour")
    found = wanted.join(near, ["id", "neighbour"], "left_semi").agg(F.count(F.lit(1))).scalar()
    return wanted.agg((found / F.count(F.lit(1))).alias("kept"))
