"""Cells of vectors around pivots, and which cells a distance rules out.

Angles between unit vectors are a metric, as are straight distances between points. A vector at a
distance of t from a pivot is at least t - r away from everything within r of that pivot, so a search that already has something nearer need not
look into that cell. Pivots are a bounded sample: they decide how much is left out, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from orrery.functions.vectors import NORM_FLOOR
from orrery.session import cut

MAX_PIVOTS = 1024
PIVOTS_PER_BLOCK = 4
TASK_ROWS = 1 << 14  # rows of either side that meet in one group
LEAST_ROWS = 1024
_TILE = 1024
SLACK = 4e-6  # radians; cosines are compared after rounding to 12 digits


def unit_rows(column: pd.Series) -> np.ndarray:
    """The vectors of a column as rows of length 1; a vector of length 0 stays as it is."""
    if not len(column):
        return np.zeros((0, 0))
    rows = np.stack(column.to_numpy()).astype(np.float64)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), NORM_FLOOR)


def point_rows(column: pd.Series) -> np.ndarray:
    """The vectors of a column as they are."""
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def straight_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` to all of ``b``, by differences, so that equal points are at 0."""
    total = np.zeros((len(a), len(b)))
    for axis in range(a.shape[1]):
        total += np.square(a[:, axis, None] - b[None, :, axis])
    return np.sqrt(total, out=total)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


@dataclass(frozen=True)
class Cells:
    """Pivots, and of every cell the largest distance of a member to its pivot and the number of members.

    Distances are angles, or with ``straight`` those between points. The last cell has no pivot: it
    holds vectors of length 0, about which no angle says anything. Cells of neighbouring numbers lie
    near each other; runs of them with ``TASK_ROWS`` members together are a bin, in which rows travel.
    """

    pivots: np.ndarray
    radii: np.ndarray
    counts: np.ndarray
    straight: bool = False

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        """What a broadcast carries."""
        return self.pivots, self.radii, self.counts, self.straight

    def bins(self) -> np.ndarray:
        """Number of the bin of every cell."""
        before = np.cumsum(self.counts) - self.counts
        size = -(-int(self.counts.sum()) // max(1, -(-int(self.counts.sum()) // TASK_ROWS)))
        return np.unique(before // max(size, 1), return_inverse=True)[1].astype(np.int32)

    def homes(self, vectors: np.ndarray) -> np.ndarray:
        """The cell whose pivot is nearest to every vector."""
        return self._to_pivots(vectors).argmin(axis=1).astype(np.int32)

    def to_meet(self, vectors: np.ndarray, enough: int, farthest: np.ndarray | None) -> np.ndarray:
        """Which cells every vector has to meet.

        With ``farthest`` (distance to beat or equal) all that can hold something as near; without
        it the nearest cells that hold ``enough`` members.
        """
        if farthest is None:
            return self.nearest_first(vectors, enough)
        if not self.straight:
            farthest = np.arccos(np.clip(1.0 - farthest, -1.0, 1.0))
        return (self.floors(vectors) <= farthest[:, None]) & (self.counts > 0)

    def _to_pivots(self, vectors: np.ndarray) -> np.ndarray:
        return straight_distances(vectors, self.pivots) if self.straight else _angles(vectors, self.pivots)

    def floors(self, vectors: np.ndarray) -> np.ndarray:
        """The least possible distance of every vector to the members of every cell; below 0: no bound."""
        least = self._to_pivots(vectors) - self.radii[:-1] - SLACK
        floors = np.column_stack([least, np.full(len(vectors), -1.0)])
        if not self.straight:
            floors[~vectors.any(axis=1)] = -1.0
        return floors

    def nearest_first(self, vectors: np.ndarray, members: int) -> np.ndarray:
        """Which cells, taken by the distance to their pivot, hold ``members`` vectors together."""
        order = np.argsort(np.column_stack([self._to_pivots(vectors), np.full(len(vectors), np.inf)]), axis=1, kind="stable")
        before = np.cumsum(self.counts[order], axis=1) - self.counts[order]
        chosen = np.zeros(order.shape, dtype=bool)
        np.put_along_axis(chosen, order, before < members, axis=1)
        return chosen & (self.counts > 0)


def place(vectors: np.ndarray, pivots: np.ndarray, straight: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Cell of every vector and its distance to the pivot."""
    if not len(vectors):
        return np.zeros(0, dtype=np.int32), np.zeros(0)
    away = straight_distances(vectors, pivots) if straight else _angles(vectors, pivots)
    cell = away.argmin(axis=1)
    away = away[np.arange(len(vectors)), cell]
    if straight:
        return cell.astype(np.int32), away
    empty = ~vectors.any(axis=1)
    return np.where(empty, len(pivots), cell).astype(np.int32), np.where(empty, 0.0, away)


def _side_by_side(rows: np.ndarray) -> np.ndarray:
    """The rows in an order in which neighbours are near: halved again and again along their widest axis."""
    def halves(at: np.ndarray) -> list[np.ndarray]:
        if len(at) < 2:
            return [at]
        order = at[np.argsort(rows[at, rows[at].var(axis=0).argmax()], kind="stable")]
        return halves(order[: len(at) // 2]) + halves(order[len(at) // 2 :])

    return rows[np.concatenate(halves(np.arange(len(rows))))]


def around_pivots(points: DataFrame, count: int, block_rows: int, straight: bool = False) -> tuple[Cells, DataFrame]:
    """The cells of ``points`` (id, embedding, carried) and the points with their ``cell``."""
    wanted = min(MAX_PIVOTS, PIVOTS_PER_BLOCK * max(1, -(-count // block_rows)))
    rows_of = point_rows if straight else unit_rows
    # a bounded sample: ``wanted`` rows at most
    pivots = rows_of(points.orderBy(F.xxhash64("id"), "id").limit(wanted).toPandas()["embedding"])
    if not straight and len(pivots):
        pivots = pivots[pivots.any(axis=1)] if pivots.any() else np.eye(1, pivots.shape[1])
    if not len(pivots):
        pivots = np.ones((1, 1))
    pivots = _side_by_side(pivots)
    shared = points.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), _TILE):
                tile = batch.iloc[start : start + _TILE]
                cell, away = place(rows_of(tile["embedding"]), shared.value, straight)
                yield tile.assign(cell=cell, away=away)

    placed = cut(points.select("id", "embedding", "carried").mapInPandas(
        assign, f"id long, embedding {points.schema['embedding'].dataType.simpleString()}, "
                f"carried {points.schema['carried'].dataType.simpleString()}, cell int, away double"))
    radii, counts = np.zeros(len(pivots) + 1), np.zeros(len(pivots) + 1, dtype=np.int64)
    for row in placed.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        radii[row["cell"]], counts[row["cell"]] = row["radius"], row["n"]  # a row per pivot
    return Cells(pivots, radii, counts, straight), placed.drop("away")


def _entry(numbers: np.ndarray, at: Column) -> Column:
    """The entry of a list of numbers at a place."""
    return F.element_at(F.array(*[F.lit(int(n)) for n in numbers]), at + 1)


def meetings(visitors: DataFrame, members: DataFrame, cells: Cells):
    """Visitors (with the ``bin`` they visit) and members (with their ``cell``) of each bin, cut into
    parts of bounded size and put together pairwise.

    Both sides are cut by hash, so a bin that holds most rows is many even parts. A row travels once per
    bin and part of the other side, however many cells of the bin it meets.
    """
    bins = cells.bins()
    counts = np.bincount(bins, weights=cells.counts).astype(np.int64)
    visits = np.zeros(len(counts), dtype=np.int64)
    for row in visitors.groupBy("bin").count().collect():  # a row per bin
        visits[row["bin"]] = row["count"]
    parts = np.maximum(1, -(-counts // TASK_ROWS))
    # smaller parts than could be held, as long as there are fewer groups than would keep all cores busy
    wanted = 2 * visitors.sparkSession.sparkContext.defaultParallelism
    rows = int(np.clip((visits * parts).sum() // wanted, LEAST_ROWS, max(TASK_ROWS, LEAST_ROWS)))
    chunks = -(-visits // rows)

    def dealt(df: DataFrame, own: str, sizes: np.ndarray, other: str, copies: np.ndarray) -> DataFrame:
        held = df.filter(_entry(copies, F.col("bin")) > 0)
        held = held.withColumn(own, F.pmod(F.xxhash64("id"), _entry(np.maximum(sizes, 1), F.col("bin"))).cast("int"))
        return held.withColumn(other, F.explode(F.sequence(F.lit(0), _entry(np.maximum(copies, 1), F.col("bin")) - 1)))

    placed = members.withColumn("bin", _entry(bins, F.col("cell")))
    left = dealt(visitors, "chunk", chunks, "part", np.where(counts > 0, parts, 0)).groupBy("bin", "part", "chunk")
    right = dealt(placed, "part", parts, "chunk", chunks).groupBy("bin", "part", "chunk")
    return left.cogroup(right)
