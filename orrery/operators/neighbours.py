"""Exact nearest-neighbour joins on cosine (or straight) distance, votes and class assignment.

Two physical forms give the same rows. While the training side fits under a checked size it is
broadcast and every task multiplies its own query rows with it, without a shuffle. Beyond that
the training side is cut into cells around pivots. A query first meets the nearest cells that hold
k rows; the k-th distance found there rules out every cell whose members are all farther away, and
the query meets only the cells that are left. Rows travel once per bin, a run of neighbouring cells of
bounded size; which cells of it are met is told inside the task, for a tile of queries from near each
other at a time. Only the best k rows per query and bin travel on to a final top-k per query.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.functions import vectors as V
from orrery.operators.cells import (
    Cells, around_pivots, meetings, point_rows, straight_distances, unit_rows as _unit_rows)
from orrery.session import cut

BROADCAST_BYTES = 16 * 1024 * 1024  # every worker unpacks a copy of its own
BLOCK_ROWS = 50_000
_QUERY_TILE = 512
_FIRST_TILE = 1024
_TRAIN_TILE = 4096
_ROUNDING = 1e-11
ZERO_DISTANCE = 1e-12  # cosine of equal unit vectors is 1 only up to rounding
LOO_FLOOR = 1e-10


def _best(distances: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k smallest per row, ties by column number."""
    if distances.shape[1] <= k:
        return np.argsort(distances, axis=1, kind="stable")
    columns = np.sort(np.argpartition(distances, k - 1, axis=1)[:, :k], axis=1)
    values = np.take_along_axis(distances, columns, axis=1)
    kth = values.max(axis=1, keepdims=True)
    tied = np.nonzero(np.count_nonzero(distances <= kth, axis=1) > k)[0]
    if len(tied):
        # equals of the k-th value were left out: keep those with the lowest columns
        below, equal = distances[tied] < kth[tied], distances[tied] == kth[tied]
        room = k - below.sum(axis=1, keepdims=True)
        kept = below | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= room))
        columns[tied] = np.nonzero(kept)[1].reshape(len(tied), k)
        values = np.take_along_axis(distances, columns, axis=1)
    return np.take_along_axis(columns, np.argsort(values, axis=1, kind="stable"), axis=1)


class _Side:
    """Ids, unit vectors and one carried column of some rows, as arrays inside a task."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, carried: np.ndarray):
        self.ids, self.vectors, self.carried = ids, vectors, carried

    @classmethod
    def of(cls, rows: pd.DataFrame, sort: bool = False, straight: bool = False) -> _Side:
        rows = rows.sort_values("id") if sort else rows
        vectors = point_rows(rows["embedding"]) if straight else _unit_rows(rows["embedding"])
        return cls(rows["id"].to_numpy(np.int64), vectors, rows["carried"].to_numpy())

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a broadcast carries: plain arrays, so that no task stacks or normalises them again."""
        return self.ids, self.vectors, self.carried


def _distances(tile: np.ndarray, others: np.ndarray, straight: bool) -> np.ndarray:
    if straight:
        return straight_distances(tile, others)
    product = tile @ others.T
    return np.subtract(1.0, product, out=product)


def _closer(best_d: np.ndarray, best_at: np.ndarray, distance: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """The best rows so far with those of a tile of distances that beat the worst of them.

    A tile adds few: only those are rounded and sorted. Equals go by place, and those of the tile come later.
    """
    row, column = np.nonzero(distance < best_d[:, -1:] + _ROUNDING)
    if not len(row):
        return best_d, best_at
    touched, of = np.unique(row, return_inverse=True)
    k = best_d.shape[1]
    owner = np.concatenate([np.repeat(np.arange(len(touched)), k), of])
    values = np.concatenate([best_d[touched].ravel(), np.round(distance[row, column], 12)])
    places = np.concatenate([best_at[touched].ravel(), column + low])
    order = np.lexsort((places, values, owner))
    owner = owner[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    kept = order[rank < k]
    best_d[touched], best_at[touched] = values[kept].reshape(-1, k), places[kept].reshape(-1, k)
    return best_d, best_at


def _nearest(queries: _Side, train: _Side, k: int, skip_self: bool, straight: bool = False) -> Iterator[pd.DataFrame]:
    """k nearest training rows of each query row, tile by tile; the training ids must be ascending."""
    for start in range(0, len(queries.ids), _QUERY_TILE):
        ids = queries.ids[start : start + _QUERY_TILE]
        tile = queries.vectors[start : start + _QUERY_TILE]
        best_d = best_at = None
        low = 0
        while low < len(train.ids):
            high = low + (max(_FIRST_TILE, k) if low == 0 else _TRAIN_TILE)
            names = train.ids[low:high]
            distance = _distances(tile, train.vectors[low:high], straight)
            if skip_self:
                own = np.minimum(np.searchsorted(names, ids), len(names) - 1)
                same = np.nonzero(names[own] == ids)[0]
                distance[same, own[same]] = np.inf
            if best_d is None:
                np.round(distance, 12, out=distance)  # copies of one vector are equally far and rank by id
                best_at = _best(distance, k)
                best_d = np.take_along_axis(distance, best_at, axis=1)
            else:
                best_d, best_at = _closer(best_d, best_at, distance, low)
            low = high
        if best_d is None:
            continue
        valid = np.isfinite(best_d)
        row = np.nonzero(valid)[0]
        yield pd.DataFrame({
            "query_id": ids[row],
            "neighbour_id": train.ids[best_at[valid]],
            "distance": best_d[valid],
            "rank": (np.cumsum(valid, axis=1)[valid]).astype(np.int32),
            "of_query": queries.carried[start : start + _QUERY_TILE][row],
            "of_neighbour": train.carried[best_at[valid]],
        })


def _as_input(df: DataFrame, id_column: str, carry: str | None = None) -> DataFrame:
    carried = F.col(carry).cast("string") if carry else F.lit(None).cast("string")
    # renamed even where the name stays: two inputs from one table must not share column ids
    return df.select(
        F.col(id_column).cast("long").alias("id"), F.col("embedding").alias("embedding"), carried.alias("carried")
    )


def size_of(known: DataFrame) -> tuple[int, int]:
    """Row count of a vector table and the bytes it takes as a matrix."""
    row = known.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("d")
    ).first()
    return row["n"], row["n"] * (row["d"] * 8 + 64)


_FOUND = "query_id long, neighbour_id long, distance double, rank int, of_query string, of_neighbour string"


def nearest(queries: DataFrame, train: DataFrame, k: int, query_id: str = "id", train_id: str = "id",
            skip_self: bool = False, carry_query: str | None = None, carry_train: str | None = None,
            broadcast_bytes: int = BROADCAST_BYTES, block_rows: int = BLOCK_ROWS, straight: bool = False) -> DataFrame:
    """(query_id, neighbour_id, distance, rank) of the k nearest training rows of every query row.

    The distance is 1 - cosine, or with ``straight`` that between points.
    ``skip_self`` leaves out the training row with the query's own id. Fewer than k rows come
    back where the training side is smaller. A column of either side can be carried along (as
    text) to save joining it back to k rows per query.
    """
    asked, known = _as_input(queries, query_id, carry_query), _as_input(train, train_id, carry_train)
    count, size = size_of(known)
    if size <= broadcast_bytes:
        found = _against_broadcast(asked, known, k, skip_self, straight)
    else:
        found = _against_blocks(asked, known, k, skip_self, count, block_rows, straight)
    names = {"of_query": carry_query, "of_neighbour": carry_train}
    return found.select(
        "query_id", "neighbour_id", "distance", "rank", *[F.col(c).alias(name) for c, name in names.items() if name]
    )


def _against_broadcast(asked: DataFrame, known: DataFrame, k: int, skip_self: bool, straight: bool) -> DataFrame:
    # collected only under the size check of the caller; the ranks are final, so nothing is shuffled
    shared = known.sparkSession.sparkContext.broadcast(_Side.of(known.toPandas(), True, straight).arrays())

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        train = _Side(*shared.value)
        for batch in batches:
            if len(train.ids) and len(batch):
                yield from _nearest(_Side.of(batch, straight=straight), train, k, skip_self, straight)

    return asked.mapInPandas(search, _FOUND)


def _visiting(asked: DataFrame, cells: Cells, enough: int, bounds: DataFrame | None = None, of_cells: bool = False) -> DataFrame:
    """Query rows with each ``bin`` (or each ``cell``) they have to meet, and the number of their ``home`` cell.

    Without ``bounds`` these hold the nearest cells with ``enough`` rows; with them
    (id, farthest: the distance to beat) all cells that can hold something as near.
    """
    shared = asked.sparkSession.sparkContext.broadcast(cells.arrays())
    bounded, bins = bounds is not None, cells.bins()
    number = np.arange(len(bins), dtype=np.int32) if of_cells else bins
    starts = np.flatnonzero(np.diff(number, prepend=-1))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = Cells(*shared.value)
        for batch in batches:
            for start in range(0, len(batch), _QUERY_TILE):
                tile = batch.iloc[start : start + _QUERY_TILE]
                vectors = point_rows(tile["embedding"]) if cells.straight else _unit_rows(tile["embedding"])
                visited = cells.to_meet(vectors, enough, tile["farthest"].to_numpy() if bounded else None)
                row, at = np.nonzero(np.logical_or.reduceat(visited, starts, axis=1))
                yield tile.assign(home=cells.homes(vectors)).iloc[row].assign(bin=at.astype(np.int32))

    kind = asked.schema["embedding"].dataType.simpleString()
    rows = asked.join(bounds, "id") if bounded else asked.withColumn("farthest", F.lit(None).cast("double"))
    return rows.select("id", "embedding", "carried", "farthest").mapInPandas(
        choose, f"id long, embedding {kind}, carried string, farthest double, home int, bin int")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _bounds(found: DataFrame, k: int) -> DataFrame:
    """(id, farthest): the distance that a further neighbour of a query has to beat or equal."""
    return found.groupBy(F.col("query_id").alias("id")).agg(
        F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(float("inf")).alias("farthest"))


def _over_cells(queries: pd.DataFrame, others: pd.DataFrame, cells: Cells, k: int, enough: int, bounded: bool,
                skip_self: bool) -> Iterator[pd.DataFrame]:
    """k nearest rows of each query among those of the cells it has to meet, for tiles of queries from near each other."""
    queries, others = queries.sort_values(["home", "id"]), others.sort_values("id")
    asked, known = _Side.of(queries, straight=cells.straight), _Side.of(others, straight=cells.straight)
    cell, farthest = others["cell"].to_numpy(), queries["farthest"].to_numpy()
    for start in range(0, len(asked.ids), _QUERY_TILE):
        at = slice(start, start + _QUERY_TILE)
        met = cells.to_meet(asked.vectors[at], enough, farthest[at] if bounded else None).any(axis=0)[cell]
        some = known if met.all() else _Side(known.ids[met], known.vectors[met], known.carried[met])
        yield from _nearest(_Side(asked.ids[at], asked.vectors[at], asked.carried[at]), some, k, skip_self, cells.straight)


def _against_blocks(asked: DataFrame, known: DataFrame, k: int, skip_self: bool,
                    n_train: int, block_rows: int, straight: bool) -> DataFrame:
    cells, members = around_pivots(known, n_train, block_rows, straight)
    shared, enough = asked.sparkSession.sparkContext.broadcast(cells.arrays()), k + skip_self

    def met(visitors: DataFrame, bounded: bool) -> DataFrame:
        def search(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(some) and len(others):
                found = list(_over_cells(some, others, Cells(*shared.value), k, enough, bounded, skip_self))
            return pd.concat(found, ignore_index=True) if found else pd.DataFrame(
                {name.split()[0]: [] for name in _FOUND.split(", ")})

        return meetings(visitors, members, cells).applyInPandas(search, _FOUND)

    # the first turn tells how near a neighbour must be; every query has met someone, unless there is no one to meet
    bounds = cut(_bounds(_ranked(met(_visiting(asked, cells, enough), False), k), k))
    return _ranked(met(_visiting(asked, cells, enough, bounds), True), k)


def visited_cells(queries: DataFrame, train: DataFrame, k: int, query_id: str = "id", train_id: str = "id",
                  skip_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, first, rest, cells): how many cells each query meets in both turns, and how many there are.

    For measuring what the bounds save on given vectors.
    """
    asked, known = _as_input(queries, query_id), _as_input(train, train_id)
    cells, _ = around_pivots(known, size_of(known)[0], block_rows)
    enough = k + skip_self
    found = nearest(queries, train, k, query_id, train_id, skip_self, broadcast_bytes=0, block_rows=block_rows)
    first = _visiting(asked, cells, enough, of_cells=True).select("id", F.lit(1).alias("first"), F.lit(0).alias("rest"))
    rest = _visiting(asked, cells, enough, _bounds(found, k), of_cells=True).select("id", F.lit(0).alias("first"), F.lit(1).alias("rest"))
    return first.unionByName(rest).groupBy(F.col("id").alias("query_id")).agg(
        F.sum("first").alias("first"), F.sum("rest").alias("rest"), F.lit(int((cells.counts > 0).sum())).alias("cells"))


def graph(points: DataFrame, k: int, id_column: str = "id", **sizes: int) -> DataFrame:
    """Neighbour table of all rows among themselves, without the row itself."""
    return nearest(points, points, k, id_column, id_column, skip_self=True, **sizes).select(
        F.col("query_id").alias("id"), F.col("neighbour_id").alias("neighbour"), "rank", "distance"
    )


def _vote(leave_one_out: Column | bool) -> tuple[Column, Column]:
    """(is a zero-distance vote, weight of any other vote) of a neighbour row."""
    loo = leave_one_out if isinstance(leave_one_out, Column) else F.lit(leave_one_out)
    zero = (F.col("distance") <= ZERO_DISTANCE) & ~loo
    weight = F.when(loo, 1.0 / F.greatest("distance", F.lit(LOO_FLOOR))).otherwise(1.0 / F.col("distance"))
    return zero, F.when(~zero, weight)


def votes(neighbours: DataFrame, leave_one_out: Column | bool = False) -> DataFrame:
    """Class shares per query from rows (query_id, label, distance): (query_id, label, p).

    A neighbour weighs 1/distance. For an ordinary query, neighbours at distance 0 take the
    whole vote in equal parts; a left-out training row floors the distance instead.
    """
    zero, weight = _vote(leave_one_out)
    per_label = neighbours.groupBy("query_id", "label").agg(
        F.count(F.when(zero, 1)).cast("double").alias("_zeros"), F.coalesce(F.sum(weight), F.lit(0.0)).alias("_weight")
    )
    of_query = Window.partitionBy("query_id")
    zeros, weights = F.sum("_zeros").over(of_query), F.sum("_weight").over(of_query)
    share = F.when(zeros > 0, F.col("_zeros") / zeros).otherwise(F.col("_weight") / weights)
    return per_label.select("query_id", "label", share.alias("p"))


def class_shares(neighbours: DataFrame, classes: Sequence[str], leave_one_out: Column | bool = False) -> DataFrame:
    """(query_id, proba): the votes as one vector in class order, in a single aggregation per query."""
    zero, weight = _vote(leave_one_out)
    sums = []
    for i, name in enumerate(classes):
        mine = F.col("label") == name
        sums += [
            F.count(F.when(mine & zero, 1)).cast("double").alias(f"z{i}"),
            F.coalesce(F.sum(F.when(mine, weight)), F.lit(0.0)).alias(f"w{i}"),
        ]
    summed = neighbours.groupBy("query_id").agg(*sums).select(
        "query_id",
        F.array(*[F.col(f"z{i}") for i in range(len(classes))]).alias("zeros"),
        F.array(*[F.col(f"w{i}") for i in range(len(classes))]).alias("weights"),
    )
    chosen = F.when(V.total(F.col("zeros")) > 0, F.col("zeros")).otherwise(F.col("weights"))
    held = summed.select("query_id", chosen.alias("votes")).withColumn("all", V.total(F.col("votes")))
    return held.select("query_id", F.transform("votes", lambda v: v / F.col("all")).alias("proba"))


def priors(labels: DataFrame) -> dict[str, float]:
    """Class frequencies of the training labels: one entry per class of the class list."""
    rows = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").collect()
    total = sum(row["n"] for row in rows)
    return {row["label"]: row["n"] / total for row in rows}


def assign(points: DataFrame, labels: DataFrame, k: int, min_score: float = 0.0,
           correct_priors: bool = True, **sizes: int) -> DataFrame:
    """(id, category, score, runners_up, proba) of every point from its labelled neighbours.

    Labelled points are classified from the others only, so one search that leaves the point
    itself out serves both kinds.
    """
    points = points.select("id", "embedding")
    labels = labels.select("id", F.col("label").cast("string").alias("label"))
    # carries the label and, by it, whether there is one; checkpointed, for it is read several times
    labelled = cut(points.join(labels, "id", "left"))
    train = labelled.filter(F.col("label").isNotNull())
    frequency = priors(train)  # labels without a vector cannot vote and do not count
    classes = sorted(frequency)
    asked = labelled.select("id", "embedding", F.col("label").isNotNull().alias("tagged"))
    found = nearest(asked, train, k, skip_self=True, carry_query="tagged", carry_train="label", **sizes)
    proba = class_shares(found, classes, F.col("tagged") == "true")
    if correct_priors:
        proba = proba.withColumn("proba", V.prior_corrected(F.col("proba"), [frequency[c] for c in classes]))
    best = V.top_classes(F.col("proba"), classes)
    ranked = proba.select(F.col("query_id").alias("id"), "proba", best.alias("best"))
    winner = F.element_at("best", 1)
    return ranked.select(
        "id",
        V.gated(winner["category"], F.array_max("proba"), min_score).alias("category"),
        winner["score"].alias("score"),
        F.slice("best", 2, 2).alias("runners_up"),
        "proba",
    )
