"""Density clusters in any number of dimensions, at any density, from a neighbour table.

The mutual reachability of two neighbours is their distance, or the core distance of either if that
is larger (the distance to the ``min_samples``-th point, itself included). A minimum spanning forest of
these edges holds the clusters of every density at once: cutting it at a distance leaves the
components that all edges up to that distance would give. It has one edge per point at most, so any
number of cuts works on a small table.

Edges come from the ``k`` nearest neighbours of every point; with fewer neighbours than points two dense
parts that are no near neighbours of each other stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from orrery.operators.graphs import connected_components, joined_in_order
from orrery.operators.positions import with_position
from orrery.session import PART_ROWS, cut_to_size, fitted

NOISE = -1


def reachability(neighbours: DataFrame, min_samples: int) -> DataFrame:
    """(a, b, weight), a < b, of a neighbour table (id, neighbour, rank, distance) without the points themselves.

    A point with fewer than ``min_samples - 1`` neighbours is no core point and has no edge.
    """
    if min_samples < 2:
        core = neighbours.groupBy("id").agg(F.lit(0.0).alias("core"))
    else:
        core = neighbours.filter(F.col("rank") == min_samples - 1).select("id", F.col("distance").alias("core"))
    ends = neighbours.select(F.col("id").alias("i"), F.col("neighbour").alias("j"), "distance")
    ends = ends.join(core.select(F.col("id").alias("i"), F.col("core").alias("core_i")), "i")
    ends = ends.join(core.select(F.col("id").alias("j"), F.col("core").alias("core_j")), "j")
    return ends.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(
        F.min(F.greatest("distance", "core_i", "core_j")).alias("weight"))


def _least(edges: DataFrame) -> DataFrame:
    """(a, b, weight) of the edges (u, v, a, b, weight), in one part, that join two trees when taken by weight."""
    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches], ignore_index=True)
        rows = rows.iloc[np.lexsort((rows["b"], rows["a"], rows["weight"]))]
        yield rows.loc[joined_in_order(rows["u"].to_numpy(), rows["v"].to_numpy())[2], ["a", "b", "weight"]]

    fields = ", ".join(f"{name} {edges.schema[name].dataType.simpleString()}" for name in ("a", "b", "weight"))
    return edges.coalesce(1).mapInPandas(choose, fields)


def spanning_forest(edges: DataFrame, max_rounds: int = 64, part_rows: int = PART_ROWS) -> DataFrame:
    """The minimum spanning forest of (a, b, weight), equal weights in the order of a and b.

    In every round each tree takes its least edge to another tree and is joined with it, so the
    number of trees that have an edge at least halves; of parallel edges between two trees only the
    least goes on. The order of edges has no ties, so no round closes a circle. When the edges that are
    left fit in one part (``part_rows``), the task that holds it takes them by weight; as there are no
    ties, the forest is the same.
    """
    least = F.min(F.struct("weight", "a", "b")).alias("least")
    left, rows = cut_to_size(edges.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"), "a", "b", "weight"))
    chosen: list[DataFrame] = []
    while rows:
        if len(chosen) >= max_rounds:
            raise RuntimeError(f"spanning forest not settled after {max_rounds} rounds")
        if rows <= part_rows:
            chosen.append(_least(left))
            break
        ends = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v"), "a", "b", "weight"))
        picks = fitted(ends.groupBy("u").agg(F.min(F.struct("weight", "a", "b", "v")).alias("pick")), rows)
        picks, _ = cut_to_size(picks.select("u", "pick.*"))
        chosen.append(picks.select("a", "b", "weight").distinct())
        # every tree that has an edge picks one, so the other end of a pick is a tree with a pick too
        joined, _ = cut_to_size(connected_components(picks.select(F.col("u").alias("id")), picks, "u", "v", part_rows=part_rows))
        for end in ("u", "v"):
            left = fitted(left, rows).join(joined.select(F.col("id").alias(end), F.col("component").alias("_tree")), end).withColumn(
                end, F.col("_tree")).drop("_tree")
        left = left.filter("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(least)
        left, rows = cut_to_size(left.select("u", "v", "least.*"))
    forest = edges.select("a", "b", "weight").limit(0)
    for part in chosen:
        forest = forest.unionByName(part)
    return cut_to_size(forest)[0]


def clusters_at(points: DataFrame, forest: DataFrame, distance: Column | float, min_size: int = 1) -> DataFrame:
    """(id, cluster): the parts that edges up to ``distance`` hold together, numbered by size, then smallest id.

    Points without such an edge, and parts below ``min_size``, are noise (-1).
    """
    held, _ = cut_to_size(forest.filter(F.col("weight") <= distance))
    dense = held.select(F.col("a").alias("id")).union(held.select("b")).distinct()
    component = connected_components(dense, held)
    sizes = component.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_size)
    numbered = with_position(sizes, [F.col("n").desc(), "component"], "cluster").drop("n")
    placed = component.join(numbered, "component").select("id", F.col("cluster").cast("int").alias("cluster"))
    return points.select("id").join(placed, "id", "left").select("id", F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))


def clusters_by_level(points: DataFrame, forest: DataFrame, distances: Sequence[float], min_size: int = 1) -> DataFrame:
    """(level, id, cluster) of one forest cut at several distances; a cluster of one level lies in one of the next."""
    found = None
    for level, distance in enumerate(sorted(distances)):
        at = clusters_at(points, forest, distance, min_size).select(F.lit(level).alias("level"), "id", "cluster")
        found = at if found is None else found.unionByName(at)
    return found
