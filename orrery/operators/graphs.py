"""Connected components and similarity edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from orrery.operators.cells import SLACK, Cells, around_pivots, meetings, unit_rows as _unit_rows
from orrery.operators.neighbours import BLOCK_ROWS, BROADCAST_BYTES, _as_input, _Side, size_of
from orrery.session import PART_ROWS, cut, cut_to_size, fitted

_EDGE = "a long, b long, similarity double"
_TILE = 1024
_ROUNDING = 1e-11
PIVOTS = 1024


def joined_in_order(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(every end once, the tree it is in, which edges join two trees when they are taken in their order)."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root, joins = list(range(len(names))), np.zeros(len(u), dtype=bool)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for edge, (i, j) in enumerate(zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True)):
        i, j = top(i), top(j)
        if i != j:
            root[max(i, j)] = min(i, j)
            joins[edge] = True
    return names, names[[top(i) for i in range(len(names))]], joins


def _settled(edges: DataFrame) -> DataFrame:
    """(u, p) with one p per component, of edges (u, v) that fit in one part."""
    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches], ignore_index=True)
        names, tree, _ = joined_in_order(rows["u"].to_numpy(), rows["v"].to_numpy())
        yield pd.DataFrame({"u": names, "p": tree})

    kind = edges.schema["u"].dataType.simpleString()
    return edges.coalesce(1).mapInPandas(settle, f"u {kind}, p {kind}")


def connected_components(nodes: DataFrame, edges: DataFrame, a: str = "a", b: str = "b",
                         max_rounds: int = 200, part_rows: int = PART_ROWS) -> DataFrame:
    """(id, component) with the smallest id of the component, for every node.

    Every round points each node at its neighbour of lowest random priority (or itself, if that
    is lower), follows the pointers two steps and contracts the graph along them. The edges that are left shrink by a constant share, so a hub
    disappears early and long chains take a logarithmic number of rounds. When the edges that are
    left fit in one part (``part_rows``), the task that holds it joins them one by one, instead of a
    dozen jobs a round for fewer and fewer rows. The pointers of all rounds are then followed once,
    from the smallest table to the largest. Every table has as many parts as its rows need.
    """
    current, left = cut_to_size(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    )
    pointers: list[DataFrame] = []
    while left:
        if len(pointers) >= max_rounds:
            raise RuntimeError(f"components not settled after {max_rounds} rounds")
        if left <= part_rows:
            pointers.append(_settled(current))
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        salt = F.lit(len(pointers))
        of_v, of_u = F.xxhash64("v", salt), F.xxhash64("u", salt)
        lowest = fitted(both.groupBy("u").agg(F.min_by("v", of_v).alias("best"), F.min(of_v).alias("priority")), left)
        once = lowest.select("u", F.when(of_u <= F.col("priority"), F.col("u")).otherwise(F.col("best")).alias("p"))
        # two pointers at a time; derived from the checkpointed edges whenever it is needed again
        twice = once.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        step = fitted(once.join(twice, "p").select("u", F.col("pp").alias("p")), left)
        pointers.append(step)
        moved = current.join(step, "u").select(F.col("p").alias("pu"), "v")
        step_v = step.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        moved = fitted(moved, left).join(step_v, "v").filter("pu <> pv")
        current, left = cut_to_size(moved.select(
            F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")
        ).distinct())
    root = None
    for step in reversed(pointers):
        if root is None:
            root = step.select("u", F.col("p").alias("root"))
        else:
            onward = root.select(F.col("u").alias("p"), F.col("root").alias("_root"))
            root, _ = cut_to_size(step.join(onward, "p", "left").select("u", F.coalesce("_root", "p").alias("root")))
    ids = nodes.select("id").distinct()
    if root is None:
        return ids.select("id", F.col("id").alias("component"))
    placed = ids.join(root.withColumnRenamed("u", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = placed.groupBy("root").agg(F.min("id").alias("component"))
    return placed.join(smallest, "root").select("id", "component")


def _similar(left: _Side, right: _Side, threshold: float, link: bool, foreign: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """Pairs of rows at or above the threshold; with ``link`` one pair per two groups that have any.

    Rows on both sides meet twice and count where the left name is smaller; ``foreign`` rows of the
    left are on that side only and count always.
    """
    for start in range(0, len(left.ids), _TILE):
        for low in range(0, len(right.ids), _TILE):
            rows, columns = slice(start, start + _TILE), slice(low, low + _TILE)
            similarity = left.vectors[rows] @ right.vectors[columns].T
            a, b = (left.carried, right.carried) if link else (left.ids, right.ids)
            a, b = a[rows], b[columns]
            at = np.nonzero(similarity >= threshold - _ROUNDING)
            similarity = np.round(similarity[at], 12)
            counts = a[at[0]] < b[at[1]]
            if foreign is not None:
                counts |= foreign[rows][at[0]] & (a[at[0]] != b[at[1]])
            counts &= similarity >= threshold
            if counts.any():
                at, similarity = (at[0][counts], at[1][counts]), similarity[counts]
                found = pd.DataFrame({"a": np.minimum(a[at[0]], b[at[1]]), "b": np.maximum(a[at[0]], b[at[1]]), "similarity": similarity})
                yield found.drop_duplicates(["a", "b"]) if link else found


def _one_per_copy(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the smallest id of every distinct vector, edges from it to its exact copies).

    Vectors meet by a digest of 128 bits and are then compared: one that only shares the digest
    of another is a vector of its own.
    """
    entries = F.transform("embedding", lambda x: x + F.lit(0.0))  # -0.0 is 0.0
    held = _as_input(points, "id").drop("carried").select(
        "id", "embedding", F.xxhash64(entries).alias("_high"), F.xxhash64(F.lit(1), entries).alias("_low"))
    first = held.groupBy("_high", "_low").agg(F.min("id").alias("first"), F.min_by("embedding", "id").alias("_like"))
    met = held.join(first, ["_high", "_low"])
    met = cut(met.select("id", "embedding", F.when(F.col("embedding") == F.col("_like"), F.col("first")).otherwise(
        F.col("id")).alias("first")))
    copies = met.filter("id <> first").select(
        F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return met.filter("id = first").select("id", "embedding"), copies


def similar_edges(points: DataFrame, threshold: float, broadcast_bytes: int = BROADCAST_BYTES,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, similarity) of distinct vectors whose cosine reaches the threshold, a < b.

    Of exact copies the one with the smallest id stands for all; ``representatives`` says for
    whom. The two tables hold every pair without listing those of a group of copies;
    ``all_pairs`` lists them.
    """
    distinct, _ = _one_per_copy(points)
    held = distinct.withColumn("carried", F.col("id"))
    return _compared(held, threshold, False, broadcast_bytes, block_rows)


def representatives(points: DataFrame) -> DataFrame:
    """(id, representative): the smallest id with the same vector, for every point."""
    distinct, copies = _one_per_copy(points)
    own = distinct.select("id", F.col("id").alias("representative"))
    return own.unionByName(copies.select(F.col("b").alias("id"), F.col("a").alias("representative")))


def all_pairs(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Every pair (a, b, similarity), a < b, that ``similar_edges`` and ``representatives`` stand for.

    Rows grow with the square of a group of copies: for small groups and for tests.
    """
    left = members.select(F.col("representative").alias("a"), F.col("id").alias("i"))
    right = members.select(F.col("representative").alias("b"), F.col("id").alias("j"))
    across = edges.join(left, "a").join(right, "b").select("i", "j", "similarity")
    copies = left.join(right, F.col("a") == F.col("b")).filter("i < j").select("i", "j", F.lit(1.0).alias("similarity"))
    return across.unionByName(copies).select(
        F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "similarity")


def linking_edges(points: DataFrame, threshold: float, broadcast_bytes: int = BROADCAST_BYTES,
                  block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """(a, b) with the same components as all pairs at or above the threshold, but far fewer edges.

    Two points within half the threshold angle of one pivot are similar to each other. So
    everything that close to a pivot is one group, tied to the pivot by one edge per point, and
    two groups need one edge at most. A crowd of near copies then gives as many edges as it has
    points; points near no pivot are groups of their own and compared like any other.
    """
    distinct, copies = _one_per_copy(points)
    # a bounded sample: ``pivots`` rows at most
    sample = distinct.orderBy(F.xxhash64("id"), "id").limit(pivots).toPandas()
    half_angle = np.arccos(np.clip(threshold, -1.0, 1.0)) / 2.0 - 1e-9  # a little less against rounding
    close = float(np.cos(max(half_angle, 0.0)))
    shared = points.sparkSession.sparkContext.broadcast(_apart(_Side.of(sample.assign(carried=sample["id"])), close))

    def group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = shared.value
        for batch in batches:
            own = batch["id"].to_numpy(np.int64)
            if len(ids) and len(batch):
                cosine = _unit_rows(batch["embedding"]) @ vectors.T
                best = cosine.argmax(axis=1)
                near = cosine[np.arange(len(batch)), best] >= close
                own = np.where(near, ids[best], own)
            yield batch.assign(carried=own)

    grouped = cut(distinct.mapInPandas(group, "id long, embedding array<double>, carried long"))
    stars = grouped.filter("carried <> id").select(F.col("carried").alias("a"), F.col("id").alias("b"))
    links = _compared(grouped, threshold, True, broadcast_bytes, block_rows).select("a", "b").distinct()
    return links.unionByName(stars).unionByName(copies.select("a", "b"))


def _apart(sample: _Side, close: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of sampled rows none of which is close to an earlier one."""
    kept: list[int] = []
    for at in range(len(sample.ids)):
        if not kept or (sample.vectors[kept] @ sample.vectors[at]).max() < close:
            kept.append(at)
    return sample.ids[kept], sample.vectors[kept] if kept else sample.vectors


def _compared(points: DataFrame, threshold: float, link: bool, broadcast_bytes: int, block_rows: int) -> DataFrame:
    """Edges among distinct vectors (id, embedding, carried), over a broadcast or over blocks."""
    count, size = size_of(points)
    if size <= broadcast_bytes:
        # under the size check
        shared = points.sparkSession.sparkContext.broadcast(_Side.of(points.toPandas()).arrays())

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            every = _Side(*shared.value)
            for batch in batches:
                if len(batch):
                    yield from _similar(_Side.of(batch), every, threshold, link)

        return points.mapInPandas(search, _EDGE)

    # visitors of a bin: its own points, and those of earlier bins that some member may be similar to
    cells, members = around_pivots(points, count, block_rows)

    def meet(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(some) and len(others):
            found = list(_similar(_Side.of(some), _Side.of(others), threshold, link, some["foreign"].to_numpy(bool)))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"a": [], "b": [], "similarity": []})

    met = meetings(visitors_within(members, cells, threshold), members, cells).applyInPandas(meet, _EDGE)
    return met.dropDuplicates(["a", "b"]) if link else met


def visitors_within(members: DataFrame, cells: Cells, threshold: float) -> DataFrame:
    """``members`` with the ``bin`` they meet: their own, and (``foreign``) later ones with cells within the threshold's angle."""
    shared, bins = members.sparkSession.sparkContext.broadcast(cells.arrays()), cells.bins()
    widest = float(np.arccos(np.clip(threshold, -1.0, 1.0))) + SLACK
    number, starts = np.arange(int(bins.max()) + 1), np.flatnonzero(np.diff(bins, prepend=-1))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = Cells(*shared.value)
        for batch in batches:
            for start in range(0, len(batch), _TILE):
                tile = batch.iloc[start : start + _TILE]
                vectors, own = _unit_rows(tile["embedding"]), bins[tile["cell"].to_numpy()]
                near = np.logical_or.reduceat((cells.floors(vectors) <= widest) & (cells.counts > 0), starts, axis=1)
                visited = (number > own[:, None]) & near
                visited |= number == own[:, None]
                row, at = np.nonzero(visited)
                yield tile.iloc[row].assign(bin=at.astype(np.int32), foreign=at != own[row])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema.fields)
    return members.mapInPandas(choose, f"{fields}, bin int, foreign boolean")
