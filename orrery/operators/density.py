"""Density clustering of 3-D points on a grid.

The grid cell is small enough that any two points of one cell are within ``eps``. A cell with
``min_samples`` points is therefore all core and all one cluster without looking at a single
pair, and only questions between neighbouring cells are left: how many points a thin cell's
point reaches, and whether two cells hold a close pair of core points. Both are answered from
bounding boxes, which are halved until the boxes that stay open are small enough to compare
point by point. So the work per cell does not grow with the square of what it holds, and
points with equal coordinates are one site with a weight from the start.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from orrery.operators.graphs import connected_components
from orrery.operators.positions import with_position
from orrery.session import cut

AXES = ("x", "y", "z")
NOISE = -1
PAIR_BUDGET = 200_000_000  # open comparisons above this are refined before points are compared
MAX_LEVEL = 12


def auto_sizes(n: int) -> tuple[int, int]:
    """(min_size, min_samples) for n points."""
    min_size = max(10, min(500, n // 500))
    return min_size, max(5, min(50, min_size // 5))


def auto_eps(points: DataFrame, min_samples: int) -> float:
    """Radius at which an even spread over the occupied box would give ``min_samples`` neighbours."""
    row = points.agg(
        F.count(F.lit(1)).alias("n"), *[(F.max(a) - F.min(a)).cast("double").alias(a) for a in AXES]
    ).first()
    if not row["n"]:
        return 1.0
    volume = math.prod(max(row[a], 1e-9) for a in AXES)
    return max(1e-9, (volume * min_samples / row["n"] * 3.0 / (4.0 * math.pi)) ** (1.0 / 3.0))


def _key(level: int, side: float) -> Column:
    scale = float(2**level) / side
    return F.struct(*[F.floor(F.col(a) * F.lit(scale)).cast("long").alias(a) for a in AXES])


def _parent(key: str) -> Column:
    return F.struct(*[F.shiftright(F.col(f"{key}.{a}"), 1).alias(a) for a in AXES])


def _boxes(sites: DataFrame, level: int, side: float) -> DataFrame:
    bounds = [f(a).alias(f"{name}_{a}") for a in AXES for name, f in (("lo", F.min), ("hi", F.max))]
    return sites.groupBy(_key(level, side).alias("key")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("sites"), *bounds
    )


def _as_side(boxes: DataFrame, prefix: str) -> DataFrame:
    return boxes.select(*[F.col(c).alias(f"{prefix}_{c}") for c in boxes.columns])


def _far(a: str, b: str) -> Column:
    """Square of the largest distance between two boxes."""
    total = F.lit(0.0)
    for axis in AXES:
        reach = F.greatest(
            F.col(f"{a}_hi_{axis}") - F.col(f"{b}_lo_{axis}"), F.col(f"{b}_hi_{axis}") - F.col(f"{a}_lo_{axis}")
        )
        total = total + reach * reach
    return total


def _near(a: str, b: str) -> Column:
    """Square of the smallest distance between two boxes."""
    total = F.lit(0.0)
    for axis in AXES:
        gap = F.greatest(
            F.lit(0.0),
            F.col(f"{a}_lo_{axis}") - F.col(f"{b}_hi_{axis}"),
            F.col(f"{b}_lo_{axis}") - F.col(f"{a}_hi_{axis}"),
        )
        total = total + gap * gap
    return total


def _to_neighbours(cells: DataFrame, key: str, half: bool) -> DataFrame:
    """Every row once per cell around its own that can hold a point within eps; with ``half``
    once for each two opposite cells."""
    steps = cells
    for axis in AXES:
        steps = steps.withColumn(f"_{axis}", F.explode(F.expr("sequence(-2, 2)")))
    ahead = "(_x > 0) OR (_x = 0 AND _y > 0) OR (_x = 0 AND _y = 0 AND _z > 0)"
    steps = steps.filter(ahead if half else "_x <> 0 OR _y <> 0 OR _z <> 0")
    shifted = F.struct(*[(F.col(f"{key}.{axis}") + F.col(f"_{axis}")).alias(axis) for axis in AXES])
    return steps.withColumn("b_key", shifted).drop("_x", "_y", "_z")


def _distance(a: str, b: str) -> Column:
    return sum(
        ((F.col(f"{a}_{x}") - F.col(f"{b}_{x}")) * (F.col(f"{a}_{x}") - F.col(f"{b}_{x}")) for x in AXES), F.lit(0.0)
    )


def _reached(probes: DataFrame, sites: DataFrame, side: float, limit: Column, need: int,
             pair_budget: int) -> DataFrame:
    """Probe sites (x, y, z) with at least ``need`` points of other cells and their own within eps."""
    point = F.struct(*AXES)
    spread = probes.select(
        point.alias("probe"), F.col("own").alias("sure"),
        *[F.col(a).alias(f"p_lo_{a}") for a in AXES], *[F.col(a).alias(f"p_hi_{a}") for a in AXES],
        _key(0, side).alias("home"),
    )
    spread = _to_neighbours(spread, "home", half=False)
    sure = probes.select(point.alias("probe"), F.col("own").alias("sure"))
    held = ["probe", *[f"p_lo_{a}" for a in AXES], *[f"p_hi_{a}" for a in AXES]]
    level = 0
    open_ = spread.select(*held, "b_key").join(_as_side(_boxes(sites, 0, side), "b"), "b_key")
    while True:
        judged = cut(open_.filter(_near("p", "b") <= limit).withColumn("inside", _far("p", "b") <= limit))
        certain = judged.filter("inside").groupBy("probe").agg(F.sum("b_n").alias("more"))
        sure = sure.join(certain, "probe", "left").select(
            "probe", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("sure")
        )
        unsettled = sure.filter(F.col("sure") < need).select("probe")
        rest = judged.filter("not inside").join(unsettled, "probe", "left_semi")
        work = rest.agg(F.coalesce(F.sum("b_sites"), F.lit(0)).alias("w")).first()["w"]
        if work <= pair_budget or level >= MAX_LEVEL:
            break
        level += 1
        finer = _as_side(_boxes(sites, level, side), "b").withColumn("parent", _parent("b_key"))
        open_ = rest.select(*held, F.col("b_key").alias("parent")).join(finer, "parent").drop("parent")
    near = sites.select(
        _key(level, side).alias("b_key"), F.col("n").alias("s_n"), *[F.col(a).alias(f"s_{a}") for a in AXES]
    )
    exact = (
        rest.select("probe", "b_key", *[F.col(f"p_lo_{a}").alias(f"q_{a}") for a in AXES])
        .join(near, "b_key").filter(_distance("q", "s") <= limit)
        .groupBy("probe").agg(F.sum("s_n").alias("more"))
    )
    total = sure.join(exact, "probe", "left").select(
        "probe", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("sure")
    )
    return total.filter(F.col("sure") >= need).select("probe.*")


def _linked_cells(core: DataFrame, side: float, limit: Column, pair_budget: int) -> DataFrame:
    """Pairs of neighbouring cells (a0, b0) with core points within eps of each other."""
    boxes = _boxes(core, 0, side)
    left = _to_neighbours(_as_side(boxes, "a"), "a_key", half=True)
    open_ = left.join(_as_side(boxes, "b"), "b_key").withColumn("a0", F.col("a_key")).withColumn("b0", F.col("b_key"))
    level, linked = 0, None
    while True:
        judged = cut(open_.filter(_near("a", "b") <= limit).withColumn("linked", _far("a", "b") <= limit))
        found = judged.filter("linked").select("a0", "b0").distinct()
        linked = found if linked is None else linked.unionByName(found).distinct()
        rest = judged.join(linked, ["a0", "b0"], "left_anti")
        work = rest.agg(F.coalesce(F.sum(F.col("a_sites") * F.col("b_sites")), F.lit(0)).alias("w")).first()["w"]
        if work <= pair_budget or level >= MAX_LEVEL:
            break
        level += 1
        finer = _boxes(core, level, side).withColumn("parent", _parent("key"))
        open_ = (
            rest.select("a0", "b0", F.col("a_key").alias("a_parent"), F.col("b_key").alias("b_parent"))
            .join(_as_side(finer, "a"), "a_parent").join(_as_side(finer, "b"), "b_parent")
            .drop("a_parent", "b_parent")
        )
    at = core.select(_key(level, side).alias("key"), *AXES)
    close = (
        rest.select("a0", "b0", "a_key", "b_key")
        .join(_as_side(at, "a"), "a_key").join(_as_side(at, "b"), "b_key")
        .filter(_distance("a", "b") <= limit).select("a0", "b0").distinct()
    )
    return linked.unionByName(close).distinct()


def dbscan(points: DataFrame, eps: float, min_samples: int, min_size: int = 1,
           pair_budget: int = PAIR_BUDGET) -> DataFrame:
    """(id, cluster) of points (id, x, y, z): core points within eps of each other share a cluster.

    A point is core with ``min_samples`` points, itself included, within eps. Points that are not
    core, and clusters below ``min_size``, are noise (-1). Clusters are numbered by size.
    """
    side, limit = eps / math.sqrt(3.0), F.lit(float(eps) ** 2)
    # adding 0.0 turns -0.0 into 0.0, so equal places are one site
    located = points.select("id", *[(F.col(a).cast("double") + 0.0).alias(a) for a in AXES])
    sites = cut(located.groupBy(*AXES).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")))
    own = sites.groupBy(_key(0, side).alias("cell")).agg(F.sum("n").alias("own"))
    placed = sites.withColumn("cell", _key(0, side)).join(own, "cell")
    crowded = placed.filter(F.col("own") >= min_samples)
    thin = placed.filter(F.col("own") < min_samples)
    reached = _reached(thin, sites, side, limit, min_samples, pair_budget)
    core = cut(crowded.drop("own").unionByName(thin.drop("own").join(reached, list(AXES), "left_semi")))
    cells = core.groupBy("cell").agg(F.min("first").alias("id"))
    links = _linked_cells(core, side, limit, pair_budget)
    ends = links.join(cells.select(F.col("cell").alias("a0"), F.col("id").alias("a")), "a0").join(
        cells.select(F.col("cell").alias("b0"), F.col("id").alias("b")), "b0"
    )
    component = connected_components(cells, ends.select("a", "b"))
    of_site = core.join(cells.join(component, "id").drop("id"), "cell").select(*AXES, "n", "component")
    sizes = of_site.groupBy("component").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_size)
    numbered = with_position(sizes, [F.col("n").desc(), "component"], "cluster")
    labelled = of_site.join(numbered.drop("n"), "component").select(*AXES, F.col("cluster").cast("int"))
    return located.join(labelled, list(AXES), "left").select(
        "id", F.coalesce("cluster", F.lit(NOISE)).alias("cluster")
    )
