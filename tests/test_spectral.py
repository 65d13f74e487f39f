"""The spectral layout against a dense eigen-solver, and what it keeps of neighbourhoods."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import layout, neighbours, spectral


def curve(count, seed=0):
    """Points along a curve that winds through 12 dimensions."""
    source = np.random.default_rng(seed)
    t = np.sort(source.random(count))
    rows = np.column_stack([f(2 * np.pi * m * t) for m in range(1, 7) for f in (np.cos, np.sin)])
    return rows + source.normal(scale=0.01, size=rows.shape)


def framed(spark, rows):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(rows)], "id long, embedding array<double>")


@pytest.mark.parametrize("dims", [2, 3])
def test_like_a_dense_solver(spark, dims):
    table = neighbours.graph(framed(spark, curve(150)), 8, straight=True).cache()
    found = {r["id"]: [r[a] for a in spectral.AXES[:dims]] for r in spectral.layout(table, dims).collect()}
    rows = table.collect()
    n, scale = 150, {}
    for r in rows:
        scale[r["id"]] = max(scale.get(r["id"], 0.0), r["distance"])
    weight = np.zeros((n, n))
    for r in rows:
        i, j = r["id"], r["neighbour"]
        weight[i, j] = weight[j, i] = max(weight[i, j], np.exp(-r["distance"] ** 2 / (scale[i] * scale[j])))
    degree = weight.sum(axis=1)
    values, vectors = np.linalg.eigh(weight / np.sqrt(np.outer(degree, degree)))
    order = np.argsort(values)[::-1][1 : dims + 1]
    expected = vectors[:, order] / np.sqrt(degree)[:, None] * np.sqrt(degree.sum())
    expected *= np.where((expected**3).sum(axis=0) >= 0, 1.0, -1.0)
    assert np.abs(np.array([found[i] for i in range(n)]) - expected).max() < 1e-4


def test_keeps_more_neighbours_than_a_projection(spark):
    points = framed(spark, curve(300, seed=3))
    table = neighbours.graph(points, 10, straight=True).cache()
    shares = [
        spectral.neighbours_kept(table, places, 10).first()["kept"]
        for places in (spectral.layout(table, 2), layout.project(points.select("id", F.col("embedding").alias("vector")), 2))]
    assert shares[0] > 0.6 and shares[0] > shares[1]


def test_several_parts_equal_points_and_nothing(spark):
    rows = np.concatenate([np.zeros((6, 2)), np.full((7, 2), 50.0), np.full((1, 2), 51.0)])
    table = neighbours.graph(framed(spark, rows), 3, straight=True).cache()
    found = {r["id"]: r["x"] for r in spectral.layout(table, 2).collect()}
    assert len(found) == 14 and all(np.isfinite(list(found.values())))
    assert len({round(found[i], 3) for i in range(6)}) == 1 and abs(found[0] - found[8]) > 0.5
    assert spectral.layout(table.limit(0)).count() == 0
