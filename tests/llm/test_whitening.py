import math

import numpy as np
import pytest

from orrery.llm import whitening
from orrery.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, id string, x long, n int"


def dense(vectors, components=32):
    """The same by a dense eigen-solver: (kept vectors, eigenvalues, eigenvectors, exact deviations)."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[float(n * a - s) / n for a, s in zip(row, sums, strict=True)] for row in x])
    values, turned = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:components]
    return centred, values[order], turned[:, order], deviation, values.sum()


def check(found, ids, vectors, components=32):
    centred, values, turned, deviation, trace = dense(vectors, components)
    size = int(np.count_nonzero(values > 1e-12 * values[0]))
    assert len(found) == len(ids) * size
    at = {key: i for i, key in enumerate(ids)}
    table = np.zeros((len(ids), size))
    for row in found:
        i, c = at[row.vec_id], row.component - 1
        table[i, c] = row.whitened
        assert (row.n, row.deviation) == (len(ids), deviation[i])
        assert row.explained == pytest.approx(values[c] / trace, rel=1e-9)
        assert row.identity_error < 1e-9
    own = centred @ turned[:, :size] / np.sqrt(values[:size])
    apart = np.diff(values[: size + 1]) / values[:size][: len(np.diff(values[: size + 1]))]
    for c in range(size):
        near = min([abs(apart[j]) for j in (c - 1, c) if 0 <= j < len(apart)], default=1)
        if near > 1e-3:  # not one of several components with like variances
            sign = np.sign(own[:, c] @ table[:, c])
            assert np.abs(sign * own[:, c] - table[:, c]).max() < 1e-7
    assert np.abs(table.T @ table / len(ids) - np.eye(size)).max() < 1e-9


@pytest.mark.parametrize("dimensions", [1, 5, 40])
def test_against_a_dense_solver(spark, dimensions):
    draw = np.random.default_rng(dimensions)
    vectors = draw.standard_normal((300, dimensions)) * np.linspace(0.3, 4, dimensions)
    rows = [(i, v.tolist(), "c", 1, 1) for i, v in enumerate(vectors)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    check(found, list(range(300)), vectors)


def test_equal_variances_and_flat_directions(spark):
    vectors = [[s * 1.0 if j == i else 0.0 for j in range(6)] + [0.25, 2.0 * s if i == 0 else 0.0] for i in range(6) for s in (-1, 1)]
    rows = [(i, v, "c", 1, 1) for i, v in enumerate(vectors)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert max(row.component for row in found) == 6
    table = np.zeros((len(vectors), 6))
    for row in found:
        table[row.vec_id, row.component - 1] = row.whitened
    assert np.abs(table.T @ table / len(vectors) - np.eye(6)).max() < 1e-9


def test_rows_that_do_not_count(spark):
    good = [[0.1 * i, 1.0 - i * i, math.sin(i)] for i in range(20)]
    rows = [(i, v, "c", 1, 1) for i, v in enumerate(good)]
    odd = [None, [], [1.0, None, 2.0], [math.nan, 1.0, 2.0], [math.inf, 0.0, 0.0], [1e300, 0.0, 0.0], [1.0, 2.0]]
    rows += [(100 + i, v, "c", 1, 1) for i, v in enumerate(odd)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    check(found, list(range(20)), good)


def test_repeated_and_null_ids_and_equal_vectors(spark):
    rows = [(1, [1.0, 2.0], "c", 1, 1), (1, [1.0, 2.0], "c", 1, 1), (None, [3.0, -1.0], "c", 1, 1)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in found) == [(0, 1, 3), (1, 1, 3), (1, 1, 3)]
    equal = [(i, [0.5, 0.5], "c", 1, 1) for i in range(4)]
    assert whitening.whiten(spark.createDataFrame(equal, SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    found = QUERIES["op13_embedding_whitening"](spark, folder).collect()
    check(found, [r.vec_id for r in table], [r.embedding for r in table])
