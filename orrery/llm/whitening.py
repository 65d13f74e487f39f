"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Every step is one pass over the stored rows: a row is centred, multiplied with the right vector (X v),
and its share of X'u is summed. The left vector u has one entry per row and is never gathered: it
is a row's product with a small coefficient vector c (u = X c), so the pass that makes u also
measures its products with all earlier left vectors, and u is reorthogonalised against them exactly
(in c, X'u and the norm, which are linear in it). Right vectors are reorthogonalised twice. After one
step per dimension (a chain that breaks off goes on from a new vector orthogonal to all so far) the
SVD of the small bidiagonal matrix gives components and deviations.

Entries are whole numbers floor(scale * c) + shift, so counts, sums and the deviation of a row are
exact; rows are centred by the whole part of the mean first, then by the rest.

Defined results: rows whose vector is null, empty, or holds a null, a non-finite entry or one too
large for 53 bits are left out, as are vectors of another length than most have (of equally
frequent lengths the larger one counts). Null and repeated ids are rows like others. Directions
without variance give no component, so an empty table or equal vectors give none at all; a
deviation that does not fit 64 bits is null. Only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orrery.session import fresh_path

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
FLAT = 1e-13  # variances below this share of the largest are none
LARGEST = float(1 << 46)


@dataclass
class Whitening:
    """Components by falling variance, from ``n`` rows with the given sums."""

    n: int
    sums: list[int]
    components: np.ndarray  # dimensions x components
    variances: np.ndarray
    trace: float
    identity_error: float

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.trace if self.trace else self.variances


def whole_numbers(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE,
                  shift: int = SHIFT) -> DataFrame:
    """(id, x): the usable vectors as whole numbers, stored in the shared folder as they are read many times."""
    entry = F.col("vector")
    held = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    held = held.filter((F.size(entry) > 0) & F.forall(
        entry, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LARGEST / scale), F.lit(False))))
    length = F.size(entry)
    usual = held.groupBy(length.alias("length")).agg(F.count(F.lit(1)).alias("rows")).orderBy(
        F.desc("rows"), F.desc("length")).first()  # one row
    held = held.filter(length == (usual["length"] if usual else 0))
    x = F.transform(entry, lambda c: F.floor(c * float(scale)).cast("long") + F.lit(shift).cast("long"))
    path = fresh_path(vectors.sparkSession, "vectors")
    held.select("id", x.alias("x")).write.parquet(path)
    return vectors.sparkSession.read.parquet(path)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], size: int, kind: str = "double") -> np.ndarray:
    """Sum over all rows of what ``part`` gives for a block of them; one short list per task is shuffled."""
    number = np.int64 if kind == "long" else np.float64

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=number)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["at", "value"])

    sums = rows.select("x").mapInArrow(add, f"at int, value {kind}").groupBy("at").agg(F.sum("value").alias("value"))
    found = np.zeros(size, dtype=number)
    for row in sums.collect():  # ``size`` rows
        found[row["at"]] = row["value"]
    return found


def _centring(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Whole part and rest of the mean."""
    whole = np.array([total // n for total in sums], dtype=np.int64)
    return whole, np.array([total % n / n for total in sums])


def _bidiagonalised(rows: DataFrame, centre, dimensions: int, norm: float) -> tuple[np.ndarray, np.ndarray]:
    """(V, B) with X V = U B, V square and orthogonal, B upper bidiagonal; one pass over the rows per column."""
    whole, rest = centre
    context = rows.sparkSession.sparkContext
    draw = np.random.default_rng(0)
    right = np.zeros((dimensions, 0))
    lefts = np.zeros((dimensions, 0))  # u = X c: the vectors c
    shadows = np.zeros((dimensions, 0))  # X'u
    diagonal, above = [], []

    def orthogonal(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - right @ (right.T @ v)
        return v

    def chain_start() -> np.ndarray:
        v = orthogonal(draw.standard_normal(dimensions))
        while np.linalg.norm(v) < 1e-8:
            v = orthogonal(draw.standard_normal(dimensions))
        return orthogonal(v / np.linalg.norm(v))

    v, beta = chain_start(), 0.0
    while True:
        v = v / np.linalg.norm(v)
        c = v - lefts @ (shadows.T @ v)
        shared = context.broadcast((whole, rest, np.column_stack([lefts, c])))

        def step(x: np.ndarray) -> np.ndarray:
            first, second, coefficients = shared.value
            centred = (x - first) - second
            products = centred @ coefficients
            u = products[:, -1]
            return np.concatenate([products.T @ u, centred.T @ u])

        found = _summed(rows, step, lefts.shape[1] + 1 + dimensions)
        shared.unpersist()
        overlap, square, shadow = found[: lefts.shape[1]], found[lefts.shape[1]], found[lefts.shape[1] + 1 :]
        c, shadow = c - lefts @ overlap, shadow - shadows @ overlap
        alpha = float(np.sqrt(max(square - overlap @ overlap, 0.0)))
        right = np.column_stack([right, v])
        above.append(beta)
        if alpha <= 1e-14 * norm:  # X v lies among the left vectors so far
            diagonal.append(0.0)
            w = np.zeros(dimensions)
        else:
            diagonal.append(alpha)
            lefts, shadows = np.column_stack([lefts, c / alpha]), np.column_stack([shadows, shadow / alpha])
            w = orthogonal(shadow / alpha)
        if right.shape[1] == dimensions:
            break
        beta = float(np.linalg.norm(w))
        if beta <= 1e-13 * norm:
            v, beta = chain_start(), 0.0
        else:
            v = orthogonal(w / beta)
    return right, np.diag(diagonal) + np.diag(above[1:], 1)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The components of ``whole_numbers``, up to ``components`` with variance."""
    head = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    n, dimensions = head["n"], head["d"] or 0
    if not n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    sums = [int(total) for total in _summed(rows, lambda x: x.sum(axis=0), dimensions, "long")]
    whole, rest = centre = _centring(n, sums)
    square = float(_summed(rows, lambda x: np.array([np.square((x - whole) - rest).sum()]), 1)[0])
    if not square:
        return Whitening(n, sums, np.zeros((dimensions, 0)), np.zeros(0), 0.0, 0.0)
    right, small = _bidiagonalised(rows, centre, dimensions, np.sqrt(square))
    _, deviations, turned = np.linalg.svd(small)
    variances = np.square(deviations) / n
    kept = int(np.count_nonzero(variances[:components] > FLAT * variances[0]))
    vectors = right @ turned[:kept].T
    model = Whitening(n, sums, vectors, variances[:kept], square / n, 0.0)
    return _measured(rows, model, centre)


def _measured(rows: DataFrame, model: Whitening, centre) -> Whitening:
    """The model with the largest entry of the covariance of its whitened rows minus the identity."""
    whole, rest = centre
    turn = model.components / np.sqrt(model.variances)
    size = turn.shape[1]

    def products(x: np.ndarray) -> np.ndarray:
        y = ((x - whole) - rest) @ turn
        return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])

    found = _summed(rows, products, size * size + size) / model.n
    mean = found[size * size :]
    covariance = found[: size * size].reshape(size, size) - np.outer(mean, mean)
    error = float(np.abs(covariance - np.eye(size)).max()) if size else 0.0
    return Whitening(model.n, model.sums, model.components, model.variances, model.trace, error)


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, whitened): one row per row of ``rows``, one entry of ``whitened`` per component."""
    kind = rows.schema["id"].dataType.simpleString()
    if not model.n:
        return rows.sparkSession.createDataFrame([], f"id {kind}, deviation long, whitened array<double>")
    whole, rest = _centring(model.n, model.sums)
    left = np.array([total % model.n for total in model.sums], dtype=np.int64)
    n, turn = model.n, model.components / np.sqrt(model.variances)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            apart = _matrix(batch.column(1)) - whole
            large = np.square(n * apart.astype(np.float64) - left).sum(axis=1) >= 9e18
            deviation = np.where(large, 0, np.square(n * np.where(large[:, None], 0, apart) - left).sum(axis=1))
            at = (apart - rest) @ turn
            size = at.shape[1]
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(at) + 1, dtype=np.int32) * size), pa.array(np.ascontiguousarray(at).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(deviation, pa.int64(), mask=large), lists], ["id", "deviation", "whitened"])

    return rows.select("id", "x").mapInArrow(place, f"id {kind}, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): one row per vector and component, from 1."""
    rows = whole_numbers(vectors, id_column, vector_column, scale, shift)
    model = fit(rows, components)
    explained = F.array(*[F.lit(float(share)) for share in model.explained]).cast("array<double>")
    placed = whitened(rows, model).select(
        F.col("id"), "deviation", F.posexplode(F.arrays_zip(F.col("whitened"), explained.alias("explained"))).alias("at", "entry"))
    return placed.select(
        F.col("id").alias(id_column), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
        "deviation", F.col("entry.whitened").alias("whitened"), F.col("entry.explained").alias("explained"),
        F.lit(model.identity_error).alias("identity_error"))
