"""Parity sketches of sets, and rows met in groups that a sort has put together.

A sketch holds for each of a fixed number of cells whether an odd number of the set's hashes falls into it. The
cells in which two sketches differ are never more than the elements in which the sets differ, so a pair
that is too far apart can be left out without its sets, and never one that is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CELLS = 2048


def binary_rows(rows: np.ndarray) -> pa.Array:
    """A binary value per row of a two-dimensional array."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.dtype.itemsize
    at = pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, at, pa.py_buffer(rows.tobytes())])


def array_rows(column: pa.Array, kind) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1), dtype=kind)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def parities(sets: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """Per set whether an odd number of its shingles falls into each of ``cells`` cells, as packed bits."""
    rows = np.zeros((len(sets), cells), dtype=np.uint8)
    for row, hashes in zip(rows, sets, strict=True):
        row[:] = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % cells, minlength=cells) & 1
    return np.packbits(rows, axis=1)


def groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """Neighbouring rows with equal first ``columns`` columns, which a sort has put together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(i).to_numpy() for i in range(columns)])
        starts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        edges = [0, *starts.tolist(), batch.num_rows]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(keys[low].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = key
    if held:
        yield pa.Table.from_batches(held)
