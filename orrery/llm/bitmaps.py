"""Bitmaps of a fixed size that keep rows which surely meet nothing out of a shuffle.

They may let a row through that meets nothing, so an exact comparison always follows. Arrays of a
fixed number of cells travel as packed segments and are merged in two steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orrery.llm.words import mix
from orrery.session import shuffles_freed

BITS = 26
SEGMENT = 1 << 14
MERGE_WAYS = 64
MERGE_TASKS = 16


def segments(cells: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(at, cells) of the stretches of a 32-bit array that are not all 0, packed."""
    for at in range(0, len(cells), SEGMENT):
        part = cells[at : at + SEGMENT]
        if part.any():
            packed = zlib.compress(part.astype(np.uint32).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([packed], pa.binary())], ["at", "cells"])


def merged(parts: DataFrame, count: int, add: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """``count`` cells (a number that no input changes) from the ``segments`` of all tasks, those of
    one place put together by ``add``; in two steps, so that no group holds a segment of every task."""
    def join(table: pa.Table) -> pa.Table:
        total = None
        for part in table.column("cells"):
            cells = np.frombuffer(zlib.decompress(part.as_py()), dtype=np.uint32)
            total = cells if total is None else add(total, cells)
        packed = zlib.compress(total.tobytes(), 1)
        return pa.table({"at": table.column("at")[:1], "way": table.column("way")[:1], "cells": pa.array([packed], pa.binary())})

    some = parts.withColumn("way", F.spark_partition_id() % MERGE_WAYS).select("at", "way", "cells")
    # groups of a fixed number: no more tasks than keep all cores busy
    busy = max(MERGE_TASKS, 4 * parts.sparkSession.sparkContext.defaultParallelism)
    some = some.groupBy("at", "way").applyInArrow(join, "at int, way int, cells binary").coalesce(busy)
    whole = some.groupBy("at").applyInArrow(join, "at int, way int, cells binary").coalesce(MERGE_TASKS)
    cells = np.zeros(count, dtype=np.uint32)
    with shuffles_freed(parts.sparkSession):
        rows = whole.select("at", "cells").collect()  # a fixed number of segments, packed
    for row in rows:
        cells[row.at : row.at + SEGMENT] = np.frombuffer(zlib.decompress(row.cells), dtype=np.uint32)
    return cells


def of(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """``2 ** bits`` bits with those of all ``keys`` (one long column) set, 32 to a cell."""
    count = 1 << (bits - 5)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(count, dtype=np.uint32)
        for batch in batches:
            at = _place(batch.column(0).to_numpy(), bits)
            np.bitwise_or.at(cells, at >> 5, np.uint32(1) << (at & 31).astype(np.uint32))
        yield from segments(cells)

    return merged(keys.mapInArrow(mark, "at int, cells binary"), count, np.bitwise_or)


def _place(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(np.ascontiguousarray(keys).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def holds(cells: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _place(keys, len(cells).bit_length() - 1 + 5)
    return (cells[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) != 0
