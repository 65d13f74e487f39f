"""Words, lines and n-grams of whole Arrow text columns as numpy arrays.

Workers see texts in blocks of a bounded number of bytes, so a task's memory follows the block
(or the longest single text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15  # odd, so powers can be undone modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(29))
    x = x * _M2
    return x ^ (x >> np.uint64(32))


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes lie in one of the closed ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def _powers(base: int, size: int, held: dict[int, np.ndarray]) -> np.ndarray:
    """The first powers of ``base``, at least ``size`` of them; ``held`` keeps them for the next block."""
    if len(held.get(base, ())) < size:
        powers = np.full(size, base, dtype=np.uint64)
        powers[0] = 1
        held[base] = np.cumprod(powers, dtype=np.uint64)
    return held[base]


def text_array(texts: pa.Array) -> pa.Array:
    """A text column with nulls as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.large_string()), "")


class Block:
    """Neighbouring whole texts as one run of UTF-8 bytes with the offsets of each text."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = SPACE,
                 powers: dict[int, np.ndarray] | None = None):
        self.first, self.offsets, self.space = first, offsets, space
        self.powers = {} if powers is None else powers
        self.data = _lower()[data] if lower else data
        self.rows = len(offsets) - 1

    @cached_property
    def inside(self) -> np.ndarray:
        return ~self.space[self.data]

    @cached_property
    def word_bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """First byte and byte after the last of every word; a word never spans two texts."""
        inside, size = self.inside, len(self.data)
        breaks = np.zeros(size + 1, dtype=bool)
        breaks[self.offsets] = True
        before = np.empty(size, dtype=bool)
        after = np.empty(size, dtype=bool)
        if size:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
        starts = np.flatnonzero(inside & (~before | breaks[:-1]))
        ends = np.flatnonzero(inside & (~after | breaks[1:])) + 1
        return starts, ends

    @cached_property
    def word_offsets(self) -> np.ndarray:
        """Number of words before each text, and in all."""
        return np.searchsorted(self.word_bounds[0], self.offsets, side="left")

    @cached_property
    def _prefix(self) -> tuple[np.ndarray, np.ndarray]:
        size = len(self.data) + 1
        powers, back = (_powers(base, size, self.powers) for base in (_BASE, pow(_BASE, -1, 1 << 64)))
        sums = np.zeros(size, dtype=np.uint64)
        np.cumsum(_byte_values()[self.data] * powers[: size - 1], out=sums[1:])
        return sums, back

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges; equal bytes, equal hash, wherever they stand."""
        sums, back = self._prefix
        lengths = (ends - starts).astype(np.uint64)
        return mix((sums[ends] - sums[starts]) * back[starts] + lengths * _M1)

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return self.hashes(*self.word_bounds)

    @cached_property
    def line_bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of every line; an empty text has one empty line."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.concatenate([self.offsets[:-1], breaks + 1])
        ends = np.concatenate([breaks, self.offsets[1:]])
        texts = np.arange(self.rows)
        of_break = np.searchsorted(self.offsets, breaks, side="right") - 1
        start_text = np.concatenate([texts, of_break])
        end_text = np.concatenate([of_break, texts])
        a = np.lexsort((starts, start_text))
        b = np.lexsort((ends, end_text))
        return starts[a], ends[b], start_text[a]

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        total = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    @cached_property
    def code_points(self) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all texts and the offsets of each text among them."""
        points = np.frombuffer(self.data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        heads = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=heads[1:])
        return points, heads[self.offsets]


def blocks(texts: pa.Array, lower: bool = False, space: np.ndarray = SPACE, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a column in order, whole texts only; a block holds ``limit`` bytes or one text."""
    column = text_array(texts)
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    low, powers = 0, {}
    while low < len(column):
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), len(column))
        yield Block(low, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], lower, space, powers)
        low = high


def ngrams(values: np.ndarray, offsets: np.ndarray, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``n`` neighbouring values inside each text: (hashes, their positions, offsets per text)."""
    lengths = np.diff(offsets)
    counts = np.maximum(lengths - n + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    if len(values) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), bounds
    total = np.full(len(values) - n + 1, salt, dtype=np.uint64)
    for j in range(n):
        factor = np.uint64(pow(_BASE, j + 1, 1 << 64))
        total += values[j : len(values) - n + 1 + j].astype(np.uint64) * factor
    positions = ranges(offsets[:-1], counts)
    return mix(total[positions]), positions, bounds


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for counts[0] values, then the next start."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(total, dtype=np.int64) + shift


def text_of(bounds: np.ndarray) -> np.ndarray:
    """The text each value belongs to, from the offsets per text."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The texts of byte ranges."""
    held = data.tobytes()
    return [held[a:b].decode("utf-8") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def signed(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(values, dtype=np.uint64).view(np.int64)
