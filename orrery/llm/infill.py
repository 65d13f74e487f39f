"""Fill-in-the-middle texts: cut at unit boundaries kept in Roaring-style containers.

The boundaries of a text are the byte offsets at which its units (code points, words or lines)
begin. They are held as containers of 65 536 offsets, each as a sorted array, a bitmap or a list of
runs, whichever is smallest, with the cumulative cardinalities of the containers. A cut after k
units is the k-th boundary: a search over the cumulative cardinalities finds the container, a
select inside it the offset. Texts are bytes throughout and are never decoded.

Where the cuts fall and which form a text takes follow from a hash of its id alone, so reruns and
other partitions give the same rows. Repeated rows give repeated results; a null id hashes as an
empty one; a null text is an empty text; texts that are empty or contain a marker stay plain. Only
the id and the text are read, and results have their own columns, so no other column can clash.
Memory follows a block of 0.5 MB or the longest single text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from orrery.llm.words import SPACE, blocks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"  # fixed values: the markers
PLAIN, PSM, SPM = "plain", "psm", "spm"
SEED = "1"
PLAIN_FROM = 90  # of 100
SPM_BELOW = 20  # of 100
SPAN = 1 << 16


class ArrayContainer:
    """Few offsets, sorted."""

    def __init__(self, offsets: np.ndarray):
        self.offsets = offsets.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.offsets[k])


class BitmapContainer:
    """One bit per offset, with the number of bits before each word of 64."""

    def __init__(self, flags: np.ndarray):
        held = np.zeros(-(-len(flags) // 64) * 64, dtype=bool)
        held[: len(flags)] = flags
        self.words = np.packbits(held).reshape(-1, 8)
        self.before = np.concatenate([[0], np.cumsum(held.reshape(-1, 64).sum(axis=1))])

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        bits = np.flatnonzero(np.unpackbits(self.words[word]))
        return word * 64 + int(bits[k - self.before[word]])


class RunContainer:
    """Stretches without a gap, with the number of offsets before each."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray):
        self.starts = starts.astype(np.uint16)
        self.before = np.concatenate([[0], np.cumsum(ends - starts)])

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


def _container(flags: np.ndarray, count: int):
    """The smallest container for the flagged offsets of one span."""
    if count == len(flags):
        return RunContainer(np.array([0]), np.array([count]))
    padded = np.zeros(len(flags) + 2, dtype=np.int8)
    padded[1:-1] = flags
    step = np.diff(padded)
    starts = np.flatnonzero(step == 1)
    if 4 * len(starts) <= min(2 * count, SPAN // 8):
        return RunContainer(starts, np.flatnonzero(step == -1))
    if 2 * count <= SPAN // 8:
        return ArrayContainer(np.flatnonzero(flags))
    return BitmapContainer(flags)


class Boundaries:
    """The flagged offsets of one text: containers and their cumulative cardinalities."""

    def __init__(self, flags: np.ndarray):
        self.spans: list[int] = []
        self.containers: list = []
        before = [0]
        for low in range(0, len(flags), SPAN):
            part = flags[low : low + SPAN]
            count = int(np.count_nonzero(part))
            if count:
                self.spans.append(low)
                self.containers.append(_container(part, count))
                before.append(before[-1] + count)
        self.before = np.array(before)

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th offset, from 0."""
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return self.spans[at] + self.containers[at].select(k - int(self.before[at]))

    def cut(self, units: int, size: int) -> int:
        """The offset after the first ``units`` units of a text of ``size`` bytes."""
        if units <= 0:
            return 0
        return self.select(units) if units < len(self) else size


def code_points(data: np.ndarray) -> np.ndarray:
    """First bytes of the code points of UTF-8 data."""
    return (data & 0xC0) != 0x80


def word_starts(data: np.ndarray) -> np.ndarray:
    """First bytes of the words; white space belongs to the word before it."""
    inside = ~SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    return starts


def line_starts(data: np.ndarray) -> np.ndarray:
    """First bytes of the lines; a line break belongs to the line it ends."""
    starts = np.zeros(len(data), dtype=bool)
    if len(data):
        starts[0], starts[1:] = True, data[:-1] == 10
    return starts


UNITS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "code_point": code_points, "word": word_starts, "line": line_starts}


def draws(seed: str, key: str) -> tuple[int, int, int, int]:
    """Four whole numbers below 2 ** 32 from the id of a text."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def transform(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", unit: str = "code_point",
              seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW,
              markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """(id, n, form, prefix_units, middle_units, output), one row per row of ``documents``.

    ``n`` counts units. The two lengths are null where the form is plain. ``markers`` must not be
    able to overlap each other, as is so for the default ones.
    """
    kind = documents.schema[id_column].dataType.simpleString()
    flags_of = UNITS[unit]
    prefix_mark, suffix_mark, middle_mark = (mark.encode() for mark in markers)
    names = ["id", "n", "form", "prefix_units", "middle_units", "output"]

    def one(key: str, data: np.ndarray) -> tuple[int, str, int | None, int | None, bytes]:
        boundaries, text = Boundaries(flags_of(data)), data.tobytes()
        n = len(boundaries)
        first, second, plain, order = draws(seed, key)
        if not text or plain % 100 >= plain_from or any(m in text for m in (prefix_mark, suffix_mark, middle_mark)):
            return n, PLAIN, None, None, text
        low, high = sorted((first % (n + 1), second % (n + 1)))
        a, b = boundaries.cut(low, len(text)), boundaries.cut(high, len(text))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if order % 100 < spm_below:
            return n, SPM, low, high - low, suffix_mark + suffix + prefix_mark + prefix + middle_mark + middle
        return n, PSM, low, high - low, prefix_mark + prefix + suffix_mark + suffix + middle_mark + middle

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                own = batch.slice(block.first, block.rows)
                at = block.offsets.tolist()
                rows = [one(key or "", block.data[a:b])
                        for key, a, b in zip(own.column(1).to_pylist(), at[:-1], at[1:], strict=True)]
                n, form, prefix, middle, output = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())], names)

    columns = documents.select(F.col(id_column).alias("id"), F.col(id_column).cast("string").alias("key"),
                               F.col(text_column).alias("text"))
    found = columns.mapInArrow(
        cut, f"id {kind}, n long, form string, prefix_units long, middle_units long, output string")
    return found.withColumnRenamed("id", id_column)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output was made of."""
    pattern = "|".join("\\Q" + mark + "\\E" for mark in markers)
    parts = F.split(output, pattern, -1)
    first, second, middle = (F.element_at(parts, i) for i in (2, 3, 4))
    return (F.when(form == PSM, F.concat(first, middle, second))
            .when(form == SPM, F.concat(second, middle, first)).otherwise(output))
