"""Repeated passages through a sparse suffix array.

Only the suffixes that start at minimisers are kept: of ``WINDOW`` neighbouring runs of ``GRAM``
words the one with the least hash. Whatever the text, a passage of ``length`` words has a minimiser
near its start, followed by ``length - WINDOW + 1`` words of the passage.

1. Suffixes are sorted by those words (range partitions, so a very frequent passage spans many
   tasks) and each is compared with its neighbours; those without an equal of another document go.
2. The others are extended to the right to ``length`` words, sorted and compared again.
3. Where an extension ends (a suffix that is repeated but not as far, or the first of a run), it
   is moved to the left, word by word, by less than a window, and compared again.

What is left are starts of ``length`` words that stand in another document; together they cover
every repeated passage exactly, and nothing else. Comparison is on 64-bit hashes of the words.

Defined results: texts that are null or shorter than ``length`` words have none; rows equal in id
and text are one document; repeats inside one document alone do not count; null ids are kept. Words are the runs
between white space, compared as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from orrery.llm import bitmaps
from orrery.llm.words import Block, blocks, mix, ngrams, ranges, signed
from orrery.session import stored

LENGTH = 50
GRAM, WINDOW = 8, 30
_FACTOR = 0xD1342543DE82EF95


def run_hashes(values: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of ``length`` neighbouring values from each start, at a cost that doesn't follow the length."""
    powers = np.full(len(values) + 1, _FACTOR, dtype=np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    back = np.full(len(values) + 1, pow(_FACTOR, -1, 1 << 64), dtype=np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers[:-1], out=sums[1:])
    return mix((sums[starts + length] - sums[starts]) * back[starts] + np.uint64(length))


def minimisers(words: np.ndarray, offsets: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> np.ndarray:
    """Positions of the minimisers, ascending: the first least run of each window inside one text."""
    hashes, at, bounds = ngrams(words, offsets, gram)
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = np.flatnonzero(text[: len(views)] == text[window - 1 :])
    found = np.zeros(len(hashes), dtype=bool)
    for low in range(0, len(whole), 1 << 15):
        part = whole[low : low + (1 << 15)]
        found[part + views[part].argmin(axis=1)] = True
    return at[found]


def _scan(documents: DataFrame, id_column: str, text_column: str, pick: Callable[[Block], tuple]) -> DataFrame:
    """(h, id, key, at): for each document and hash that ``pick`` finds, the places as a list."""
    kind = documents.schema[id_column].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                hashes, positions = pick(block)
                offsets = block.word_offsets
                text = np.searchsorted(offsets, positions, side="right") - 1
                order = np.lexsort((positions, hashes, text))
                hashes, positions, text = hashes[order], positions[order], text[order]
                new = np.ones(len(hashes), dtype=bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
                cuts = np.append(np.flatnonzero(new), len(hashes))
                own = batch.select([0, 1]).slice(block.first, block.rows).take(pa.array(text[new]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(hashes[new])), own.column(0), own.column(1), pa.ListArray.from_arrays(
                        pa.array(cuts, pa.int32()), pa.array((positions - offsets[text]).astype(np.int32)))], ["h", "id", "key", "at"])

    columns = documents.select(id_column, F.xxhash64(text_column), text_column)
    return columns.mapInArrow(find, f"h long, id {kind}, key long, at array<int>")


def _repeated(rows: DataFrame) -> DataFrame:
    """The rows whose hash another document has as well: sorted, then compared with their neighbours.

    A partition's first and last row can have their equal in the next partition; those few rows are
    settled among themselves.
    """
    kinds = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, before = TaskContext.get().partitionId(), None, False

        def emit(table: pa.Table, matched: np.ndarray, edge: np.ndarray):
            out = pa.Table.from_arrays([*table.columns, pa.array(matched), pa.array(edge), pa.array(np.full(len(matched), part, np.int32))],
                                       [*table.column_names, "matched", "edge", "part"])
            return out.filter(pa.array(matched | edge)).to_batches()

        first = True
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch])
            table = table.combine_chunks()
            if not table.num_rows:
                continue
            same = _same(table)
            left = np.concatenate([[before], same])
            matched = left | np.concatenate([same, [False]])
            edge = np.zeros(table.num_rows, dtype=bool)
            edge[0] = first
            if table.num_rows > 1:
                yield from emit(table.slice(0, table.num_rows - 1), matched[:-1], edge[:-1])
                first = False
            held, before = table.slice(table.num_rows - 1).to_batches()[0], bool(left[-1])
        if held is not None:
            yield from emit(pa.Table.from_batches([held]), np.array([before]), np.array([True]))

    order = ["h", "key", "id"]
    flagged = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        compare, f"{kinds}, matched boolean, edge boolean, part int"), "suffixes")
    # two rows per partition at most
    edges = flagged.filter("edge").select("h", "key", "id").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    open_edges = flagged.filter("edge and not matched").join(F.broadcast(edges.select("h")), "h", "left_semi")
    return flagged.filter("matched").unionByName(open_edges).select(*rows.columns)


def _same(table: pa.Table) -> np.ndarray:
    """Whether each row after the first has the hash of the row before, in another document."""
    h, key = (table.column(name).to_numpy() for name in ("h", "key"))
    ids = table.column("id").combine_chunks()
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return (h[1:] == h[:-1]) & ((key[1:] != key[:-1]) | (codes[1:] != codes[:-1]))


def starts(documents: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text",
           gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(id, key, at): starts of ``length`` repeated words that cover all repeated passages."""
    if length < gram + window - 1:
        raise ValueError(f"passages of {length} words need not have a minimiser")
    context = documents.sparkSession.sparkContext
    head = length - window + 1

    def heads(block: Block):
        """Minimisers with ``head`` words of the text after them."""
        words, offsets = block.word_hashes, block.word_offsets
        at = minimisers(words, offsets, gram, window)
        ends = offsets[np.searchsorted(offsets, at, side="right")] if len(at) else at
        fits = at + head <= ends
        return words, at[fits], ends[fits], run_hashes(words, at[fits], head)

    def short(block: Block):
        _, at, _, hashes = heads(block)
        return hashes, at

    survivors = _repeated(_scan(documents, id_column, text_column, short))
    likely = context.broadcast(bitmaps.of(survivors.select("h")))

    def long(block: Block):
        words, at, ends, hashes = heads(block)
        kept = bitmaps.holds(likely.value, signed(hashes)) & (at + length <= ends)
        return run_hashes(words, at[kept], length), at[kept]

    whole = _repeated(_scan(documents, id_column, text_column, long)).select("id", "key", F.explode("at").alias("at"))
    whole = stored(whole, "starts")
    # minimisers where an extension ends: repeated, but not as far, or without such a one closely before
    mine = Window.partitionBy("id", "key").orderBy("at")
    marked = survivors.select("id", "key", F.explode("at").alias("at"), "h", F.lit(0).alias("far")).unionByName(
        whole.select("id", "key", "at", F.lit(None).cast("long").alias("h"), F.lit(1).alias("far")))
    folded = marked.groupBy("id", "key", "at").agg(F.max("h").alias("h"), F.max("far").alias("far"))
    last = F.max(F.when(F.col("far") == 1, F.col("at"))).over(mine.rowsBetween(Window.unboundedPreceding, -1))
    ends = folded.withColumn("last", last).filter(
        (F.col("far") == 0) | F.col("last").isNull() | (F.col("at") - F.col("last") > window))
    moving = context.broadcast(bitmaps.of(ends.filter("h is not null").select("h")))

    def moved(block: Block):
        words, at, ends, hashes = heads(block)
        offsets = block.word_offsets
        kept = bitmaps.holds(moving.value, signed(hashes))
        at, ends = at[kept], ends[kept]
        first = np.maximum(at - window + 1, offsets[np.searchsorted(offsets, at, side="right") - 1]) if len(at) else at
        positions = ranges(first, at - first + 1)
        positions = np.unique(positions[positions + length <= np.repeat(ends, at - first + 1)])
        return run_hashes(words, positions, length), positions

    extended = _repeated(_scan(documents, id_column, text_column, moved)).select("id", "key", F.explode("at").alias("at"))
    return whole.union(extended).distinct()


def passages(documents: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text",
             gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(id, start_word, end_word, n_words) of every maximal stretch made of repeated runs of ``length`` words."""
    found = starts(documents, length, id_column, text_column, gram, window)
    mine = Window.partitionBy("id", "key").orderBy("at")
    fresh = F.coalesce(F.col("at") > F.lag("at").over(mine) + length, F.lit(True)).cast("int")
    runs = found.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(mine))
    return runs.groupBy("id", "key", "run").agg(
        F.min("at").cast("long").alias("start_word"), (F.max("at") + length).cast("long").alias("end_word")).select(
        F.col("id").alias(id_column), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
