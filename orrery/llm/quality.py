"""Quality rules: fixed text measures and a calibrated classifier on hashed word and character n-grams.

Fitting reads at most ``max_rows`` labelled documents (chosen by a hash of their id); scoring
covers every row and whole texts, batch by batch, without a shuffle.

Defined results: a null or empty text has no words and fails the base rules; null ids are
scored like any other; repeated rows are judged each; with no labels, or labels of one class
only, the classifier answers that class (with none: keep). Columns of the input that are named
like a measure are replaced by the measure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from orrery.llm.linear import BITS, Group, Logit, features, fit
from orrery.llm.words import Block, blocks, byte_set, mix, ngrams

MAX_ROWS = 1500
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
THRESHOLD = 0.5
GROUPS = (Group("words", 1), Group("points", 3))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS = byte_set(*[(ord(c), ord(c)) for c in "#*$%&|<>"])


def measures(block: Block) -> dict[str, np.ndarray]:
    """The five counts of every text of a block."""
    words = block.word_offsets
    heads = (block.data & 0xC0) != 0x80
    starts, ends, owner = block.line_bounds
    filled = np.zeros(len(block.data) + 1, dtype=np.int64)
    np.cumsum(block.inside, out=filled[1:])
    with_word = filled[ends] > filled[starts]
    starts, ends, owner = starts[with_word], ends[with_word], owner[with_word]
    lines = block.hashes(starts, ends) + mix(owner.astype(np.uint64) + np.uint64(1))
    first_of = owner[np.unique(lines, return_index=True)[1]]
    rows = block.rows
    dup_lines = np.bincount(owner, minlength=rows) - np.bincount(first_of, minlength=rows)
    grams, at, bounds = ngrams(block.word_hashes, words, 3)
    of = np.repeat(np.arange(rows), np.diff(bounds))
    keys = grams + mix(of.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    again = at[order[same[1:] | same[:-1]]]
    covered = np.zeros(words[-1], dtype=np.int64)
    for step in range(3):
        covered[again + step] = 1
    total = np.concatenate([[0], np.cumsum(covered)])
    return {
        "n_words": np.diff(words), "word_chars": block.per_text(block.inside & heads),
        "n_symbols": block.per_text(_SYMBOLS[block.data]), "n_dup_lines": dup_lines,
        "n_repeat_words": total[words[1:]] - total[words[:-1]],
    }


def sequences(block: Block) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    return {"words": (block.word_hashes, block.word_offsets), "points": block.code_points}


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_column: str = "doc_id",
          text_column: str = "text", label_column: str = "quality", groups: tuple[Group, ...] = GROUPS,
          bits: int = BITS) -> Logit:
    """A classifier from at most ``max_rows`` labelled ids; of several labels of an id the lowest counts.

    Workers turn the chosen texts into hashed counts; the driver gets those, never the texts.
    """
    known = labels.filter(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(
        F.col(id_column).alias("_id")).agg(F.min(F.col(label_column).cast("int")).alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    # bounded by max_rows
    joined = documents.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).join(
        F.broadcast(chosen), "_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                rows, at, share = features(groups, sequences(block), bits)
                order = np.argsort(rows, kind="stable")
                cuts = np.searchsorted(rows[order], np.arange(block.rows + 1))
                own = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([
                    own.column(0), own.column(2),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(at[order], pa.int32())),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(share[order], pa.float32())),
                ], ["id", "label", "at", "share"])

    kind = documents.schema[id_column].dataType.simpleString()
    counted = joined.mapInArrow(count, f"id {kind}, label int, at array<int>, share array<float>").toArrow()
    # the fit must not depend on the order in which rows arrive
    counted = counted.sort_by([("id", "ascending")]) if counted.num_rows else counted
    labels_of = (counted["label"].to_numpy() > 0).astype(np.int64) if counted.num_rows else np.zeros(0, np.int64)
    at = np.concatenate([np.zeros(0, np.int32), *[c.flatten().to_numpy() for c in counted["at"].chunks]])
    share = np.concatenate([np.zeros(0, np.float32), *[c.flatten().to_numpy() for c in counted["share"].chunks]])
    lengths = np.concatenate([np.zeros(0, np.int64), *[np.diff(c.offsets.to_numpy()) for c in counted["at"].chunks]])
    del counted
    return fit(groups, np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), at, share, labels_of, bits)


def score(documents: DataFrame, model: Logit, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every row with its measures, ``base_failed``, ``quality_probability`` and ``kept``."""
    added = [*[StructField(name, LongType()) for name in MEASURES], StructField("base_failed", BooleanType()),
             StructField("quality_probability", DoubleType()), StructField("kept", BooleanType())]
    carried = documents.drop(*[field.name for field in added])
    schema = StructType([*carried.schema.fields, *added])
    at = carried.columns.index(text_column)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Logit = shared.value
        for batch in batches:
            for block in blocks(batch.column(at)):
                counts = measures(block)
                failed = _failed(counts)
                probability = held.probability(sequences(block))
                own = batch.slice(block.first, block.rows)
                columns = [*own.columns, *[pa.array(counts[name], pa.int64()) for name in MEASURES], pa.array(failed),
                           pa.array(probability), pa.array(~failed & (probability >= threshold))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return carried.mapInArrow(judge, schema)


def keep(documents: DataFrame, model: Logit, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that are kept, with the columns and values they came with."""
    at = documents.columns.index(text_column)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Logit = shared.value
        for batch in batches:
            for block in blocks(batch.column(at)):
                good = ~_failed(measures(block)) & (held.probability(sequences(block)) >= threshold)
                yield batch.slice(block.first, block.rows).filter(pa.array(good))

    return documents.mapInArrow(choose, documents.schema)


def _failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
