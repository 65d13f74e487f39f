"""Token counts per section through offsets.

A whole document is encoded once; a token's characters are an interval, a section's characters are
an interval, and the two are joined inside the row. A token that crosses a boundary goes to one
section by an explicit rule, so the counts of the sections always add up to the document's.

Sections are the lines of a text, each with its line break (``sections="lines"``), or the parts of
a text that is put together from several fields (``count_fields``).

Rules: ``first`` (the section of the token's first byte), ``last`` (of its last byte), ``most``
(the section with most of its bytes; of equal parts the earlier). A byte of a multi-byte character
belongs to that character's section.

Defined results: null and empty texts have no token and no section; null ids are kept; repeated
rows are counted each. The vocabulary is read by the driver from a path and sent to the workers.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orrery.llm.words import text_array

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: how the vocabulary cuts a text before merging (a fixed value of its format)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "last", "most")


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def assign(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "most") -> np.ndarray:
    """The section of every token; both tile the same bytes and are given by where they end."""
    starts = np.concatenate([[0], token_ends[:-1]]).astype(np.int64)
    first = np.searchsorted(section_ends, starts, side="right")
    if rule == "first":
        return first
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    if rule == "last":
        return last
    if rule != "most":
        raise ValueError(f"unknown rule {rule!r}, known: {RULES}")
    result = first.copy()
    for i in np.flatnonzero(last > first):
        # the few tokens that cross: bytes in each section they touch
        edges = np.concatenate([[starts[i]], section_ends[first[i] : last[i]], [token_ends[i]]])
        result[i] = first[i] + int(np.argmax(np.diff(edges)))
    return result


def _counted(encoding, lengths: np.ndarray, text: str, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, int, int]:
    """Tokens per section, tokens that cross a boundary, tokens in all."""
    tokens = np.asarray(encoding.encode_ordinary(text), dtype=np.int64)
    ends = np.cumsum(lengths[tokens])
    crossing = np.count_nonzero(
        np.searchsorted(section_ends, ends - lengths[tokens], side="right") != np.searchsorted(section_ends, ends - 1, side="right"))
    return np.bincount(assign(ends, section_ends, rule), minlength=len(section_ends)), crossing, len(tokens)


def _encoder(ranks: dict[bytes, int]):
    import tiktoken

    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def count_lines(documents: DataFrame, rule: str = "most", vocabulary: str = VOCABULARY, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """(id, n_tokens, n_crossing, line_tokens): tokens of the document and of each of its lines in order."""
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    kind = documents.schema[id_column].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = _encoder(ranks.value)
        for batch in batches:
            totals, crossings, lines = [], [], []
            for text in text_array(batch.column(1)).to_pylist():
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                ends = np.flatnonzero(data == 10) + 1
                if len(data) and (not len(ends) or ends[-1] < len(data)):
                    ends = np.append(ends, len(data))
                per_line, crossing, total = _counted(encoding, lengths, text, ends, rule) if text else (ends, 0, 0)
                totals.append(total)
                crossings.append(crossing)
                lines.append(per_line)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(crossings, pa.int64()), pa.array(lines, pa.list_(pa.int32()))],
                ["id", "n_tokens", "n_crossing", "line_tokens"])

    found = documents.select(id_column, text_column).mapInArrow(
        count, f"id {kind}, n_tokens long, n_crossing long, line_tokens array<int>")
    return found.withColumnRenamed("id", id_column)


def count_fields(records: DataFrame, fields: Sequence[str], separator: str = "\n", rule: str = "most",
                 vocabulary: str = VOCABULARY, id_column: str = "id") -> DataFrame:
    """(id, n_tokens, field_tokens map) of records whose text is their fields joined by ``separator``.

    A separator belongs to the field before it; null fields are empty.
    """
    ranks = records.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    kind = records.schema[id_column].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = _encoder(ranks.value)
        for batch in batches:
            columns = [text_array(column).to_pylist() for column in batch.columns[1:]]
            totals, per_field = [], []
            for parts in zip(*columns, strict=True):
                pieces = [part + separator for part in parts[:-1]] + [parts[-1]]
                ends = np.cumsum([len(piece.encode()) for piece in pieces])
                text = "".join(pieces)
                counts, _, total = _counted(encoding, lengths, text, ends, rule) if text else (np.zeros(len(ends), int), 0, 0)
                totals.append(total)
                per_field.append(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(per_field, pa.list_(pa.int64()))], ["id", "n_tokens", "counts"])

    texts = records.select(id_column, *[F.col(field).cast("string") for field in fields])
    found = texts.mapInArrow(count, f"id {kind}, n_tokens long, counts array<long>")
    names = F.array(*[F.lit(field) for field in fields])
    return found.select(F.col("id").alias(id_column), "n_tokens", F.map_from_arrays(names, F.col("counts")).alias("field_tokens"))
