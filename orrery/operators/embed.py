"""Text to unit vectors with an encoder loaded once per worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from orrery.functions.text import hashed_words

Encoder = Callable[[list[str]], np.ndarray]
BATCH_SIZE = 256
DIMS = 64


def embed_text(texts: DataFrame, dims: int = DIMS) -> DataFrame:
    """(id, embedding) of (id, text) as unit vectors of hashed word counts.

    The stand-in for a trained sentence model, which is not part of this package: texts with the
    same words in the same amounts get the same vector. Hashing is done by Spark; a worker only
    counts slots into rows, whole texts at a time.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = np.zeros((len(batch), dims), dtype=np.float64)
            lengths = batch["slots"].map(len).to_numpy(dtype=np.int64)
            if lengths.sum():
                at = np.repeat(np.arange(len(batch)), lengths)
                np.add.at(rows, (at, np.concatenate(batch["slots"].to_numpy())), 1.0)
            rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
            yield pd.DataFrame({"id": batch["id"], "embedding": list(rows.astype(np.float32))})

    kind = texts.schema["id"].dataType.simpleString()
    slots = texts.select("id", F.coalesce(hashed_words(F.col("text"), dims), F.array().cast("array<int>")).alias("slots"))
    return slots.mapInPandas(count, f"id {kind}, embedding array<float>")


def embed_with(texts: DataFrame, load: Callable[[], Encoder], batch_size: int = BATCH_SIZE) -> DataFrame:
    """(id, embedding) with an encoder of the caller; ``load`` runs once in every Python worker task."""
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load()
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start : start + batch_size]
                rows = np.asarray(encoder(part["text"].fillna("").tolist()), dtype=np.float32)
                rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": list(rows)})

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInPandas(encode, f"id {kind}, embedding array<float>")
