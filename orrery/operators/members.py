"""Who carries which label, as bitmaps of ids.

A bitmap holds one label of one family over 32 768 neighbouring ids. Any number of labels of a family are
put together by OR, several families by AND, and counts and members come from the set bits. The
rows that are combined are a few kilobytes per 32 768 ids and label, whatever the label's share of
all rows, so no record is joined with itself per family.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orrery.operators.categories import zero_filled

IDS = 32_768  # fixed value: ids per bitmap of the built-in functions


def bitmaps(assignments: DataFrame) -> DataFrame:
    """(family, label, bucket, bits) of assignments (id, family, category) with whole-number ids."""
    key = F.col("id").cast("long")
    return assignments.filter("id is not null").groupBy(
        "family", F.col("category").alias("label"), F.bitmap_bucket_number(key).alias("bucket")
    ).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits"))


def selected(maps: DataFrame, chosen: Mapping[str, Sequence[str]]) -> DataFrame:
    """(bucket, bits) of the records with one of the chosen labels in every chosen family."""
    if not chosen:
        return maps.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    fits = F.lit(False)
    for family, labels in chosen.items():
        fits = fits | ((F.col("family") == family) & F.col("label").isin(list(labels)))
    either = maps.filter(fits).groupBy("family", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    both = either.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bitmap_and_agg("bits").alias("bits"))
    return both.filter((F.col("n") == len(chosen)) & (F.bitmap_count("bits") > 0)).select("bucket", "bits")


def count(selection: DataFrame) -> DataFrame:
    """How many records a selection holds, in one row."""
    return selection.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def facet_within(maps: DataFrame, classes: DataFrame, family: str, selection: DataFrame) -> DataFrame:
    """(idx, label, n): records of the selection per label of a family, every declared label listed."""
    own = maps.filter(F.col("family") == family).select("label", "bucket", "bits")
    pairs = own.join(selection.withColumnRenamed("bits", "_in"), "bucket")
    both = pairs.select("label", "bucket", F.explode(F.array("bits", "_in")).alias("bits"))
    met = both.groupBy("label", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    counted = met.groupBy("label").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    return zero_filled(counted, classes.filter(F.col("family") == family).select("idx", "label"), ["label"], ["n"])


def ids(selection: DataFrame) -> DataFrame:
    """(id) of the records of a selection, from the set bits."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little"))
                # positive ids count up from the start of their bucket, others down from 0
                found = (bucket - 1) * IDS + at + 1 if bucket > 0 else bucket * IDS - at
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64))], ["id"])

    return selection.select("bucket", "bits").mapInArrow(unpack, "id long")
