"""Ordered-bin, rank-hot and min-max encoding as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from orrery.config import BinEncoder, RangeEncoder
from orrery.functions.tags import text_array


def number_in(text: Column) -> Column:
    """Number written in a text, else null. ``12d`` and ``12f`` are Java's way to write one, so not numbers."""
    return F.when(~text.rlike(r"[0-9.][dDfF]\s*$"), text.try_cast("double"))


def numeric_value(value: Column, is_text: bool) -> Column:
    """Text gives the number in its first four characters (a year), anything else its value; else null."""
    return number_in(F.substring(value, 1, 4)) if is_text else value.try_cast("double")


def bin_index(value: Column, edges: Sequence[float]) -> Column:
    """Number of edges at or below the value, which is the index of its right-open bin."""
    index = F.when(value.isNull(), F.lit(None).cast("int"))
    for count in range(len(edges), 0, -1):
        index = index.when(value >= F.lit(float(edges[count - 1])), F.lit(count))
    return index.otherwise(F.lit(0))


def bin_position(value: Column, edges: Sequence[float]) -> Column:
    """The bin index spread over [0, 1]."""
    return bin_index(value, edges) / F.lit(float(len(edges)))


def rank_hot(value: Column, edges: Sequence[float]) -> Column:
    """One entry per bin: 1 once the value is past the bin, 0 before it, the fraction inside it.

    The open-ended first and last bins have no width, so they are 1 as soon as they are reached.
    """
    cells = [F.lit(1.0)]
    for low, high in zip(edges, edges[1:]):
        low, high = float(low), float(high)
        inside = (value - F.lit(low)) / F.lit(high - low)
        cells.append(F.when(value >= high, 1.0).when(value < low, 0.0).otherwise(inside))
    cells.append(F.when(value >= float(edges[-1]), 1.0).otherwise(0.0))
    return F.array(*cells)


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Scale to [0, 1]; a range without width gives 0.5."""
    return F.when(value.isNull(), None).when(high > low, (value - low) / (high - low)).otherwise(0.5)


def _constant(values: Sequence[float]) -> Column:
    return F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})")


def _filled(value: Column, encoder: BinEncoder | RangeEncoder) -> Column:
    substitute = encoder.missing.value
    return value if substitute is None else F.coalesce(value, F.lit(float(substitute)))


def bin_vector(value: Column, encoder: BinEncoder) -> Column:
    """Feature vector of a value.

    A labelled missing class has the last cell, so it is orthogonal to every present value;
    without any rule for it, a missing value is 0.5 in the first cell.
    """
    value = _filled(value, encoder)
    if encoder.scalar:
        present, width = F.array(bin_position(value, encoder.edges)), 1
    else:
        present, width = rank_hot(value, encoder.edges), len(encoder.labels)
    if encoder.missing.label:
        present = F.concat(present, _constant([0.0]))
        absent = _constant([0.0] * width + [1.0])
    else:
        absent = _constant([0.5] + [0.0] * (width - 1))
    return F.when(value.isNull(), absent).otherwise(present)


def bin_assignment(value: Column, encoder: BinEncoder) -> Column:
    """struct(category, score, bin) of a value; a labelled missing class is bin 0.

    The score is the first cell of the feature vector.
    """
    value = _filled(value, encoder)
    shift = 1 if encoder.missing.label else 0
    index = F.coalesce(bin_index(value, encoder.edges) + F.lit(shift), F.lit(0))
    labels = text_array(encoder.classes)
    first = F.round(bin_position(value, encoder.edges), 4) if encoder.scalar else F.lit(1.0)
    return F.struct(
        F.element_at(labels, index + 1).alias("category"),
        F.when(value.isNull(), 0.0 if shift else 0.5).otherwise(first).alias("score"),
        index.alias("bin"),
    )


def encode_range(value: Column, encoder: RangeEncoder, low: Column, high: Column) -> Column:
    """One-cell vector (two with a missing cell) of a min-max scaled value."""
    value = _filled(value, encoder)
    scaled = F.array(min_max(value, low, high))
    if encoder.missing.label:
        return F.when(value.isNull(), _constant([0.0, 1.0])).otherwise(F.concat(scaled, _constant([0.0])))
    return F.when(value.isNull(), _constant([0.5])).otherwise(scaled)


def rating_fraction(value: Column, low: Column, high: Column) -> Column:
    """Text rating scaled by the data range (no width counts as 1); not a number gives -1."""
    number = number_in(value)
    span = F.when(high > low, high - low).otherwise(1.0)
    return F.coalesce((number - low) / span, F.lit(-1.0))


def clip(value: Column, cap: Column | float) -> Column:
    """Upper clip that keeps nulls."""
    cap = cap if isinstance(cap, Column) else F.lit(float(cap))
    return F.when(value.isNotNull(), F.least(value, cap))
