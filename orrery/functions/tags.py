"""Expressions over a record's tag array."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F


def quoted(value: str) -> str:
    """A string as a Spark SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_array(values: Sequence[str]) -> Column:
    """Literal array of strings, built in one call."""
    return F.expr(f"CAST(array({', '.join(quoted(value) for value in values)}) AS ARRAY<STRING>)")


def first_matching(tags: Column, priority: Sequence[str], other: str) -> Column:
    """The first tag of the priority list that the record has."""
    hits = F.filter(text_array(priority), lambda tag: F.array_contains(tags, tag))
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(other))


def one_hot(label: Column, classes: Sequence[str], other: str | None = None) -> Column:
    """Indicator vector over an ordered class list; a null label counts as ``other``."""
    label = F.coalesce(label, F.lit(other)) if other is not None else label
    return F.transform(text_array(classes), lambda name: F.when(name == label, 1.0).otherwise(0.0))


def class_tags(tags: Column, classes: Sequence[str]) -> Column:
    """Distinct tags of the record that are classes."""
    return F.array_intersect(tags, text_array(classes))


def most_specific(tags: Column, ancestors: Mapping[str, Sequence[str]]) -> Column:
    """Tags left when every ancestor of a present tag is taken out."""
    covered = F.array().cast("array<string>")
    for tag, above in sorted(ancestors.items()):
        covered = F.concat(
            covered, F.when(F.array_contains(tags, tag), text_array(above)).otherwise(F.array().cast("array<string>"))
        )
    return F.array_except(tags, covered)
