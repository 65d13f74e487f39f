"""Vector arithmetic on array columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from orrery.functions.tags import text_array

NORM_FLOOR = 1e-9


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def dot(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")))


def scaled(vector: Column, factor: Column | float) -> Column:
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(vector, lambda x: x.cast("double") * factor)


def l2_normalised(vector: Column) -> Column:
    """Unit vector; the norm is floored so that a zero vector stays zero."""
    norm = F.greatest(F.sqrt(dot(vector, vector)), F.lit(NORM_FLOOR))
    return F.transform(vector, lambda x: x.cast("double") / norm)


def family_weight(family: str, weights: Mapping[str, float], fallback: float) -> float:
    """Weight of a feature family: its own, else the default, else the fallback."""
    return float(weights.get(family, weights.get("default", fallback)))


def weighted_concat(embedding: Column, families: Mapping[str, Column], weights: Mapping[str, float],
                    fallback: float) -> Column:
    """Embedding and feature vectors side by side, each scaled by its weight, families by name.

    A fallback of 0 or less, or no family at all, turns the scaling off and gives the embedding as it is.
    """
    if fallback <= 0 or not families:
        return F.transform(embedding, lambda x: x.cast("double"))
    parts = [scaled(embedding, float(weights.get("embeddings", 1.0)))]
    for family in sorted(families):
        parts.append(scaled(families[family], family_weight(family, weights, fallback)))
    return F.concat(*parts)


def prior_corrected(proba: Column, priors: Sequence[float]) -> Column:
    """Class shares divided by class frequencies, then back to a sum of 1."""
    lifted = F.zip_with(proba, F.array(*[F.lit(float(p)) for p in priors]), lambda p, prior: p / prior)
    return F.transform(lifted, lambda p: p / total(lifted))


def top_classes(proba: Column, classes: Sequence[str], count: int = 3) -> Column:
    """Best classes with rounded scores, best first, ties by name."""
    names = text_array(classes)
    pairs = F.zip_with(proba, names, lambda p, name: F.struct((-p).alias("key"), name.alias("name")))
    best = F.slice(F.array_sort(pairs), 1, count)
    return F.transform(
        best, lambda pair: F.struct(pair["name"].alias("category"), F.round(-pair["key"], 4).alias("score"))
    )


def argmax_index(vector: Column) -> Column:
    """Index of the first largest entry."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def gated(category: Column, score: Column, min_score: float) -> Column:
    """The category, or null where its score is too low."""
    return F.when(score >= F.lit(float(min_score)), category)
