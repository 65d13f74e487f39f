"""Encoder settings and the fixed values results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Missing:
    """What a null becomes: ``value`` substitutes a number, ``label`` adds a class of its own."""

    value: float | None = None
    label: str | None = None


@dataclass(frozen=True)
class BinEncoder:
    """Ordered bins over a numeric field, right-open at every edge."""

    field: str
    edges: tuple[float, ...]
    labels: tuple[str, ...]
    scalar: bool = False
    missing: Missing = Missing()

    def __post_init__(self):
        if len(self.labels) != len(self.edges) + 1:
            raise ValueError(f"{self.field}: {len(self.edges)} edges need {len(self.edges) + 1} labels")

    @property
    def classes(self) -> tuple[str, ...]:
        return ((self.missing.label,) if self.missing.label else ()) + self.labels


@dataclass(frozen=True)
class RangeEncoder:
    """Min-max scaling of a numeric field to [0, 1]."""

    field: str
    label: str
    missing: Missing = Missing()


# Bin edges, labels, class lists, weights and thresholds results must agree on.
MINUTES = BinEncoder(
    "minutes",
    (15, 30, 60, 120, 240),
    ("<15 minutes", "16-30 minutes", "31-60 minutes", "1-2 hours", "2-4 hours", "4+ hours"),
)
N_STEPS = BinEncoder(
    "n_steps",
    (6, 11, 16, 21),
    ("1-5 steps", "6-10 steps", "11-15 steps", "16-20 steps", "20+ steps"),
)
N_INGREDIENTS = BinEncoder(
    "n_ingredients",
    (5, 10, 20),
    ("<5 ingredients", "5-10 ingredients", "11-20 ingredients", "20+ ingredients"),
)
N_RATINGS = BinEncoder(
    "n_ratings",
    (0.5, 2, 6, 11, 21, 51, 100),
    (
        "no ratings", "1 ratings", "2-5 ratings", "6-10 ratings",
        "11-20 ratings", "21-50 ratings", "51-100 ratings", "100+ ratings",
    ),
    missing=Missing(value=0),
)
AVG_RATING = BinEncoder(
    "avg_rating",
    (2, 3, 4, 4.5, 4.8, 4.9999),
    ("1 star", "2 stars", "3 stars", "4 stars", "4.5 stars", "4.8 stars", "5 stars"),
    missing=Missing(label="no rating"),
)
SUBMITTED = BinEncoder(
    "submitted",
    tuple(range(2000, 2019)),
    tuple(str(year) for year in range(1999, 2019)),
    scalar=True,
)
ENCODERS = (AVG_RATING, MINUTES, N_INGREDIENTS, N_RATINGS, N_STEPS, SUBMITTED)

PROJECTION_WEIGHTS = {
    "embeddings": 5.0,
    "default": 0.5,
    "cuisines_proba": 8.0,
    "meal_types_proba": 1.2,
    "avg_rating_features": 1.4,
    "minutes_features": 1.2,
    "n_ingredients_features": 2.2,
    "n_ratings_features": 2.4,
    "n_steps_features": 1.3,
    "submitted_features": 1.0,
}
DEFAULT_CATEGORY_WEIGHT = 0.5

SECONDARY_FAMILIES = (
    "minutes", "n_ingredients", "n_steps", "n_ratings", "avg_rating", "submitted", "cuisines", "meal_types",
)
LABEL_OVERRIDES = {
    "northeastern-united-states": "northeastern-us",
    "southern-united-states": "southern-us",
    "southwestern-united-states": "southwestern-us",
}
TEXT_TEMPLATE = "{name}. {description}. Ingredients: {ingredients}."
CHILD_THRESHOLD = 0.99
EXCLUSIVE_MIN_COUNT = 200
GROUP_MERGE_THRESHOLD = 0.82
KNN_NEIGHBOURS = 100
CHUNK_SIZE = 500
CHUNK_BYTES = 1_000_000
SYSTEMATIC_SAMPLE = 600
YEAR_RANGE = (1999, 2018)
POPULARITY_EDGES = (2, 3, 6, 11, 26, 101)
POPULARITY_LABELS = ("1", "2", "3–5", "6–10", "11–25", "26–100", "101+")
POPULARITY_TIERS = ("obscure", "moderate", "moderate", "moderate", "moderate", "popular", "popular")
DESCRIBE_PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)
