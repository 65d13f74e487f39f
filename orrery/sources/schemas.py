"""Declared schemas; nothing is inferred."""

from __future__ import annotations

RECIPES = (
    "id long, name string, description string, minutes int, contributor_id long, submitted string, "
    "n_steps int, n_ingredients int, ingredients array<string>, steps array<string>, tags array<string>, "
    "nutrition array<double>"
)
RECIPES_CSV = (
    "name string, id long, minutes int, contributor_id long, submitted string, tags string, "
    "nutrition string, n_steps int, steps string, description string, ingredients string, n_ingredients int"
)
INTERACTIONS = "user_id long, recipe_id long, date string, rating int, review string"
PAPERS = "id string, title string, abstract string, doi string"
LIST_COLUMNS = ("tags", "steps", "ingredients")
