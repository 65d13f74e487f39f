"""String expressions: templates, slugs, shard keys, links and previews."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


def _field_text(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit("")
    column = F.col(name)
    if isinstance(df.schema[name].dataType, T.ArrayType):
        texts = F.transform(column, lambda item: item.cast("string"))
        return F.coalesce(F.array_join(F.filter(texts, lambda item: item.isNotNull()), ", "), F.lit(""))
    return F.coalesce(column.cast("string"), F.lit(""))


def template_text(df: DataFrame, template: str) -> Column:
    """Fill ``{field}`` slots from the row; unknown and null fields are empty, lists are comma-joined.

    Every slot of the template is filled once: text that happens to contain a slot is left as it is.
    """
    parts: list[Column] = []
    for position, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if position % 2:
            parts.append(_field_text(df, piece))
        elif piece:
            parts.append(F.lit(piece))
    return strip(F.concat(*parts)) if parts else F.lit("")


def strip(value: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def title_abstract(title: Column, abstract: Column) -> Column:
    """``title [SEP] abstract``; the abstract alone without a title; null without an abstract."""
    title = F.coalesce(strip(title), F.lit(""))
    abstract = F.coalesce(strip(abstract), F.lit(""))
    joined = F.when(title != "", F.concat(title, F.lit(" [SEP] "), abstract)).otherwise(abstract)
    return F.when(abstract != "", joined)


def slug(label: Column) -> Column:
    """File-name form of a label."""
    named = F.regexp_replace(F.regexp_replace(F.regexp_replace(label, r"\+", "plus"), "<", "lt"), ">", "gt")
    dashed = F.regexp_replace(named, r"[^A-Za-z0-9.\-]", "-")
    return F.lower(F.regexp_replace(F.regexp_replace(dashed, "-+", "-"), "^-+|-+$", ""))


def shard_key(item_id: Column) -> Column:
    """Last two digits of an id, zero-padded."""
    return F.lpad(F.right(item_id.cast("string"), F.lit(2)), 2, "0")


def year_of(value: Column) -> Column:
    """Year of a date text; null where it is not a date."""
    return F.year(value.try_cast("date"))


def doi_url(doi: Column, item_id: Column) -> Column:
    """Link of a paper: its own link, else its DOI page, else its preprint page."""
    doi = strip(doi)
    return (
        F.when(doi.isNull() | (doi == ""), F.concat(F.lit("https://arxiv.org/abs/"), item_id.cast("string")))
        .when(F.startswith(doi, F.lit("http")), doi)
        .otherwise(F.concat(F.lit("https://doi.org/"), doi))
    )


def clean_text(value: Column) -> Column:
    """Trimmed text on one line."""
    return F.regexp_replace(strip(value), "\n", " ")


def truncated(value: Column, limit: int, mark: str = "...") -> Column:
    """The first ``limit`` characters, marked where something was left out (a preview, never an input)."""
    return F.when(F.length(value) > limit, F.concat(F.substring(value, 1, limit), F.lit(mark))).otherwise(value)


def list_preview(items: Column, limit: int) -> Column:
    """The first ``limit`` items and how many more there are."""
    shown = F.array_join(F.slice(items, 1, limit), ", ")
    more = F.concat(F.lit(" +"), (F.size(items) - limit).cast("string"), F.lit(" more"))
    return F.when(F.size(items) > limit, F.concat(shown, more)).otherwise(shown)


def star_string(rating: Column) -> Column:
    """Five stars, filled up to the rounded rating."""
    full = F.greatest(F.lit(0), F.least(F.lit(5), F.bround(rating.cast("double")).cast("int")))
    return F.concat(F.repeat(F.lit("★"), full), F.repeat(F.lit("☆"), F.lit(5) - full))


def one_decimal(value: Column) -> Column:
    """A value from 1 up with one decimal, rounded on its exact binary value, halves up.

    Decimal rounding would show 3.15 as 3.2, although the stored number lies below it.
    """
    whole = F.floor(value)
    fraction = ((value - whole) * F.lit(float(2**52))).cast("long")
    tenths = whole * 10 + F.shiftright(fraction * 10 + F.lit(2**51), 52)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def stat_line(avg_rating: Column, n_ratings: Column, minutes: Column, n_steps: Column,
              n_ingredients: Column, submitted: Column) -> Column:
    """One line of facts about an item; unknown facts are left out."""
    def fact(value: Column, suffix: str) -> Column:
        return F.when(value.isNotNull() & (value != 0), F.concat(value.cast("string"), F.lit(suffix)))

    counted = F.when(n_ratings.isNotNull(), F.concat(F.lit(" ("), n_ratings.cast("string"), F.lit(" ratings)")))
    rating = F.concat(F.lit("★ "), one_decimal(avg_rating), F.coalesce(counted, F.lit("")))
    return F.concat_ws(
        " · ",
        F.when(avg_rating.isNotNull(), rating),
        fact(minutes, " min"),
        fact(n_steps, " steps"),
        fact(n_ingredients, " ingredients"),
        F.when(submitted != "", F.substring(submitted, 1, 7)),
    )


def hover_text(name: Column, labels: Column, minutes: Column, items: Column, description: Column) -> Column:
    """Tooltip of an item: name, then per family ``family: category (score)``, time, items and description.

    ``labels`` is an array of (family, category, score); families without a category are left out.
    """
    families = F.transform(
        F.filter(labels, lambda of: of["category"].isNotNull()),
        lambda of: F.concat(of["family"], F.lit(": "), of["category"], F.lit(" ("), F.format_string("%.2f", of["score"]), F.lit(")")),
    )
    about = F.coalesce(strip(description), F.lit(""))
    return F.concat_ws(
        "\n",
        F.coalesce(name, F.lit("Unknown")),
        families,
        F.when(minutes.isNotNull() & (minutes != 0), F.concat(F.lit("Time: "), minutes.cast("string"), F.lit(" min"))),
        F.when(F.size(items) > 0, F.concat(F.lit("Ingredients: "), list_preview(items, 6))),
        F.when(about != "", truncated(about, 200)),
    )


def name_matches(name: Column, pattern: str) -> Column:
    """Case-insensitive regular-expression search; a null name never matches."""
    return F.coalesce(name.rlike(f"(?i){pattern}"), F.lit(False))


def name_contains(name: Column, text: str) -> Column:
    """Case-insensitive literal search."""
    return F.coalesce(F.contains(F.lower(name), F.lit(text.lower())), F.lit(False))


def relabelled(label: Column, overrides: Mapping[str, str]) -> Column:
    """Display form of a label."""
    shown = label
    for raw, display in overrides.items():
        shown = F.when(label == raw, F.lit(display)).otherwise(shown)
    return shown


def or_unassigned(label: Column) -> Column:
    return F.coalesce(label, F.lit("Unassigned"))


def normalised_items(items: Column) -> Column:
    """Items of a list, trimmed and in lower case."""
    return F.transform(items, lambda item: F.lower(strip(item)))


def parse_list(literal: Column) -> Column:
    """Array from a list literal with single or double quotes; unreadable text gives an empty array."""
    return F.when(literal.isNotNull(), F.coalesce(_read_list(literal), F.array().cast("array<string>")))


def list_unreadable(literal: Column) -> Column:
    """Whether a list literal could not be read."""
    return literal.isNotNull() & _read_list(literal).isNull()


def _read_list(literal: Column) -> Column:
    readable = F.regexp_replace(literal, r"(?<=[\[,\s])None(?=[\],\s])", "null")
    options = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
    return F.from_json(readable, "array<string>", options)


def word_runs(value: Column) -> Column:
    """Lower-case letter and digit runs of a text; the first and last entry may be empty."""
    return F.split(F.lower(value), r"[^\p{L}\p{N}]+")


def words(value: Column) -> Column:
    """Lower-case letter and digit runs of a text."""
    return F.filter(word_runs(value), lambda word: word != "")


def hashed_words(value: Column, dims: int) -> Column:
    """Slot of every word of a text in a ``dims``-wide hashing space."""
    return F.transform(words(value), lambda word: F.pmod(F.xxhash64(word), F.lit(dims)).cast("int"))
