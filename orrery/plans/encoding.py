"""Bins, rank-hot vectors, ranges and one-hot labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.config import AVG_RATING, ENCODERS, LABEL_OVERRIDES, MINUTES, N_RATINGS, SUBMITTED, RangeEncoder
from orrery.functions import encode as E
from orrery.functions import tags as G
from orrery.functions import text as X
from orrery.operators import categories
from orrery.plans import inputs
from orrery.plans.registry import query
from orrery.plans.sql import bin_sql, text, with_views
from orrery.sources import views


@query("bin_index", with_views("recipes", body=f"""
    SELECT id, CASE WHEN v IS NOT NULL THEN {bin_sql(MINUTES, 'v')} END AS bin,
           CASE WHEN v IS NOT NULL THEN ROUND(({bin_sql(MINUTES, 'v')}) / 5.0, 6) END AS position
    FROM (SELECT id, CAST(minutes AS DOUBLE) AS v FROM recipes)"""))
def bin_index(spark, folder):
    value = F.col("minutes").cast("double")
    return views.recipes(spark, folder).select(
        "id", E.bin_index(value, MINUTES.edges).alias("bin"),
        F.round(E.bin_position(value, MINUTES.edges), 6).alias("position"))


def _rank_hot_sql() -> str:
    edges = MINUTES.edges
    cells = ["SELECT id, 0 AS pos, 1.0 AS value FROM r"]
    for i in range(1, len(edges)):
        low, high = edges[i - 1], edges[i]
        cells.append(f"SELECT id, {i}, CASE WHEN v >= {high} THEN 1.0 WHEN v < {low} THEN 0.0 "
                     f"ELSE ROUND((v - {low}) / ({high} - {low}), 6) END FROM r")
    cells.append(f"SELECT id, {len(edges)}, CASE WHEN v >= {edges[-1]} THEN 1.0 ELSE 0.0 END FROM r")
    return (
        ", r AS (SELECT id, CAST(minutes AS DOUBLE) AS v FROM recipes WHERE minutes IS NOT NULL) "
        "SELECT id, pos, CAST(value AS DOUBLE) AS value FROM (" + " UNION ALL ".join(cells) + ")"
    )


@query("rank_hot", with_views("recipes", body=_rank_hot_sql()))
def rank_hot(spark, folder):
    rows = views.recipes(spark, folder).filter(F.col("minutes").isNotNull())
    vector = E.rank_hot(F.col("minutes").cast("double"), MINUTES.edges)
    return rows.select("id", F.posexplode(vector).alias("pos", "value")).withColumn("value", F.round("value", 6))


@query("minmax", with_views("recipes", body="""
    SELECT id, ROUND(CASE WHEN minutes IS NULL THEN 0.5 WHEN hi > lo THEN CAST(minutes - lo AS DOUBLE) / (hi - lo)
                          ELSE 0.5 END, 6) AS scaled
    FROM recipes, (SELECT MIN(minutes) AS lo, MAX(minutes) AS hi FROM recipes)"""))
def minmax(spark, folder):
    scaled = categories.scale_range(views.recipes(spark, folder), RangeEncoder("minutes", "minutes"))
    return scaled.select("id", F.round(F.element_at("vector", 1), 6).alias("scaled"))


@query("missing_policy", with_views("records", body=f"""
    SELECT id, CASE WHEN avg_rating IS NULL THEN 0 ELSE 1 + {bin_sql(AVG_RATING, 'avg_rating')} END AS rating_bin,
           CAST(CASE WHEN avg_rating IS NULL THEN 1 ELSE 0 END AS DOUBLE) AS missing_cell,
           CAST(CASE WHEN avg_rating IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS rating_score,
           {bin_sql(N_RATINGS, 'COALESCE(n_ratings, 0)')} AS count_bin,
           CAST(CASE WHEN minutes IS NULL THEN 0.5 ELSE 1 END AS DOUBLE) AS minutes_score
    FROM records"""))
def missing_policy(spark, folder):
    rows = inputs.records(spark, folder)
    rating, count = F.col("avg_rating"), F.col("n_ratings").cast("double")
    of_rating = E.bin_assignment(rating, AVG_RATING)
    return rows.select(
        "id", of_rating["bin"].alias("rating_bin"),
        F.element_at(E.bin_vector(rating, AVG_RATING), -1).alias("missing_cell"),
        of_rating["score"].alias("rating_score"),
        E.bin_assignment(count, N_RATINGS)["bin"].alias("count_bin"),
        E.bin_assignment(F.col("minutes").cast("double"), MINUTES)["score"].alias("minutes_score"))


@query("encoder_suite", with_views("assignments", body="SELECT id, family, category, score, idx AS bin FROM assignments"))
def encoder_suite(spark, folder):
    return inputs.assignments(spark, folder)


@query("feature_sums", with_views("records", body=f"""
    , v AS (SELECT id, CAST(SUBSTR(submitted, 1, 4) AS DOUBLE) AS y FROM records)
    SELECT id, family, width, CAST(total AS DOUBLE) AS total FROM (
    SELECT id, 'submitted' AS family, 1 AS width, ROUND(({bin_sql(SUBMITTED, 'y')}) / 19.0, 6) AS total FROM v
    UNION ALL SELECT id, 'n_steps', 5, 1 + CASE WHEN n_steps >= 21 THEN 1 ELSE 0 END
           + ROUND(GREATEST(0, LEAST(1, (n_steps - 6) / 5.0)), 6) + ROUND(GREATEST(0, LEAST(1, (n_steps - 11) / 5.0)), 6)
           + ROUND(GREATEST(0, LEAST(1, (n_steps - 16) / 5.0)), 6) FROM records)"""))
def feature_sums(spark, folder):
    chosen = [e for e in ENCODERS if e.field in ("submitted", "n_steps")]
    vectors = categories.encode_features(inputs.records(spark, folder), chosen)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return vectors.select("id", "family", F.size("vector").alias("width"), F.round(total, 6).alias("total"))


_PRIORITY = ("tiny", "mid", "promo")


@query("first_tag", with_views("recipe_tags", body="""
    , t AS (SELECT id, MIN(CASE tag WHEN 'tiny' THEN 0 WHEN 'mid' THEN 1 WHEN 'promo' THEN 2 ELSE 3 END) AS b
            FROM recipe_tags GROUP BY id)
    SELECT id, CASE b WHEN 0 THEN 'tiny' WHEN 1 THEN 'mid' WHEN 2 THEN 'promo' ELSE 'other' END AS label,
           CAST(CASE WHEN b = 0 THEN 1 ELSE 0 END AS DOUBLE) AS is_tiny,
           CAST(CASE WHEN b = 3 THEN 1 ELSE 0 END AS DOUBLE) AS is_other FROM t"""))
def first_tag(spark, folder):
    wanted = F.when(F.col("tag").isin(*_PRIORITY), F.col("tag"))
    held = views.recipe_tags(spark, folder).groupBy("id").agg(F.collect_set(wanted).alias("tags"))
    label = held.select("id", G.first_matching(F.col("tags"), _PRIORITY, "other").alias("label"))
    hot = G.one_hot(F.col("label"), [*_PRIORITY, "other"], "other")
    return label.select("id", "label", F.element_at(hot, 1).alias("is_tiny"), F.element_at(hot, 4).alias("is_other"))


@query("slug", with_views("classes", "recipes", body=r"""
    , l AS (SELECT label FROM classes UNION ALL SELECT CONCAT(name, ' ', submitted, '+') FROM recipes WHERE name IS NOT NULL)
    SELECT label, LOWER(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(
             REPLACE(REPLACE(REPLACE(label, '+', 'plus'), '<', 'lt'), '>', 'gt'), '[^A-Za-z0-9.\-]', '-', 'g'),
             '-+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM l"""))
def slug(spark, folder):
    named = views.recipes(spark, folder).filter(F.col("name").isNotNull()).select(
        F.concat("name", F.lit(" "), "submitted", F.lit("+")).alias("label"))
    labels = inputs.classes(spark).select("label").unionByName(named)
    return labels.select("label", X.slug(F.col("label")).alias("slug"))


@query("label_override", with_views("assignments", body="""
    SELECT id, CASE WHEN category = '<15 minutes' THEN 'quick' ELSE COALESCE(category, 'Unassigned') END AS label
    FROM (SELECT id, CASE WHEN score >= 0.75 THEN category END AS category FROM assignments WHERE family = 'minutes')"""))
def label_override(spark, folder):
    from orrery.functions.vectors import gated

    minutes = inputs.assignments(spark, folder).filter(F.col("family") == "minutes")
    shown = minutes.select("id", gated(F.col("category"), F.col("score"), 0.75).alias("category"))
    display = {**LABEL_OVERRIDES, "<15 minutes": "quick"}
    return shown.select("id", X.or_unassigned(X.relabelled(F.col("category"), display)).alias("label"))


@query("class_index", with_views("assignments", "classes", body=f"""
    SELECT a.id, a.family, CASE WHEN a.category = {text('4+ hours')} THEN 0 ELSE c.idx END AS idx
    FROM assignments a JOIN classes c ON a.family = c.family AND a.category = c.label"""))
def class_index(spark, folder):
    renamed = F.when(F.col("category") == "4+ hours", "not a class").otherwise(F.col("category"))
    rows = inputs.assignments(spark, folder).withColumn("category", renamed)
    return categories.with_class_index(rows, inputs.classes(spark)).select("id", "family", "idx")
