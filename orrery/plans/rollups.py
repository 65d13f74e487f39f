"""Ratings per record, category and year."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.config import SECONDARY_FAMILIES, YEAR_RANGE
from orrery.operators import categories, items, ratings, relate
from orrery.plans import inputs
from orrery.plans.registry import query
from orrery.plans.sql import text, with_views
from orrery.sources import views

_STARS = ", ".join(f"COUNT(CASE WHEN rating = {s} THEN 1 END) AS count_{s}" for s in ratings.STARS)


@query("recipe_contrib", with_views("contrib", body="SELECT id, avg_rating, n_ratings FROM contrib"))
def recipe_contrib(spark, folder):
    return ratings.contrib(views.interactions(spark, folder))


@query("recipe_summary", with_views("interactions", "recipes", body=f"""
    , s AS (SELECT recipe_id, ROUND(AVG(CASE WHEN rating > 0 THEN rating END), 3) AS avg_rating, COUNT(*) AS n_reviews,
                   COUNT(CASE WHEN rating > 0 THEN 1 END) AS n_ratings, {_STARS}
            FROM interactions GROUP BY recipe_id)
    SELECT id, avg_rating, n_reviews, n_ratings, count_5, count_4, count_3, count_2, count_1,
           n_reviews IS NULL AS empty
    FROM recipes LEFT JOIN s ON id = recipe_id"""))
def recipe_summary(spark, folder):
    return ratings.summary(views.recipes(spark, folder), views.interactions(spark, folder)).drop(
        "n_dated", "count_no_rating")


@query("recipe_year_counts", with_views("interactions", body="""
    SELECT recipe_id, CAST(YEAR(date) AS INT) AS year, COUNT(*) AS n FROM interactions
    WHERE date IS NOT NULL GROUP BY ALL"""))
def recipe_year_counts(spark, folder):
    return ratings.year_counts(views.interactions(spark, folder))


_ROLLUP = """
    , x AS (SELECT family, category, rating, date FROM assignments JOIN interactions ON id = recipe_id),
    r AS (SELECT family, category, {avg} AS avg_rating, {total} AS total_reviews, {stars} FROM x GROUP BY ALL),
    m AS (SELECT family, category, COUNT(*) AS recipe_count FROM assignments GROUP BY ALL)
    SELECT c.family, c.label AS category, COALESCE(recipe_count, 0) AS recipe_count, avg_rating,
           COALESCE(total_reviews, 0) AS total_reviews, {filled}
    FROM classes c LEFT JOIN m ON c.family = m.family AND c.label = m.category
                   LEFT JOIN r ON c.family = r.family AND c.label = r.category"""
_FILLED = ", ".join(f"COALESCE(count_{s}, 0) AS count_{s}" for s in ratings.STARS)


@query("category_rollup", with_views("interactions", "assignments", "classes", body=_ROLLUP.format(
    avg="ROUND(AVG(CASE WHEN rating > 0 THEN rating END), 4)", total="COUNT(*)", stars=_STARS, filled=_FILLED)))
def category_rollup(spark, folder):
    return categories.rollup(
        inputs.assignments(spark, folder), views.interactions(spark, folder), inputs.classes(spark))


@query("legacy_summary", with_views("interactions", "assignments", "classes", body=_ROLLUP.format(
    avg="ROUND(AVG(rating), 4)", total="COUNT(date)", stars=_STARS, filled=_FILLED)))
def legacy_summary(spark, folder):
    return categories.rollup(
        inputs.assignments(spark, folder), views.interactions(spark, folder), inputs.classes(spark), include_zero=True)


@query("category_years", with_views("interactions", "assignments", body="""
    SELECT family, category, CAST(YEAR(date) AS INT) AS year, COUNT(*) AS n
    FROM assignments JOIN interactions ON id = recipe_id WHERE date IS NOT NULL GROUP BY ALL"""))
def category_years(spark, folder):
    return categories.rollup_years(inputs.assignments(spark, folder), views.interactions(spark, folder))


@query("category_items", with_views("recipe_items", "assignments", body="""
    SELECT family, category, ingredient, COUNT(*) AS n FROM assignments a JOIN recipe_items i ON a.id = i.id
    GROUP BY ALL"""))
def category_items(spark, folder):
    return categories.items_per_category(inputs.assignments(spark, folder), views.recipe_items(spark, folder))


_SECONDARY = ", ".join(text(f) for f in SECONDARY_FAMILIES)


@query("secondary_dist", with_views("assignments", "classes", body=f"""
    , n AS (SELECT p.family, p.category, s.family AS secondary, s.category AS label, COUNT(*) AS n
            FROM assignments p JOIN assignments s ON p.id = s.id GROUP BY ALL)
    SELECT p.family, p.label AS category, s.family AS secondary, s.label, COALESCE(n.n, 0) AS n
    FROM classes p CROSS JOIN classes s LEFT JOIN n
      ON n.family = p.family AND n.category = p.label AND n.secondary = s.family AND n.label = s.label
    WHERE s.family IN ({_SECONDARY})"""))
def secondary_dist(spark, folder):
    return categories.secondary_distribution(
        inputs.assignments(spark, folder), inputs.classes(spark), SECONDARY_FAMILIES)


@query("class_share", with_views("assignments", body="""
    SELECT family, category, COUNT(*) AS n,
           ROUND(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY family), 4) AS pct FROM assignments GROUP BY family, category"""))
def class_share(spark, folder):
    counts = inputs.assignments(spark, folder).groupBy("family", "category").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("family").agg(F.sum("n").alias("t"))
    return counts.join(total, "family").select("family", "category", "n", F.round(F.col("n") / F.col("t"), 4).alias("pct"))


@query("popularity", with_views("interactions", "recipes", body="""
    SELECT recipe_id, name, ROUND(AVG(rating), 2) AS avg_rating, COUNT(rating) AS num_reviews,
           ROUND(STDDEV_SAMP(rating), 6) AS rating_std
    FROM interactions JOIN recipes ON recipe_id = id WHERE name IS NOT NULL GROUP BY recipe_id, name"""))
def popularity(spark, folder):
    return ratings.popularity(views.interactions(spark, folder), views.recipes(spark, folder)).withColumn(
        "rating_std", F.round("rating_std", 6))


@query("popularity_top", with_views("interactions", "recipes", body="""
    SELECT recipe_id, name, ROUND(AVG(rating), 2) AS avg_rating, COUNT(rating) AS num_reviews
    FROM interactions JOIN recipes ON recipe_id = id WHERE name IS NOT NULL GROUP BY recipe_id, name
    HAVING COUNT(rating) >= 10 ORDER BY avg_rating DESC, recipe_id, name LIMIT 20"""))
def popularity_top(spark, folder):
    found = ratings.popularity(views.interactions(spark, folder), views.recipes(spark, folder)).drop("rating_std")
    return ratings.top(found.filter("num_reviews >= 10"), "avg_rating", 20, ["recipe_id", "name"])


@query("top10_min", with_views("interactions", "recipes", body="""
    , t AS (SELECT recipe_id, AVG(rating) AS a, COUNT(rating) AS rating_count FROM interactions GROUP BY recipe_id
            HAVING COUNT(rating) >= 20 ORDER BY a DESC, recipe_id LIMIT 10)
    SELECT recipe_id, ROUND(a, 6) AS avg_rating, rating_count, name FROM t LEFT JOIN recipes ON recipe_id = id"""))
def top10_min(spark, folder):
    return ratings.top_records(
        views.interactions(spark, folder), views.recipes(spark, folder), min_count=20
    ).withColumn("avg_rating", F.round("avg_rating", 6))


@query("year_spine", with_views("interactions", "recipes", body=f"""
    , n AS (SELECT recipe_id, YEAR(date) AS year, COUNT(*) AS n FROM interactions WHERE date IS NOT NULL GROUP BY ALL)
    SELECT r.id AS recipe_id, CAST(y.year AS INT) AS year, COALESCE(n.n, 0) AS n
    FROM recipes r CROSS JOIN (SELECT UNNEST(range({YEAR_RANGE[0]}, {YEAR_RANGE[1] + 1})) AS year) y
    LEFT JOIN n ON n.recipe_id = r.id AND n.year = y.year"""))
def year_spine(spark, folder):
    return ratings.year_spine(views.interactions(spark, folder), views.recipes(spark, folder), *YEAR_RANGE)


@query("rating_list", with_views("interactions", body="""
    SELECT recipe_id, COALESCE(CAST(date AS VARCHAR), '') AS date, rating,
           ROW_NUMBER() OVER (PARTITION BY recipe_id ORDER BY COALESCE(CAST(date AS VARCHAR), ''), rating) - 1 AS position
    FROM interactions WHERE rating BETWEEN 1 AND 5"""))
def rating_list(spark, folder):
    return ratings.rating_lists(views.interactions(spark, folder))


@query("unrated", with_views("interactions", "recipes", body="""
    SELECT id, COUNT(CASE WHEN rating = 0 THEN 1 END) AS count_no_rating,
           GREATEST(0, COUNT(*) - COUNT(CASE WHEN rating > 0 THEN 1 END)) AS derived_no_rating
    FROM recipes JOIN interactions ON id = recipe_id GROUP BY id"""))
def unrated(spark, folder):
    return ratings.unrated_counts(ratings.summary(views.recipes(spark, folder), views.interactions(spark, folder)))


@query("ratings_join", with_views("interactions", "assignments", body="""
    SELECT category, rating, COUNT(*) AS n FROM interactions JOIN assignments ON recipe_id = id
    WHERE family = 'minutes' AND rating BETWEEN 1 AND 5 GROUP BY ALL"""))
def ratings_join(spark, folder):
    per_record = ratings.starred(views.interactions(spark, folder)).groupBy(
        F.col("recipe_id").alias("id"), "rating").agg(F.count(F.lit(1)).alias("n"))
    minutes = inputs.assignments(spark, folder).filter((F.col("family") == "minutes") & F.col("category").isNotNull())
    return minutes.join(per_record, "id").groupBy("category", "rating").agg(F.sum("n").alias("n"))


@query("sorted_rollup", with_views("recipe_items", "assignments", body="""
    , c AS (SELECT family, category, ingredient, COUNT(*) AS n FROM assignments a JOIN recipe_items i ON a.id = i.id
            GROUP BY ALL)
    SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY family, category ORDER BY n DESC, ingredient) AS INT) AS rank FROM c"""))
def sorted_rollup(spark, folder):
    counted = categories.items_per_category(inputs.assignments(spark, folder), views.recipe_items(spark, folder))
    return categories.ranked_in_group(counted, ["family", "category"], [F.col("n").desc(), "ingredient"])


@query("wide_labels", with_views("assignments", body="""
    SELECT id, MAX(CASE WHEN family = 'minutes' THEN category END) AS minutes,
           MAX(CASE WHEN family = 'n_steps' THEN category END) AS n_steps,
           MAX(CASE WHEN family = 'avg_rating' THEN category END) AS avg_rating
    FROM assignments GROUP BY id"""))
def wide_labels(spark, folder):
    return relate.families_wide(inputs.assignments(spark, folder), ["minutes", "n_steps", "avg_rating"])


@query("label_maps", with_views("assignments", body="""
    SELECT id, STRING_AGG(CONCAT(family, '=', category), ';' ORDER BY family) AS labels FROM assignments GROUP BY id"""))
def label_maps(spark, folder):
    held = categories.label_maps(inputs.assignments(spark, folder))
    pairs = F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return held.select("id", F.array_join(F.array_sort(pairs), ";").alias("labels"))


@query("year_maps", with_views("interactions", "recipes", body="""
    , n AS (SELECT recipe_id, YEAR(date) AS year, COUNT(*) AS n FROM interactions WHERE date IS NOT NULL GROUP BY ALL),
    m AS (SELECT recipe_id, STRING_AGG(CONCAT(CAST(year AS VARCHAR), '=', CAST(n AS VARCHAR)), ';' ORDER BY year) AS years FROM n GROUP BY 1)
    SELECT id, years FROM recipes LEFT JOIN m ON id = recipe_id"""))
def year_maps(spark, folder):
    held = ratings.summary_documents(views.recipes(spark, folder), views.interactions(spark, folder))
    pairs = F.transform(F.map_entries("n_per_year"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string")))
    return held.select("id", F.array_join(pairs, ";").alias("years"))


@query("item_freq", with_views("recipe_items", body="""
    SELECT ingredient, COUNT(*) AS n FROM recipe_items GROUP BY ingredient ORDER BY n DESC, ingredient LIMIT 30"""))
def item_freq(spark, folder):
    return items.most_common(views.recipe_items(spark, folder), 30)


@query("item_rating", with_views("recipe_items", "interactions", body="""
    , t AS (SELECT ingredient, COUNT(*) AS n FROM recipe_items GROUP BY 1 ORDER BY n DESC, ingredient LIMIT 25)
    SELECT ingredient, ROUND(AVG(rating), 6) AS avg_rating, COUNT(rating) AS n
    FROM recipe_items JOIN interactions ON id = recipe_id WHERE ingredient IN (SELECT ingredient FROM t) GROUP BY 1"""))
def item_rating(spark, folder):
    return items.item_ratings(views.recipe_items(spark, folder), views.interactions(spark, folder), 25)


@query("cooccur_top", with_views("baskets", body="""
    , t AS (SELECT ingredient, COUNT(*) AS n FROM baskets GROUP BY 1 ORDER BY n DESC, ingredient LIMIT 15),
    p AS (SELECT x.ingredient AS a, y.ingredient AS b, COUNT(*) AS n FROM baskets x JOIN baskets y ON x.id = y.id
          WHERE x.ingredient <> y.ingredient GROUP BY 1, 2)
    SELECT t.ingredient AS a, u.ingredient AS b, COALESCE(p.n, 0) AS n
    FROM t CROSS JOIN t u LEFT JOIN p ON p.a = t.ingredient AND p.b = u.ingredient"""))
def cooccur_top(spark, folder):
    return items.pair_matrix(views.baskets(spark, folder), 15)


@query("stopworded", with_views("baskets", body="""
    SELECT LOWER(TRIM(ingredient)) AS ingredient, COUNT(*) AS n FROM baskets
    WHERE LOWER(TRIM(ingredient)) NOT IN ('red widget', 'small ring') GROUP BY 1"""))
def stopworded(spark, folder):
    held = views.baskets(spark, folder).withColumn("ingredient", F.lower(F.trim("ingredient")))
    return items.item_counts(held, ["red widget", "small ring"])
