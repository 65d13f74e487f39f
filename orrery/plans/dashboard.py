"""Whole-table figures, distributions and drill-downs."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.config import ENCODERS
from orrery.functions.encode import clip, rating_fraction
from orrery.operators import categories, clusters, explore, members, numbers, ratings
from orrery.plans import inputs
from orrery.plans.registry import query
from orrery.plans.sql import with_views
from orrery.session import cut
from orrery.sources import views


@query("kpis", with_views("interactions", "recipes", body="""
    SELECT COUNT(*) AS n_interactions, COUNT(DISTINCT user_id) AS n_users, ROUND(AVG(rating), 4) AS avg_rating,
           (SELECT COUNT(*) FROM recipes) AS n_recipes FROM interactions"""))
def kpis(spark, folder):
    return ratings.totals(views.recipes(spark, folder), views.interactions(spark, folder))


@query("monthly", with_views("interactions", body="""
    , m AS (SELECT CAST(DATE_TRUNC('month', date) AS DATE) AS m, COUNT(rating) AS n, ROUND(AVG(rating), 6) AS a
            FROM interactions WHERE date IS NOT NULL GROUP BY 1),
    s AS (SELECT CAST(UNNEST(generate_series((SELECT MIN(m) FROM m), (SELECT MAX(m) FROM m), INTERVAL 1 MONTH)) AS DATE) AS m)
    SELECT CAST(LAST_DAY(s.m) AS VARCHAR) AS month_end, COALESCE(n, 0) AS n, a AS avg_rating FROM s LEFT JOIN m ON s.m = m.m"""))
def monthly(spark, folder):
    return ratings.monthly(views.interactions(spark, folder)).withColumn("month_end", F.col("month_end").cast("string"))


@query("value_counts", with_views("interactions", body="""
    SELECT rating, COUNT(*) AS n FROM interactions GROUP BY rating ORDER BY rating"""))
def value_counts(spark, folder):
    return views.interactions(spark, folder).groupBy("rating").agg(F.count(F.lit(1)).alias("n")).orderBy("rating")


@query("rating_share", with_views("interactions", body="""
    SELECT rating, COUNT(*) AS n, ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 4) AS pct
    FROM interactions GROUP BY rating"""))
def rating_share(spark, folder):
    return ratings.shares(views.interactions(spark, folder), "rating", 4, percent=True)


@query("histogram", """
    WITH b AS (SELECT MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem),
    c AS (SELECT LEAST(CAST(FLOOR((l_extendedprice - lo) / ((hi - lo) / 30)) AS INT), 29) AS bin, COUNT(*) AS n
          FROM lineitem, b GROUP BY 1)
    SELECT CAST(s.bin AS INT) AS bin, ROUND(lo + s.bin * ((hi - lo) / 30), 6) AS lo,
           ROUND(lo + (s.bin + 1) * ((hi - lo) / 30), 6) AS hi, COALESCE(n, 0) AS n
    FROM (SELECT UNNEST(range(30)) AS bin) s CROSS JOIN b LEFT JOIN c ON c.bin = s.bin""")
def histogram(spark, folder):
    return numbers.histogram(views.table(spark, folder, "lineitem"), "l_extendedprice", 30)


@query("describe", with_views("recipes", body="""
    SELECT COUNT(minutes) AS n, CAST(MIN(minutes) AS DOUBLE) AS min, CAST(MAX(minutes) AS DOUBLE) AS max,
           ROUND(AVG(minutes), 6) AS mean, ROUND(STDDEV_POP(minutes), 6) AS std,
           """ + ", ".join(f"ROUND(QUANTILE_CONT(CAST(minutes AS DOUBLE), {p / 100}), 6) AS p{p}"
                           for p in (1, 5, 10, 25, 50, 75, 90, 95, 99)) + """,
           CAST(200 AS DOUBLE) AS cap, COUNT(CASE WHEN minutes > 200 THEN 1 END) AS n_above,
           ROUND(COUNT(CASE WHEN minutes > 200 THEN 1 END) * 100.0 / COUNT(minutes), 6) AS pct_above
    FROM recipes"""))
def describe(spark, folder):
    out = numbers.describe(views.recipes(spark, folder), "minutes", cap=200)
    whole = {"n", "n_above"}
    return out.select(*[F.col(c) if c in whole else F.round(c, 6).alias(c) for c in out.columns])


@query("clipped", with_views("recipes", body="""
    , c AS (SELECT QUANTILE_CONT(CAST(minutes AS DOUBLE), 0.99) AS cap FROM recipes)
    SELECT id, CASE WHEN minutes IS NOT NULL THEN LEAST(CAST(minutes AS DOUBLE), cap) END AS clipped FROM recipes, c"""))
def clipped(spark, folder):
    rows = views.recipes(spark, folder)
    cap = numbers.quantiles(numbers.value_counts(rows, "minutes"), [99]).scalar()
    return rows.select("id", clip(F.col("minutes").cast("double"), cap).alias("clipped"))


@query("popularity_buckets", with_views("interactions", body="""
    , c AS (SELECT recipe_id, COUNT(*) AS n FROM interactions GROUP BY 1),
    b AS (SELECT CASE WHEN n < 2 THEN 0 WHEN n < 3 THEN 1 WHEN n < 6 THEN 2 WHEN n < 11 THEN 3 WHEN n < 26 THEN 4
                      WHEN n < 101 THEN 5 ELSE 6 END AS bucket, COUNT(*) AS n FROM c GROUP BY 1)
    SELECT bucket, CASE bucket WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3–5' WHEN 3 THEN '6–10' WHEN 4 THEN '11–25'
                               WHEN 5 THEN '26–100' ELSE '101+' END AS label, n,
           ROUND(n * 100.0 / SUM(n) OVER (), 2) AS pct,
           CASE WHEN bucket = 0 THEN 'obscure' WHEN bucket < 5 THEN 'moderate' ELSE 'popular' END AS tier FROM b"""))
def popularity_buckets(spark, folder):
    return ratings.popularity_buckets(views.interactions(spark, folder))


@query("lifecycle", with_views("interactions", body="""
    SELECT CAST(YEAR(date) AS INT) AS year, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users, ROUND(AVG(rating), 4) AS avg_with,
           ROUND(AVG(CASE WHEN rating > 0 THEN rating END), 4) AS avg_without,
           ROUND(COUNT(CASE WHEN rating = 5 THEN 1 END) * 100.0 / COUNT(*), 1) AS pct5,
           COUNT(CASE WHEN rating = 0 THEN 1 END) AS n_zeros,
           ROUND(COUNT(CASE WHEN rating = 0 THEN 1 END) * 100.0 / COUNT(*), 2) AS pct_zero
    FROM interactions WHERE date IS NOT NULL GROUP BY 1"""))
def lifecycle(spark, folder):
    return ratings.lifecycle(views.interactions(spark, folder))


_FACET = """
    SELECT c.idx, c.label, COALESCE(n, 0) AS n FROM classes c
    LEFT JOIN (SELECT category, COUNT(*) AS n FROM ({members}) GROUP BY 1) m ON m.category = c.label
    WHERE c.family = '{family}'"""


@query("facet", with_views("assignments", "classes", body=_FACET.format(
    family="avg_rating", members="SELECT category FROM assignments WHERE family = 'avg_rating'")))
def facet(spark, folder):
    return categories.facet(inputs.assignments(spark, folder), inputs.classes(spark), "avg_rating")


@query("drilldown", with_views("assignments", "classes", body=_FACET.format(family="n_steps", members="""
    SELECT a.category FROM assignments a JOIN assignments b ON a.id = b.id
    WHERE a.family = 'n_steps' AND b.family = 'minutes' AND b.category = '1-2 hours'""")))
def drilldown(spark, folder):
    return categories.drill_down(
        inputs.assignments(spark, folder), inputs.classes(spark), "n_steps", ("minutes", "1-2 hours"))


@query("multi_highlight", with_views("assignments", body="""
    SELECT COUNT(CASE WHEN category IN ('1-2 hours', '2-4 hours') THEN 1 END) AS n_visible, COUNT(*) AS n_total
    FROM assignments WHERE family = 'minutes'"""))
def multi_highlight(spark, folder):
    return categories.highlighted(inputs.assignments(spark, folder), "minutes", ["1-2 hours", "2-4 hours"])


@query("visible_stats", """
    WITH r AS (SELECT vec_id, CASE WHEN label = 0 THEN -1 ELSE label END AS cluster,
                      CASE WHEN label <> 3 THEN CAST(ROUND(embedding[1], 3) AS DOUBLE) END AS v FROM embeddings),
    b AS (SELECT MIN(v) AS lo, MAX(v) AS hi FROM r),
    p AS (SELECT cluster, COALESCE((v - lo) / (hi - lo), -1) AS rating FROM r, b)
    SELECT COUNT(*) AS n_total, COUNT(CASE WHEN rating < 0 OR rating BETWEEN 0.25 AND 0.75 THEN 1 END) AS n_shown,
           COUNT(CASE WHEN rating >= 0 AND rating BETWEEN 0.25 AND 0.75 THEN 1 END) AS n_counted,
           COUNT(DISTINCT CASE WHEN cluster <> -1 AND (rating < 0 OR rating BETWEEN 0.25 AND 0.75) THEN cluster END) AS n_clusters
    FROM p""")
def visible_stats(spark, folder):
    number = F.round(F.col("embedding")[0], 3).cast("double")
    rows = views.embeddings(spark, folder).select(
        "id", F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("cluster"),
        F.when(F.col("label") != 3, number.cast("string")).alias("raw"))
    value = F.col("raw").try_cast("double")
    limits = rows.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    points = rows.select("id", "cluster", rating_fraction(F.col("raw"), limits["lo"], limits["hi"]).alias("rating"))
    return explore.visible_stats(points, 0.25, 0.75)


@query("cluster_sizes", with_views("points", body="""
    SELECT cluster, COUNT(*) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 4) AS pct, cluster = -1 AS is_noise
    FROM points GROUP BY cluster"""))
def cluster_sizes(spark, folder):
    return clusters.sizes(views.points(spark, folder))


@query("cluster_overview", with_views("points", body="""
    SELECT COUNT(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS n_clusters,
           COUNT(CASE WHEN cluster = -1 THEN 1 END) AS n_noise,
           ROUND(COUNT(CASE WHEN cluster = -1 THEN 1 END) / COUNT(*), 4) AS noise_share FROM points"""))
def cluster_overview(spark, folder):
    return clusters.overview(views.points(spark, folder))


def _facets(spark, folder):
    counted = inputs.assignments(spark, folder).groupBy("family", F.col("category").alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
    return categories.zero_filled(counted, inputs.classes(spark), ["family", "label"], ["n"])


@query("facet_sorted", with_views("assignments", "classes", body="""
    , f AS (SELECT c.family, c.idx, c.label, COALESCE(n, 0) AS n FROM classes c
            LEFT JOIN (SELECT family, category, COUNT(*) AS n FROM assignments GROUP BY ALL) a
              ON a.family = c.family AND a.category = c.label)
    SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY family ORDER BY n DESC, idx) AS INT) AS by_count,
           CAST(ROW_NUMBER() OVER (PARTITION BY family ORDER BY idx DESC) AS INT) AS reversed,
           CAST(ROW_NUMBER() OVER (PARTITION BY family ORDER BY label <> 'Unclustered', LOWER(label), idx) AS INT) AS by_name
    FROM f"""))
def facet_sorted(spark, folder):
    rows = explore.facet_positions(_facets(spark, folder), "count").withColumnRenamed("place", "by_count")
    rows = explore.facet_positions(rows, "reversed").withColumnRenamed("place", "reversed")
    return explore.facet_positions(rows, "name").withColumnRenamed("place", "by_name")


@query("distinct_labels", with_views("points", body="SELECT DISTINCT cluster FROM points WHERE cluster <> -1"))
def distinct_labels(spark, folder):
    return views.points(spark, folder).select("cluster").distinct().filter("cluster <> -1")


_WITHIN = """
    , chosen AS (SELECT a.id FROM assignments a JOIN assignments b ON a.id = b.id
                 WHERE a.family = 'minutes' AND a.category IN ('1-2 hours', '2-4 hours')
                   AND b.family = 'n_steps' AND b.idx > 2)"""
_CHOSEN = {"minutes": ["1-2 hours", "2-4 hours"]}


def _selection(spark, folder):
    maps = cut(members.bitmaps(inputs.assignments(spark, folder)))
    steps = next(encoder.classes for encoder in ENCODERS if encoder.field == "n_steps")
    return maps, members.selected(maps, _CHOSEN | {"n_steps": steps[3:]})


@query("selection_members", with_views("assignments", body=_WITHIN + " SELECT id FROM chosen"))
def selection_members(spark, folder):
    """The records with one of two labels of one family and one of several of another."""
    return members.ids(_selection(spark, folder)[1])


@query("selection_facet", with_views("assignments", "classes", body=_WITHIN + """
    SELECT c.idx, c.label, COALESCE(n, 0) AS n FROM classes c
    LEFT JOIN (SELECT category, COUNT(*) AS n FROM assignments JOIN chosen USING (id) WHERE family = 'submitted' GROUP BY 1) m
      ON m.category = c.label
    WHERE c.family = 'submitted'"""))
def selection_facet(spark, folder):
    """Labels of a third family among them."""
    maps, chosen = _selection(spark, folder)
    return members.facet_within(maps, inputs.classes(spark), "submitted", chosen)


@query("selection_counts", with_views("assignments", body=_WITHIN + """
    SELECT (SELECT COUNT(*) FROM chosen) AS n_chosen,
           (SELECT COUNT(*) FROM assignments WHERE family = 'minutes' AND category IN ('1-2 hours', '2-4 hours')) AS n_either"""))
def selection_counts(spark, folder):
    maps, chosen = _selection(spark, folder)
    either = members.count(members.selected(maps, _CHOSEN))
    return members.count(chosen).select(F.col("n").alias("n_chosen"), either.scalar().alias("n_either"))
