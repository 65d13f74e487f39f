"""Tag co-occurrence, hierarchy and training labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import tags as G
from orrery.operators import items, ratings, taxonomy
from orrery.plans.registry import query
from orrery.plans.sql import with_views
from orrery.sources import views

SIZE_TAGS = ("wide", "mid", "tiny")
TYPE_TAGS = ("economy", "large", "medium", "promo", "small", "standard")
ALL_TAGS = SIZE_TAGS + TYPE_TAGS

_PAIRS = """
    , t AS (SELECT DISTINCT id, tag FROM recipe_tags),
    n AS (SELECT tag, COUNT(*) AS n FROM t GROUP BY tag),
    p AS (SELECT x.tag AS a, y.tag AS b, COUNT(*) AS n FROM t x JOIN t y ON x.id = y.id WHERE x.tag <> y.tag GROUP BY 1, 2),
    q AS (SELECT a AS child, b AS parent, na.n AS n_child, nb.n AS n_parent, p.n AS n_both, ROUND(p.n / na.n, 4) AS pct
          FROM p JOIN n na ON na.tag = a JOIN n nb ON nb.tag = b WHERE p.n / na.n >= 0.99 AND nb.n > na.n),
    e AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY child ORDER BY n_parent, parent) AS r FROM q) WHERE r = 1)"""


def _edges(spark, folder):
    return taxonomy.immediate_parents(taxonomy.qualifying_pairs(views.recipe_tags(spark, folder), ALL_TAGS))


@query("tag_pairs", with_views("recipe_tags", body=_PAIRS + " SELECT a, b, n FROM p"))
def tag_pairs(spark, folder):
    return items.pair_counts(views.recipe_tags(spark, folder), taxonomy.vocabulary(spark, ALL_TAGS))


@query("item_pairs", with_views("recipe_items", body="""
    , c AS (SELECT id, ingredient, COUNT(*) AS c FROM recipe_items GROUP BY ALL)
    SELECT x.ingredient AS a, y.ingredient AS b, CAST(SUM(x.c * y.c) AS BIGINT) AS n FROM c x JOIN c y ON x.id = y.id
    WHERE x.ingredient <> y.ingredient GROUP BY 1, 2"""))
def item_pairs(spark, folder):
    held = views.recipe_items(spark, folder)
    return items.pair_counts(held, held.select("ingredient").distinct(), "ingredient", as_set=False)


@query("class_pairs", with_views("recipe_tags", body=_PAIRS + " SELECT child, parent, n_child, n_parent, n_both, pct FROM q"))
def class_pairs(spark, folder):
    return taxonomy.qualifying_pairs(views.recipe_tags(spark, folder), ALL_TAGS)


@query("taxonomy_edges", with_views("recipe_tags", body=_PAIRS + " SELECT child, parent, n_child, n_parent, n_both, pct FROM e"))
def taxonomy_edges(spark, folder):
    return _edges(spark, folder)


@query("children", with_views("recipe_tags", body=_PAIRS + """
    SELECT parent, STRING_AGG(child, ',' ORDER BY child) AS children FROM e GROUP BY parent"""))
def children(spark, folder):
    return taxonomy.children(_edges(spark, folder)).select("parent", F.array_join("children", ",").alias("children"))


@query("taxonomy_closure", with_views("recipe_tags", recursive=True, body=_PAIRS + """
    , c AS (SELECT child, parent AS ancestor, 1 AS depth FROM e
            UNION ALL SELECT c.child, e.parent, c.depth + 1 FROM c JOIN e ON e.child = c.ancestor)
    SELECT child, ancestor, depth FROM c"""))
def taxonomy_closure(spark, folder):
    return taxonomy.closure(_edges(spark, folder))


@query("taxonomy_report", with_views("recipe_tags", recursive=True, body=_PAIRS + """
    , k AS (SELECT tag, n, CONCAT(LPAD(CAST(1000000000000000 - n AS VARCHAR), 16, '0'), ' ', tag) AS key FROM n),
    w AS (SELECT tag, n, key AS path, 0 AS depth FROM k WHERE tag NOT IN (SELECT child FROM e)
          UNION ALL SELECT k.tag, k.n, CONCAT(w.path, '/', k.key), w.depth + 1 FROM w JOIN e ON e.parent = w.tag JOIN k ON k.tag = e.child)
    SELECT path, depth, tag, CONCAT(REPEAT('  ', depth + 1), tag, ' (', FORMAT('{:,}', n), ')') AS line FROM w"""))
def taxonomy_report(spark, folder):
    return taxonomy.report(_edges(spark, folder), taxonomy.tag_counts(views.recipe_tags(spark, folder), ALL_TAGS))


_LABELS = """
    , s AS (SELECT p_partkey AS id, p_size FROM part)
    SELECT id, CASE WHEN p_size < 10 THEN 'tiny' WHEN p_size < 25 THEN 'mid' WHEN p_size < 40 THEN 'wide' END AS label,
           CASE WHEN p_size < 40 THEN 'labelled' ELSE 'untagged' END AS status FROM s"""


@query("train_labels", "WITH one AS (SELECT 1)" + _LABELS)
def train_labels(spark, folder):
    tags = views.recipe_tags(spark, folder)
    edges = taxonomy.immediate_parents(taxonomy.qualifying_pairs(tags, SIZE_TAGS))
    return taxonomy.training_labels(tags, SIZE_TAGS, taxonomy.closure(edges))


@query("label_status", """
    SELECT CASE WHEN p_size < 40 THEN 'ambiguous' ELSE 'labelled' END AS status, COUNT(*) AS n,
           ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 4) AS pct FROM part GROUP BY 1""")
def label_status(spark, folder):
    tags = views.recipe_tags(spark, folder)
    labels = taxonomy.training_labels(tags, ALL_TAGS, taxonomy.closure(_edges(spark, folder)))
    return ratings.shares(labels, "status")


@query("exclusive_tags", with_views("recipe_tags", body="""
    , w AS (SELECT DISTINCT id FROM recipe_tags WHERE tag = 'wide')
    SELECT tag, COUNT(*) AS n FROM recipe_tags t LEFT JOIN w ON t.id = w.id WHERE tag <> 'wide'
    GROUP BY tag HAVING COUNT(*) = COUNT(w.id) AND COUNT(*) >= 100"""))
def exclusive_tags(spark, folder):
    return taxonomy.exclusive_tags(views.recipe_tags(spark, folder), "wide", min_count=100)


@query("tag_intersect", with_views("recipe_tags", body="""
    SELECT id, COUNT(DISTINCT tag) AS n, STRING_AGG(DISTINCT tag, ',' ORDER BY tag) AS tags
    FROM recipe_tags WHERE tag IN ('wide', 'mid', 'tiny') GROUP BY id"""))
def tag_intersect(spark, folder):
    listed = taxonomy.vocabulary(spark, SIZE_TAGS)
    held = views.recipe_tags(spark, folder).join(F.broadcast(listed), "tag", "left_semi")
    kept = held.groupBy("id").agg(G.class_tags(F.array_distinct(F.collect_set("tag")), SIZE_TAGS).alias("t"))
    return kept.select("id", F.size("t").cast("long").alias("n"), F.array_join(F.array_sort("t"), ",").alias("tags"))
