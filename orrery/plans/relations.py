"""Lookups, semi and anti joins, merges and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import text as X
from orrery.operators import clusters, explore, ratings, relate
from orrery.plans.registry import query
from orrery.plans.sql import with_views
from orrery.sources import views


@query("left_lookup", with_views("interactions", "recipes", body="""
    SELECT COALESCE(name, '') AS name, r.id IS NOT NULL AS found, COUNT(*) AS n
    FROM interactions LEFT JOIN recipes r ON recipe_id = r.id GROUP BY 1, 2"""))
def left_lookup(spark, folder):
    per_record = views.interactions(spark, folder).groupBy("recipe_id").agg(F.count(F.lit(1)).alias("n"))
    names = views.recipes(spark, folder).select("id", "name")
    joined = relate.lookup(per_record, names, "recipe_id", "id", {"name": ""})
    return joined.groupBy("name", "found").agg(F.sum("n").alias("n"))


@query("lookup_rows", with_views("interactions", "recipes", body="""
    SELECT recipe_id, user_id, CAST(date AS VARCHAR) AS date, rating, COALESCE(name, 'unknown') AS name,
           r.id IS NOT NULL AS found FROM interactions LEFT JOIN recipes r ON recipe_id = r.id"""))
def lookup_rows(spark, folder):
    facts = views.interactions(spark, folder).withColumn("date", F.col("date").cast("string"))
    return relate.lookup(facts, views.recipes(spark, folder).select("id", "name"), "recipe_id", "id", {"name": "unknown"})


@query("semi", with_views("recipes", "interactions", body="""
    SELECT id, name FROM recipes WHERE id IN (SELECT recipe_id FROM interactions)"""))
def semi(spark, folder):
    seen = views.interactions(spark, folder).select(F.col("recipe_id").alias("id")).distinct()
    return relate.keep_ids(views.recipes(spark, folder).select("id", "name"), seen)


@query("anti", with_views("recipes", "interactions", body="""
    SELECT id, name FROM recipes WHERE id NOT IN (SELECT recipe_id FROM interactions)"""))
def anti(spark, folder):
    seen = views.interactions(spark, folder).select(F.col("recipe_id").alias("id")).distinct()
    return relate.drop_ids(views.recipes(spark, folder).select("id", "name"), seen)


@query("contrib_merge", with_views("contrib", "recipes", body="""
    SELECT COALESCE(r.id, c.id) AS id, COALESCE(c.n_ratings, r.n_steps) AS n_ratings, c.avg_rating, r.minutes
    FROM recipes r FULL OUTER JOIN contrib c ON r.id = c.id"""))
def contrib_merge(spark, folder):
    earlier = views.recipes(spark, folder).select("id", F.col("n_steps").cast("long").alias("n_ratings"), "minutes")
    return relate.merge_contribs([earlier, ratings.contrib(views.interactions(spark, folder))])


@query("union_chunks", """
    SELECT 'orders' AS origin, o_orderkey AS id, o_totalprice AS amount FROM orders
    UNION ALL SELECT 'customer', c_custkey, c_acctbal FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier""")
def union_chunks(spark, folder):
    def part(name, key, amount):
        return views.table(spark, folder, name).select(
            F.lit(name).alias("origin"), F.col(key).alias("id"), F.col(amount).alias("amount"))

    return relate.union_chunks([
        part("orders", "o_orderkey", "o_totalprice"), part("customer", "c_custkey", "c_acctbal"),
        part("supplier", "s_suppkey", "s_acctbal")])


@query("shard_lookup", with_views("recipes", body="""
    , s AS (SELECT LPAD(RIGHT(CAST(id AS VARCHAR), 2), 2, '0') AS shard, id, name FROM recipes)
    SELECT shard, COUNT(*) AS n, MIN(id) AS first, COUNT(name) AS named FROM s GROUP BY shard"""))
def shard_lookup(spark, folder):
    rows = views.recipes(spark, folder).select(X.shard_key(F.col("id")).alias("shard"), "id", "name")
    return rows.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.count("name").alias("named"))


@query("point_lookup", with_views("recipes", body="SELECT '42' AS shard, id, name FROM recipes WHERE id = 142"))
def point_lookup(spark, folder):
    rows = views.recipes(spark, folder).select(X.shard_key(F.col("id")).alias("shard"), "id", "name")
    return relate.record_of_shard(rows, "42", 142)


@query("name_fallback", with_views("points", body="""
    SELECT DISTINCT cluster, CASE WHEN cluster = -1 THEN 'Unclustered' WHEN cluster <= 4 THEN CONCAT('group ', CAST(cluster AS VARCHAR))
                                  ELSE CONCAT('Cluster ', CAST(cluster AS VARCHAR)) END AS name FROM points"""))
def name_fallback(spark, folder):
    rows = views.points(spark, folder)
    known = rows.select("cluster").distinct().filter("cluster BETWEEN 1 AND 4").select(
        "cluster", F.concat(F.lit("group "), F.col("cluster").cast("string")).alias("name"))
    return clusters.filled_names(rows, known)


@query("first_rows", with_views("recipes", body="SELECT id, name, minutes FROM recipes ORDER BY id LIMIT 100"))
def first_rows(spark, folder):
    return explore.first_rows(views.recipes(spark, folder).select("id", "name", "minutes"), "id", 100)


_DRAW = "CAST('0x' || SUBSTR(MD5('{seed}/' || CAST(id AS VARCHAR)), 1, 15) AS BIGINT), id"


@query("random_one", with_views("recipes", body=f" SELECT id, name FROM recipes ORDER BY {_DRAW.format(seed=7)} LIMIT 1"))
def random_one(spark, folder):
    return explore.one_at_random(views.recipes(spark, folder).select("id", "name"), seed=7)


@query("hash_sample", with_views("recipes", body=f" SELECT id, name FROM recipes ORDER BY {_DRAW.format(seed=42)} LIMIT 200"))
def hash_sample(spark, folder):
    return explore.sample(views.recipes(spark, folder).select("id", "name"), 200, seed=42)


@query("sample_per_cluster", with_views("points", body=f"""
    SELECT * FROM (SELECT id, cluster, CAST(ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY {_DRAW.format(seed=42)}) AS INT) AS rank FROM points)
    WHERE rank <= 5"""))
def sample_per_cluster(spark, folder):
    rows = views.points(spark, folder).select("id", "cluster")
    return explore.sample_per_group(rows, "cluster", 5, seed=42)
