"""All stages over one small catalogue."""

import tempfile

import pytest
from pyspark.sql import functions as F

from orrery.plans import stages
from orrery.sources import views


@pytest.fixture(scope="module")
def inputs(spark, folder):
    tags = views.recipe_tags(spark, folder).groupBy("id").agg(F.collect_list("tag").alias("tags"))
    items = views.recipe_items(spark, folder).groupBy("id").agg(F.collect_list("ingredient").alias("ingredients"))
    recipes = views.recipes(spark, folder).join(tags, "id").join(items, "id", "left").withColumn(
        "description", F.concat(F.lit("a "), "name"))
    said = F.when(F.col("rating") > 3, F.concat(F.lit("liked by "), F.col("user_id").cast("string")))
    return recipes, views.interactions(spark, folder).withColumn("review", said)


def test_build_and_restart(spark, inputs):
    out = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    recipes, interactions = inputs
    lists = {"sizes": ("wide", "mid", "tiny")}
    stages.build(spark, recipes, interactions, lists, out, k=5)
    total = recipes.count()
    wide = spark.read.parquet(f"{out}/explore")
    assert wide.count() == total and {"label_sizes", "label_minutes", "chunk_id", "avg_rating"} <= set(wide.columns)
    inferred = spark.read.parquet(f"{out}/inferred")
    assert inferred.count() == total and {r["family"] for r in inferred.select("family").distinct().collect()} == {"sizes"}
    assert spark.read.parquet(f"{out}/manifest").first()["total"] == total
    width = spark.read.parquet(f"{out}/attributes").columns
    assert {"id", "chunk_id", "sizes", "minutes"} <= set(width)
    rows = spark.read.json(f"{out}/files/categories/documents")
    sizes = rows.filter("family = 'sizes'").collect()
    assert {r["category"] for r in sizes} == {"wide", "mid", "tiny"} and sum(r["recipe_count"] for r in sizes) == total
    index = spark.read.json(f"{out}/files/categories/index").filter("family = 'sizes'").first()["files"]
    assert index["wide"] == "sizes_wide.json.gz"
    assert spark.read.json(f"{out}/files/chunks").select("id").distinct().count() == total
    assert spark.read.json(f"{out}/files/recipes").count() == spark.read.json(f"{out}/files/records/metrics").count() == total
    reviews = spark.read.json(f"{out}/files/records/ratings")
    kept = interactions.filter("rating > 0").join(recipes.withColumnRenamed("id", "recipe_id"), "recipe_id", "left_semi")
    assert reviews.count() == kept.count() and {"position", "review"} <= set(reviews.columns)
    rolled = spark.read.parquet(f"{out}/category_metrics")
    assert rolled.filter("family = 'sizes'").agg(F.sum("recipe_count")).first()[0] == total
    stages.build(spark, recipes, interactions, lists, out, start="export", k=5)
    assert spark.read.parquet(f"{out}/explore").count() == total
