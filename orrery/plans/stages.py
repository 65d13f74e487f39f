"""The whole catalogue, from records and interactions to the tables an explorer reads.

Every stage is a table below one folder, so a later run can start from any of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.config import (
    ENCODERS, KNN_NEIGHBOURS, PROJECTION_WEIGHTS, SECONDARY_FAMILIES, TEXT_TEMPLATE, BinEncoder,
)
from orrery.functions.text import template_text
from orrery.operators import categories, documents, embed, layout, neighbours, ratings, taxonomy
from orrery.sources import writers

STAGES = ("embed", "assign", "ratings", "encode", "metrics", "project", "export")


def _save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def build(spark: SparkSession, recipes: DataFrame, interactions: DataFrame,
          class_lists: Mapping[str, Sequence[str]], out: str, start: str = STAGES[0],
          k: int = KNN_NEIGHBOURS, encoders: Sequence[BinEncoder] = ENCODERS,
          template: str = TEXT_TEMPLATE) -> None:
    """Run the stages from ``start`` on and write their tables below ``out``.

    ``recipes`` has the columns the template and the encoders name, and ``tags``;
    ``class_lists`` holds the tag classes of every family to infer.
    """
    todo = STAGES[STAGES.index(start):]

    def stored(name: str) -> DataFrame:
        return spark.read.parquet(f"{out}/{name}")

    if "embed" in todo:
        texts = recipes.select("id", template_text(recipes, template).alias("text"))
        _save(embed.embed_text(texts), f"{out}/vectors")
    if "assign" in todo:
        tags = recipes.select("id", F.explode("tags").alias("tag"))
        for family, listed in class_lists.items():
            edges = taxonomy.immediate_parents(taxonomy.qualifying_pairs(tags, listed))
            _save(edges, f"{out}/taxonomy/family={family}")
            above = taxonomy.closure(stored(f"taxonomy/family={family}"))
            labels = taxonomy.training_labels(tags, listed, above).filter("status = 'labelled'")
            _save(labels, f"{out}/labels/family={family}")
            found = neighbours.assign(stored("vectors"), stored(f"labels/family={family}"), k)
            _save(found, f"{out}/inferred/family={family}")
    if "ratings" in todo:
        _save(ratings.contrib(interactions), f"{out}/contrib")
    if "encode" in todo:
        records = recipes.join(stored("contrib"), "id", "left")
        _save(categories.assign_bins(records, encoders), f"{out}/binned")
        writers.features(categories.encode_features(records, encoders), f"{out}/features")
    binned = stored("binned").select("id", "family", "category", "score")
    inferred = stored("inferred").select("id", "family", "category", "score")
    assignments = binned.unionByName(inferred)
    classes = categories.class_table(
        spark, {**{e.field: e.classes for e in encoders}, **{f: sorted(c) for f, c in class_lists.items()}})
    if "metrics" in todo:
        _save(ratings.summary_documents(recipes, interactions), f"{out}/recipe_metrics")
        _save(categories.rollup(assignments, interactions, classes), f"{out}/category_metrics")
        _save(categories.rollup_years(assignments, interactions), f"{out}/category_years")
        items = recipes.select("id", F.explode("ingredients").alias("ingredient"))
        _save(categories.items_per_category(assignments, items), f"{out}/category_items")
        _save(categories.secondary_distribution(assignments, classes, SECONDARY_FAMILIES), f"{out}/distributions")
        writers.sharded_metrics(spark.read.parquet(f"{out}/recipe_metrics"), f"{out}/files/recipes")
        writers.category_documents(
            documents.category_documents(assignments, interactions, classes, SECONDARY_FAMILIES),
            documents.category_items(assignments, items), f"{out}/files/categories")
    if "project" in todo:
        features = stored("features").withColumn("family", F.concat("family", F.lit("_features"))).unionByName(
            stored("inferred").select(
                "id", F.concat("family", F.lit("_proba")).alias("family"), F.col("proba").alias("vector")))
        families = [f"{e.field}_features" for e in encoders] + [f"{f}_proba" for f in class_lists]
        joined = layout.augmented(stored("vectors"), features, PROJECTION_WEIGHTS, families)
        _save(layout.recentred(layout.project(joined, 3)), f"{out}/layout")
    if "export" in todo:
        families = sorted([e.field for e in encoders] + list(class_lists))
        metadata = recipes.select("id", "name", "description", "ingredients", "minutes", "n_steps", "n_ingredients", "submitted")
        wide = layout.exploration_table(stored("layout"), assignments, families, metadata, stored("contrib"))
        _save(wide, f"{out}/explore")
        indexed = categories.with_class_index(assignments, classes)
        _save(layout.attributes(stored("explore"), indexed, families), f"{out}/attributes")
        _save(layout.manifest(stored("layout"), classes), f"{out}/manifest")
        writers.chunks(stored("explore"), f"{out}/files/chunks")
        review = ("review",) if "review" in interactions.columns else ()
        writers.entity_documents(recipes, interactions, f"{out}/files/records", review)
