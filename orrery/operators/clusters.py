"""Names, sizes and groups of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from orrery.config import GROUP_MERGE_THRESHOLD
from orrery.functions.text import word_runs
from orrery.operators.density import NOISE
from orrery.operators.embed import embed_text
from orrery.operators.graphs import connected_components, linking_edges
from orrery.operators.positions import with_position
from orrery.operators.ratings import with_share
from orrery.session import cut


def sizes(points: DataFrame) -> DataFrame:
    """Points per cluster and their share of all points."""
    counts = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return with_share(counts).withColumn("is_noise", F.col("cluster") == NOISE)


def overview(points: DataFrame) -> DataFrame:
    """Number of clusters without noise, noise points and their share in one row."""
    counts = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    noise = F.coalesce(F.sum(F.when(F.col("cluster") == NOISE, F.col("n"))), F.lit(0))
    return counts.agg(
        F.count(F.when(F.col("cluster") != NOISE, 1)).alias("n_clusters"), noise.alias("n_noise"),
        F.round(noise / F.sum("n"), 4).alias("noise_share"),
    )


def distinctive_terms(texts: DataFrame, count: int = 3, min_length: int = 3) -> DataFrame:
    """(cluster, name): the terms frequent in a cluster and rare among the clusters."""
    tokens = texts.filter(F.col("cluster") != NOISE).select("cluster", F.explode(word_runs(F.col("text"))).alias("term"))
    counted = tokens.filter(F.length("term") >= min_length).groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = cut(counted)  # read three times; the texts are split once
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    clusters = tf.agg(F.countDistinct("cluster")).scalar()
    # rounded, so that equal weights are ties whatever the order of the arithmetic
    scored = tf.join(df, "term").withColumn("weight", F.round(F.col("tf") * F.log(clusters / F.col("df")), 9))
    best = Window.partitionBy("cluster").orderBy(F.col("weight").desc(), "term")
    kept = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= count)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return kept.groupBy("cluster").agg(F.concat_ws(" ", F.transform(ordered, lambda t: t["term"])).alias("name"))


def filled_names(clusters: DataFrame, names: DataFrame) -> DataFrame:
    """A name for every cluster id: its own, ``Cluster N``, or ``Unclustered`` for noise."""
    fallback = F.when(F.col("cluster") == NOISE, "Unclustered").otherwise(
        F.concat(F.lit("Cluster "), F.col("cluster").cast("string"))
    )
    return clusters.select("cluster").distinct().join(names, "cluster", "left").select(
        "cluster", F.coalesce("name", fallback).alias("name")
    )


def still_unnamed(clusters: DataFrame, named: DataFrame) -> DataFrame:
    """Clusters a resumed naming run has yet to name."""
    return clusters.select("cluster").distinct().filter(F.col("cluster") != NOISE).join(
        named.select("cluster"), "cluster", "left_anti"
    )


def merged_groups(vectors: DataFrame, threshold: float = GROUP_MERGE_THRESHOLD, **sizes_: int) -> DataFrame:
    """(id, component, group): groups whose vectors are similar enough, directly or in a chain, become one.

    Groups are numbered from 0 by their smallest member; the noise group -1 is left alone.
    """
    named = vectors.filter(F.col("id") >= 0)
    edges = linking_edges(named, threshold, **sizes_)
    component = connected_components(named, edges)
    order = with_position(component.select("component").distinct(), ["component"], "group")
    merged = component.join(order, "component").select("id", "component", "group")
    aside = vectors.filter(F.col("id") < 0).select(
        "id", F.col("id").alias("component"), F.col("id").alias("group")
    )
    return merged.unionByName(aside)


def merged_clusters(names: DataFrame, vectors: DataFrame, members: DataFrame, threshold: float = GROUP_MERGE_THRESHOLD,
                    **sizes_: int) -> tuple[DataFrame, DataFrame]:
    """Clusters with similar names as one: (members with their new cluster, table of the new clusters).

    ``names`` is (cluster, name), ``vectors`` (id, embedding) of the names by cluster, ``members`` any rows
    with a cluster; every cluster but the noise has a name and a vector. A new cluster has the name of
    its first old one and lists the old ones; noise stays -1.
    """
    groups = cut(merged_groups(vectors.select(F.col("id").cast("long").alias("id"), "embedding"), threshold, **sizes_))
    placed = groups.select(F.col("id").alias("cluster"), F.col("group").alias("merged"))
    joined = members.join(placed, "cluster", "left").withColumn(
        "cluster", F.when(F.col("cluster") == NOISE, NOISE).otherwise(F.col("merged")).cast("int")).drop("merged")
    named = placed.join(names.select(F.col("cluster").cast("long").alias("cluster"), "name"), "cluster").filter("merged >= 0")
    table = named.groupBy(F.col("merged").cast("int").alias("cluster")).agg(
        F.min_by("name", "cluster").alias("name"), F.array_sort(F.collect_list("cluster")).alias("merged_from"))
    counts = joined.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return joined.select(*members.columns), table.join(counts, "cluster", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def meta_groups(names: DataFrame, threshold: float = 0.5, dims: int = 256) -> DataFrame:
    """(group, cluster) of clusters with similar names, groups numbered from 0 by their first cluster.

    Clusters alike to no other are in group -1.
    """
    titled = names.filter(F.col("cluster") >= 0).select(F.col("cluster").cast("long").alias("id"), F.col("name").alias("text"))
    vectors = cut(embed_text(titled, dims))
    component = cut(connected_components(vectors, linking_edges(vectors, threshold)))
    shared = component.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
    numbered = with_position(shared, ["component"], "group")
    return component.join(numbered, "component", "left").select(
        F.coalesce("group", F.lit(NOISE)).alias("group"), F.col("id").alias("cluster")
    )


def group_names(grouped: DataFrame, names: DataFrame) -> DataFrame:
    """(group, name, n_clusters): a group is called after its first cluster, group -1 ``Ungrouped``."""
    return grouped.join(names, "cluster", "left").groupBy("group").agg(
        F.when(F.col("group") == NOISE, "Ungrouped").otherwise(F.min_by("name", "cluster")).alias("name"),
        F.count(F.lit(1)).alias("n_clusters"),
    )
