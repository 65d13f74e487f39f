"""Tag hierarchy from co-occurrence, and training labels read off it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from orrery.config import CHILD_THRESHOLD, EXCLUSIVE_MIN_COUNT
from orrery.functions.tags import quoted
from orrery.operators.positions import with_rank_in_group
from orrery.session import cut

LITERAL_CLASSES = 1_000  # longer class lists are sent as data, not as part of the plan
SAMPLED_MISSES = 4


def vocabulary(spark: SparkSession, classes: Sequence[str] | DataFrame) -> DataFrame:
    """The class list as a table (tag): any length, or a table as it is."""
    if isinstance(classes, DataFrame):
        return classes.select("tag")
    if 0 < len(classes) <= LITERAL_CLASSES:
        return spark.sql(f"SELECT * FROM VALUES {', '.join(f'({quoted(tag)})' for tag in classes)} AS classes(tag)")
    return spark.createDataFrame([(tag,) for tag in classes], "tag string")


def tag_counts(tags: DataFrame, classes: Sequence[str] | DataFrame) -> DataFrame:
    """Records per class tag; classes without a record count 0."""
    listed = vocabulary(tags.sparkSession, classes)
    held = tags.join(listed, "tag", "left_semi").select("id", "tag").distinct()
    counted = held.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return listed.join(counted, "tag", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def qualifying_pairs(tags: DataFrame, classes: Sequence[str] | DataFrame, threshold: float = CHILD_THRESHOLD) -> DataFrame:
    """(child, parent) where nearly all records of the child have the larger parent too.

    A child of n records may miss a parent m = floor((1 - threshold) * n) times at most, so in any s of
    its records a parent is there s - m times. Candidates are counted in s = ``SAMPLED_MISSES`` * (m + 1)
    records of each child, those with the fewest tags, which leaves few parents to each; only these pairs
    are then counted over all records. No record's tags are ever one value, and no pair is left out.
    """
    listed = vocabulary(tags.sparkSession, classes)
    held = cut(tags.join(listed, "tag", "left_semi").select("id", "tag").distinct())
    sizes = cut(held.groupBy("tag").agg(F.count(F.lit(1)).alias("n")))
    # a little more than floor(), against rounding: the last filter decides
    misses = F.floor((1.0 - threshold) * F.col("n_child") + 1e-6)
    child = sizes.select(F.col("tag").alias("child"), F.col("n").alias("n_child"))
    child = child.withColumn("misses", misses).withColumn("wanted", SAMPLED_MISSES * (misses + 1))
    parent = sizes.select(F.col("tag").alias("parent"), F.col("n").alias("n_parent"))
    widths = held.groupBy("id").agg(F.count(F.lit(1)).alias("width"))
    placed = with_rank_in_group(
        held.join(widths, "id").select("id", F.col("tag").alias("child"), "width"), ["child"], ["width", "id"], "place")
    chosen = placed.join(child, "child").filter(F.col("place") < F.col("wanted"))
    others = held.select("id", F.col("tag").alias("parent")).join(parent, "parent")
    seen = chosen.join(others, "id").filter(F.col("n_parent") > F.col("n_child"))
    hits = seen.groupBy("child", "parent", "n_child", "n_parent", "misses", "wanted").agg(F.count(F.lit(1)).alias("hits"))
    enough = F.least("wanted", "n_child") - F.col("misses")
    likely = cut(hits.filter(F.col("hits") >= enough).select("child", "parent", "n_child", "n_parent"))
    wanted = held.select("id", F.col("tag").alias("child")).join(likely.select("child", "parent"), "child")
    both = wanted.join(held.select("id", F.col("tag").alias("parent")), ["id", "parent"])
    counted = both.groupBy("child", "parent").agg(F.count(F.lit(1)).alias("n_both"))
    pct = F.col("n_both") / F.col("n_child")
    return likely.join(counted, ["child", "parent"]).filter(pct >= threshold).select(
        "child", "parent", "n_child", "n_parent", "n_both", F.round(pct, 4).alias("pct"))


def immediate_parents(pairs: DataFrame) -> DataFrame:
    """The smallest qualifying parent of every child, ties by name."""
    best = Window.partitionBy("child").orderBy("n_parent", "parent")
    return pairs.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def children(edges: DataFrame) -> DataFrame:
    """Sorted children of every parent."""
    return edges.groupBy("parent").agg(F.array_sort(F.collect_list("child")).alias("children"))


def closure(edges: DataFrame) -> DataFrame:
    """Every ancestor of every tag with its distance.

    A chain is at most as long as the edges because every parent is strictly larger than its
    child; a longer one is an error. The edges are one row per class, so the rounds stay small.
    """
    edges = cut(edges.select("child", "parent"))  # each round would derive the taxonomy again
    steps = edges.select("child", F.col("parent").alias("ancestor"))
    reached = steps.withColumn("depth", F.lit(1))
    up = F.broadcast(edges.select(F.col("child").alias("ancestor"), F.col("parent").alias("_next")))
    frontier, depth, longest = reached, 1, edges.count()
    while True:
        depth += 1
        frontier = frontier.join(up, "ancestor").select(
            "child", F.col("_next").alias("ancestor"), F.lit(depth).alias("depth")
        )
        frontier = cut(frontier)
        if frontier.isEmpty():
            return reached
        if depth > longest:
            raise ValueError("the hierarchy has a cycle")
        reached = reached.unionByName(frontier)


def training_labels(tags: DataFrame, classes: Sequence[str] | DataFrame, above: DataFrame) -> DataFrame:
    """(id, label, status) of every tagged record, from the ``closure`` of the class tags.

    ``labelled`` with exactly one most specific class tag, ``ambiguous`` with several,
    ``untagged`` with none. A tag is not specific when the record has one below it.
    """
    held = cut(tags.join(vocabulary(tags.sparkSession, classes), "tag", "left_semi").select("id", "tag").distinct())
    covered = held.join(above.select(F.col("child").alias("tag"), "ancestor"), "tag").select("id", F.col("ancestor").alias("tag"))
    leaves = held.join(covered, ["id", "tag"], "left_anti").groupBy("id").agg(
        F.count(F.lit(1)).alias("leaves"), F.min("tag").alias("leaf"))
    every = tags.select("id").distinct().join(leaves, "id", "left")
    return every.select(
        "id",
        F.when(F.col("leaves") == 1, F.col("leaf")).alias("label"),
        F.when(F.col("leaves") == 1, "labelled").when(F.col("leaves") > 1, "ambiguous").otherwise("untagged").alias("status"),
    )


def exclusive_tags(tags: DataFrame, parent: str, min_count: int = EXCLUSIVE_MIN_COUNT) -> DataFrame:
    """Tags that occur only on records that also have ``parent``, often enough.

    Whether a record has the parent is a set of ids taken from one tag's rows; every other
    row asks that set instead of the rows of its own record.
    """
    marked = tags.filter(F.col("tag") == parent).select("id").distinct().withColumn("_in", F.lit(1))
    others = tags.filter(F.col("tag") != parent)
    per_tag = others.join(marked, "id", "left").groupBy("tag").agg(
        F.count(F.lit(1)).alias("n"), F.count("_in").alias("n_in")
    )
    return per_tag.filter((F.col("n") == F.col("n_in")) & (F.col("n") >= min_count)).select("tag", "n")


def report(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """Indented tree lines in reading order: siblings by count, largest first."""
    sort_key = F.concat(F.lpad((F.lit(10**15) - F.col("n")).cast("string"), 16, "0"), F.lit(" "), F.col("tag"))
    edges, counts = cut(edges.select("child", "parent")), cut(counts)
    keyed = counts.withColumn("key", sort_key)
    parents = edges.select(F.col("child").alias("tag"), "parent")
    level = keyed.join(parents, "tag", "left_anti").select("tag", "n", F.col("key").alias("path"), F.lit(0).alias("depth"))
    tree, depth, longest = level, 0, edges.count()
    while True:
        depth += 1
        above = level.select(F.col("tag").alias("parent"), F.col("path").alias("_path"))
        level = keyed.join(F.broadcast(parents), "tag").join(F.broadcast(above), "parent").select(
            "tag", "n", F.concat("_path", F.lit("/"), "key").alias("path"), F.lit(depth).alias("depth")
        )
        level = cut(level)
        if level.isEmpty():
            break
        if depth > longest:
            raise ValueError("the hierarchy has a cycle")
        tree = tree.unionByName(level)
    line = F.concat(F.repeat(F.lit("  "), F.col("depth") + 1), "tag", F.lit(" ("), F.format_number("n", 0), F.lit(")"))
    return tree.select("path", "depth", "tag", line.alias("line"))
