from pyspark.sql import functions as F

from orrery.operators.graphs import connected_components
from orrery.operators.spanning import clusters_by_level, reachability, spanning_forest
from orrery.session import cut, cut_to_size


def tasks_of(spark, name, made):
    """What ``made`` gives, and how many tasks it took."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        result = made()
        tracker = spark.sparkContext.statusTracker()
        stages = {s for job in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(job).stageIds}
        return result, sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info)
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def in_many_parts(spark):
    """A setting that leaves every shuffle in 64 parts, as large tables have them."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in held}
    for key, value in held.items():
        spark.conf.set(key, value)
    return before


def test_a_cut_frame_has_as_many_parts_as_its_rows_need(spark):
    before = in_many_parts(spark)
    try:
        counted = spark.range(10000).groupBy((F.col("id") % 1000).alias("k")).count()
        small, rows = cut_to_size(counted)
        assert rows == 1000 and small.rdd.getNumPartitions() == 1 < cut(counted).rdd.getNumPartitions()
        some, rows = cut_to_size(counted, 300)
        assert rows == 1000 and some.rdd.getNumPartitions() == 4
        assert sorted(some.collect()) == sorted(small.collect()) == sorted(counted.collect())
        none = spark.range(100).filter("id * id < 0").groupBy("id").count()  # found to be empty while it runs
        frames = (counted.filter("k < 0"), counted.limit(0), spark.range(0).selectExpr("id AS k"),
                  counted.join(none.select(F.col("id").alias("k")), "k"), counted.join(F.broadcast(none), F.col("k") == F.col("id")))
        for nothing in frames:
            empty, rows = cut_to_size(nothing)
            assert rows == 0 and empty.count() == 0
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_components_of_few_edges_take_few_tasks(spark):
    before = in_many_parts(spark)
    try:
        edges = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + F.when(F.col("id") % 100 < 99, 1).otherwise(0)).alias("b"))
        found, tasks = tasks_of(spark, "components", lambda: connected_components(spark.range(3001), edges).collect())
        assert {r.id: r.component for r in found} == {i: i if i == 3000 else i // 100 * 100 for i in range(3001)}
        assert tasks < 1000  # 5559 when every shuffle of every round was 64 tasks
        weighted = edges.withColumn("weight", (F.col("a") % 7).cast("double"))
        forest, tasks = tasks_of(spark, "forest", lambda: spanning_forest(weighted).collect())
        assert {(r.a, r.b) for r in forest} == {(i, i + 1) for i in range(3000) if i % 100 < 99} and len(forest) == 2970
        assert tasks < 3000  # 2125 now
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def jobs_of(spark, name, made):
    """What ``made`` gives, and how many jobs it took: each leaves plans, stages and metrics in the driver's memory."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        return made(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_what_fits_in_one_part_is_settled_in_few_jobs(spark):
    edges = spark.range(3000).select(F.col("id").alias("a"), F.xxhash64("id").bitwiseAND(F.lit(1023)).alias("b"),
                                     (F.xxhash64("id", F.lit(1)).bitwiseAND(F.lit(7)) / 2).alias("weight"))
    nodes = spark.range(3001)
    found, jobs = jobs_of(spark, "few components", lambda: connected_components(nodes, edges).collect())
    in_rounds = connected_components(nodes, edges, part_rows=40).collect()
    assert sorted(found) == sorted(in_rounds) and jobs < 15, jobs
    found, jobs = jobs_of(spark, "few trees", lambda: spanning_forest(edges).collect())
    in_rounds = spanning_forest(edges, part_rows=40).collect()
    assert sorted(found) == sorted(in_rounds) == sorted(spanning_forest(edges, part_rows=0).collect()) and jobs < 15, jobs


def test_clusters_at_three_densities_take_few_jobs(spark):
    table = cut(spark.range(2000).select(F.col("id"), F.explode(F.array(*[F.lit(i) for i in range(1, 5)])).alias("rank")).select(
        "id", ((F.col("id") * 7 + F.col("rank") * F.col("rank")) % 2000).alias("neighbour"), "rank", F.col("rank").cast("double").alias("distance")))

    def made():
        forest = spanning_forest(reachability(table, 3))
        return clusters_by_level(table.select("id").distinct(), forest, [1.0, 2.0, 3.5], 2).collect()

    found, jobs = jobs_of(spark, "three densities", made)
    assert len(found) == 6000 and jobs < 100, jobs
