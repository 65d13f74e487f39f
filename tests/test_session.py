import time
from pathlib import Path

from pyspark.sql import functions as F

from orrery.session import cut, shuffles_freed, stored

FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for folder in folders for f in Path(folder).rglob("shuffle_*.data")}


def settled(spark, before):
    for _ in range(50):  # files go shortly after the action
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    return shuffle_files(spark) - before


def test_what_is_kept_elsewhere_leaves_no_shuffle_files(spark):
    frame = spark.range(10000, numPartitions=3).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    frame = frame.groupBy((F.col("k") % 2).alias("odd")).agg(F.sum("s").alias("s"))
    before, was = shuffle_files(spark), spark.conf.get(FREED, "false")
    parts = cut(frame), stored(frame, "freed")
    with shuffles_freed(spark):
        rows = frame.select("*").collect()
    assert not settled(spark, before)
    assert sorted(rows) == sorted(parts[0].collect()) == sorted(parts[1].collect()) == sorted(frame.collect())
    assert sum(r.s for r in rows) == 10000 * 9999 // 2 and spark.conf.get(FREED, "false") == was
