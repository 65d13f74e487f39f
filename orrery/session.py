"""Session builder and the shared folder that checkpoints and stage tables live in."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

PART_ROWS = 1 << 15


def build_session(app: str = "orrery", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; any of them can be overridden."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        # call sites of every Column would cost more than planning the queries
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine: on a cluster the
    executors would not see it, so the missing setting is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    context.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, stem: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Actions of frames made inside remove their shuffle files when they end, not when the driver next collects garbage.

    For results that are kept elsewhere (a checkpoint, a table, rows): nothing reads those files again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, stem: str) -> DataFrame:
    """``df`` as a table in the shared folder: read again by columns, not computed again."""
    path = fresh_path(df.sparkSession, stem)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there with a short lineage."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    with shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def parts_of(rows: int, part_rows: int = PART_ROWS) -> int:
    return max(1, -(-rows // part_rows))


def fitted(df: DataFrame, rows: int, part_rows: int = PART_ROWS) -> DataFrame:
    """``df``, which has about as many rows, in as many parts as they need, if that is fewer than a shuffle makes."""
    parts = parts_of(rows, part_rows)
    return df.coalesce(parts) if parts < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def cut_to_size(df: DataFrame, part_rows: int = PART_ROWS) -> tuple[DataFrame, int]:
    """``cut`` for narrow rows, and their number, which is counted on the way.

    What comes back has parts of ``part_rows`` rows or so, where the shuffle before had more parts than that: each
    of them would be a task in every later step, with shuffle files of its own and an entry in the driver's memory.
    """
    seen = Observation()
    held = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    rows = seen.get["n"]
    return fitted(held, rows, part_rows), rows
