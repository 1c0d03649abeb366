"""Cutting long plans, and size checks before a broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

STAGED = "staged-"
# rows of a narrow table that every executor can hold
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    Where none is set, one below the user's home on the default file system is
    made; only a session in a single process, whose default is the local disk,
    takes a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.startswith("local") and not context.master.startswith("local-"):
            folder = tempfile.mkdtemp(prefix="convoca-")
        if folder is None:
            files = _file_system(spark)
            if files.getUri().getScheme() == "file":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = f"{files.getHomeDirectory()}/.convoca-staging"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def _file_system(spark: SparkSession):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration())


def clear_staged(spark: SparkSession) -> None:
    """Remove what ``stage`` has written in this session. Tables read from it are gone with it."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in files.listStatus(path) if files.exists(path) else []:
            if status.getPath().getName().startswith(STAGED):
                files.delete(status.getPath(), True)


def staged_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which ``clear_staged`` removes."""
    return f"{shared_dir(spark)}/{STAGED}{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written here leaves no shuffle files behind: nothing reads them again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the files.

    Everything before is done once however often the result is used, a lost
    executor costs no recomputation, and the file sizes give the planner real
    statistics. The shuffle files of what came before are removed, and
    ``clear_staged`` removes the files.
    """
    path = staged_folder(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_counted(df: DataFrame, name: str) -> DataFrame:
    """``stage``, with the number of rows, counted while they are written, in ``staged_rows``."""
    path, seen = staged_folder(df.sparkSession, name), Observation()
    with shuffles_removed(df.sparkSession):
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.staged_rows = seen.get["rows"]
    return staged


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, at_most: int | None = None) -> DataFrame:
    """``df`` marked for broadcast when it is counted to be small, else unchanged.

    The count stops after ``rows + 1`` rows, and is left out where ``df`` is known to have ``at_most``
    as many. Beyond the limit the join shuffles.
    """
    if at_most is not None and at_most <= rows:
        return F.broadcast(df)
    if df.select(F.lit(1)).limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    return df


def full_width(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hash-partitioned on ``keys`` over twice the shuffle partitions.

    For steps that multiply their rows: adaptive execution sizes partitions by
    the bytes coming in and would merge them into a few tasks.
    """
    width = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width, *keys)
