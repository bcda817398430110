"""Intermediate tables in the folder that driver and executors share.

A written table ends its lineage: what made it isn't done again when an executor
is lost. Tables of a session are deleted when its driver ends, or earlier by
``release`` or at the end of a ``scope``.
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Drops an execution's shuffle files when it ends; a table that has been written needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scope = contextvars.ContextVar("partloom_scope", default="")
_announced: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, a local one, on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="partloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def home(spark: SparkSession) -> str:
    """The session's folder in the shared one; it goes when the driver ends."""
    name = f"{shared_dir(spark)}/partloom-{spark.sparkContext.applicationId}"
    if name not in _announced:
        path, fs = _path(spark, name)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _announced.add(name)
    return name


@contextlib.contextmanager
def _cleaned(spark: SparkSession):
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df in as many partitions as a shuffle has, for rows that the next step multiplies: by their bytes alone few tasks would take them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def merged(df: DataFrame) -> DataFrame:
    """df as a side of joins that sort both sides, never broadcast.

    The optimizer sizes a table by the bytes of its files, before an explode and
    as compressed, so rows of generated or regular data look like a small part of
    what a broadcast would bring to the driver.
    """
    return df.hint("merge")


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """df as a Parquet table in the session's folder, read back."""
    spark = df.sparkSession
    path = f"{home(spark)}{_scope.get()}/{label}-{uuid.uuid4().hex[:12]}"
    with _cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Tables written inside are deleted at the end; what is read afterwards must have been ``kept``."""
    outer = _scope.get()
    mark = _scope.set(f"{outer}/scope-{uuid.uuid4().hex[:12]}")
    inner = _scope.get()
    try:
        yield outer
    finally:
        _scope.reset(mark)
        path, fs = _path(spark, f"{home(spark)}{inner}")
        fs.delete(path, True)


def kept(df: DataFrame, label: str, outer: str) -> DataFrame:
    """df written outside the present scope, in the one that ``scope`` gave."""
    mark = _scope.set(outer)
    try:
        return written(df, label)
    finally:
        _scope.reset(mark)


def release(spark: SparkSession) -> None:
    """Delete every table of this session."""
    path, fs = _path(spark, home(spark))
    fs.delete(path, True)
