"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that only matter for speed or for comparable timestamps. Shuffle
# width is left to the cluster; adaptive execution coalesces and splits it.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


# Beside them, for queries over the domain tables.
_DOMAIN = {
    # A task's share of a shuffle is bounded by the advisory size only if there are partitions enough to join.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    # What is dealt by a game already is not dealt again for a join by game and player.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # A generated method above 8000 bytes is never compiled by the JVM, only interpreted; such a stage runs faster in smaller methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings the operators rely on."""
    for key, value in _DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def configure_domain(spark: SparkSession) -> SparkSession:
    """``configure`` and the settings of the domain queries."""
    configure(spark)
    for key, value in _DOMAIN.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "tidemark") -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call-site capture per Column
    )
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``, on Spark's default file system if it names none.

    Only a single-machine session may go without one; it gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        place = spark._jvm.org.apache.hadoop.fs.Path(named.rstrip("/"))
        return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):  # executors of a local cluster are other processes
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_DIRS[context.applicationId]


_STAGED: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete what this process has staged; frames that still read it must not be used again."""
    while _STAGED:
        place = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Used where one result feeds several branches: the work is done once, survives
    the loss of executors, keeps column pruning, and gives the planner true sizes.
    The shuffles behind it are deleted at once, not when the driver collects garbage.
    """
    path = scratch_path(df.sparkSession, label)
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
