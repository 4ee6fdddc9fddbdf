"""Session helper for tests, the bench and interactive use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A small single-JVM session. On a cluster, use the session the cluster provides."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("reelscribe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; one of our own, set once, only where it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))


def stage_table(df: DataFrame) -> DataFrame:
    """Write an intermediate table once (reliable checkpoint), for results that several later steps read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def scratch_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A new folder beside the staged tables, gone afterwards; stage what is to outlive it."""
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def read_folders(spark: SparkSession, path: str, kind: str = "parquet", **options: str) -> DataFrame:
    """A table of very many partition folders. Spark lists them when the table is named, one task for each folder up to 10,000, which costs far
    more than the listing; here some 32 tasks for each core share it. The session's own setting is put back."""
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(before), 32 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.format(kind).options(**options).load(path)
    finally:
        spark.conf.set(_LISTING, before)
