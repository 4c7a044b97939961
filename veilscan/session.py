"""Session defaults shared by the tests, the benchmark and interactive use."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Below this many bytes per core an input is one or two file splits wide, so the regular
# expressions would run on one core. Larger inputs already have enough splits.
SMALL_BYTES_PER_CORE = 32 * 1024 * 1024


def local_session(cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session. On a cluster, use the session the platform hands you."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("veilscan")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("VEILSCAN_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread_small(df: DataFrame) -> DataFrame:
    """Spread an input that is too small to fill the cores; leave every other input alone.

    A single small Parquet row group is one task however many cores there are. The extra
    exchange therefore only ever moves less than ``SMALL_BYTES_PER_CORE`` per core; at scale
    the scan's own splits are used and text is never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if plan_bytes(df) < cores * SMALL_BYTES_PER_CORE:
        return df.repartition(cores)
    return df


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="veilscan-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return _local_dir()


def settle(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    For frames that are expensive and have several consumers. A written table survives lost
    executors and is read with column pruning. Never settle raw values.
    """
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
