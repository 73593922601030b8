"""Session helpers: defaults for local runs, checkpoint folder, spreading of rows."""

from __future__ import annotations

import os
import tempfile
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # a union of equally partitioned sides is taken as partitioned, which adaptive reads undo: a grouping behind it may see a key twice
    "spark.sql.unionOutputPartitioning": "false",
}


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("scriptorium")
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions), **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it.

    A machine-local folder is used only when the session runs in local mode and
    names none; on a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_dir()


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="scriptorium-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage, so a lost executor costs nothing."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(os.path.join(shared_dir(spark), "rdd"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys, as a file may be one row group, which one task reads whatever its size.

    In local mode to all cores; on a cluster to as many tasks as the rows that are moved need.
    """
    context = df.sparkSession.sparkContext
    return df.repartition(context.defaultParallelism, *keys) if context.master.startswith("local[") else df.repartition(*keys)


def balanced(df: DataFrame, *keys: str) -> DataFrame:
    """Keep small but costly rows on every core; sizes alone would merge them."""
    spark = df.sparkSession
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # hashed keys: an equal partitioning would be folded into the shuffle before
    return df.repartition(wanted, F.xxhash64(*keys))
