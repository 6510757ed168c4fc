"""Session settings and the few places that touch the cluster's shared storage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows of a side that is broadcast, at most; prepared records take one or two KB each
BROADCAST_ROWS = 20_000


def build_session(name: str = "cohortlens", **conf: str) -> SparkSession:
    """A session with the settings the operators assume.  Existing settings win."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # no call-site capture per column expression: plans here are built from many
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Only where the setting is absent and the master is local (one machine) is a folder made and
    set; executors of a cluster would not see it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="cohortlens-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table to shared storage and read it back.

    Cuts the lineage, so the work is done once and a lost executor re-reads files instead
    of re-running the jobs before it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Share rows out before heavy per-row work when a scan has fewer parts than cores.

    A table with fewer parts than cores is small (or one file that cannot be split), so the
    extra exchange is bounded; larger tables are left as they are.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def shuffled(df: DataFrame) -> DataFrame:
    """A side that is never broadcast: the join shuffles both sides on its keys and sorts them, and
    adaptive execution splits hot partitions.

    For sides that grow with the tables.  Their estimated size says little: it is made from the bytes of
    compressed files, and counts a VARIANT as 2 KB and an array as one item, so that a side of
    millions of rows may pass for a few MB and fill the driver.
    """
    return df.hint("merge")


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS, *,
                       counted: DataFrame | None = None) -> DataFrame:
    """Broadcast a side of at most ``limit`` rows; a larger one is :func:`shuffled`.

    Rows are counted, not estimated.  ``counted`` is a table that has as many rows, or more, and takes
    less to be counted, like the table of files that the side is derived from.
    """
    few = (df if counted is None else counted).select(F.lit(1)).limit(limit + 1).count() <= limit
    return F.broadcast(df) if few else shuffled(df)
