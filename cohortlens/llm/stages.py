"""Cutting lineage in the folder that all executors share, and what a known size allows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

#: rows of a few numbers that are broadcast at most (some megabytes)
BROADCAST_ROWS = 200_000
#: rows of a few numbers that make a partition worth its task
PART_ROWS = 250_000


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it as checkpoint files in ``spark.checkpoint.dir``.

    A lost executor then re-reads files.  Spark deletes them with the frame where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def parts_for(rows: int) -> int:
    return max(1, -(-rows // PART_ROWS))


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """A cut frame in as many partitions as its rows need at most, and how many rows it has."""
    df = cut(df)
    rows = df.count()
    return df.coalesce(parts_for(rows)), rows


def lookup(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join, broadcast if its counted rows are few; else both sides are shuffled."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
