"""Continuous scoring: new pairs are judged as their files arrive, each key once."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ranking import keep_last


def run_folder(sink: str, checkpoint: str) -> str:
    """The part of a sink that belongs to one checkpoint, so a new one overwrites nothing."""
    return f"{sink}/run={sha256(checkpoint.encode()).hexdigest()[:16]}"


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def score_stream(arrivals: DataFrame, score: Callable[[DataFrame], DataFrame], keys: list[str],
                 sink: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Judge each key when it first arrives.

    The keys met so far are the stream's own state, partitioned by key and kept in its checkpoint, so a
    batch costs what it brings and not what was done before.  ``score`` turns a batch of new keys
    into result rows.  A batch that is run again after a failure overwrites its own folder.
    """
    folder = run_folder(sink, checkpoint)

    def put(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    fresh = arrivals.dropDuplicates(keys)
    writer = fresh.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def results(spark, sink: str) -> DataFrame:
    """All results of a sink."""
    return spark.read.option("basePath", sink).parquet(sink).drop("run", "batch_id")


def compacted(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The last result of each key, for sinks that several checkpoints wrote to."""
    return keep_last(rows, keys, F.col(pos))
