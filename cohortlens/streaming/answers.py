"""Answers that arrive over time change what is known about a patient."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.questions import answer_facts
from ..operators.ranking import keep_last
from .scores import run_folder


def stated_facts(answers: DataFrame, pos: Column) -> DataFrame:
    """The latest stated facts per patient: one keyed aggregation, batch or stream."""
    return answer_facts(answers, pos)


def answer_stream(answers: DataFrame, pos: Column, sink: str, checkpoint: str, *,
                  available_now: bool = True) -> StreamingQuery:
    """Keep the facts of changed patients up to date in ``sink``.

    Update mode emits a patient whenever an answer changes its facts; each batch's changes
    are written with the batch number and the time, and :func:`current_facts` reads the newest.  A
    batch run again overwrites its own folder; another checkpoint writes to folders of its own.
    """
    folder = run_folder(sink, checkpoint)

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("written_at", F.current_timestamp()).write.mode("overwrite").parquet(
            f"{folder}/batch_id={batch_id}")

    writer = (stated_facts(answers, pos).writeStream.outputMode("update").foreachBatch(put)
              .option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_facts(spark, sink: str) -> DataFrame:
    """Newest facts per patient from the sink's batches."""
    rows = spark.read.option("basePath", sink).parquet(sink)
    last = keep_last(rows, ["patient_id"], F.struct("written_at", "batch_id"))
    return last.drop("run", "batch_id", "written_at")
