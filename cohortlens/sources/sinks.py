"""File sinks.  Every sink writes in parallel; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import batches
from ..operators.rollup import eligibility_of_decision
from ..session import shuffled


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys and explicit nulls."""
    df.select(*sorted(df.columns)).write.option("ignoreNullFields", "false").json(path)


def write_report(header: DataFrame, body: DataFrame, path: str) -> None:
    """A report as a one-row header and a body table below one folder."""
    header.write.option("ignoreNullFields", "false").json(f"{path}/header")
    write_lines(body, f"{path}/patients")


def candidate_label_rows(candidates: DataFrame, decided: DataFrame) -> DataFrame:
    """Retrieved pairs with their baseline label, as the label file's columns."""
    base = decided.select("patient_id", "trial_id", "decision", "score")
    rows = candidates.join(shuffled(base), ["patient_id", "trial_id"], "left")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return rows.select(
        F.col("patient_id").alias("PATIENT_ID"), F.col("trial_id").alias("TRIAL_ID"),
        eligibility_of_decision(F.coalesce("decision", F.lit(""))).alias("ELIGIBILITY"),
        text(F.col("decision")).alias("INTERNAL_BASELINE_LABEL"),
        text(F.col("score")).alias("BASELINE_SCORE"),
        F.col("retrieval_rank").cast("string").alias("RANK"))


def review_label_rows(labels: DataFrame) -> DataFrame:
    """Final labels with their source and review flags, as the review file's columns."""
    bit = lambda c: F.when(F.col(c), "1").otherwise("0")
    return labels.select(
        F.col("patient_id").alias("PATIENT_ID"), F.col("trial_id").alias("TRIAL_ID"),
        F.col("decision").alias("LABEL"), F.col("source").alias("SOURCE"),
        bit("agrees").alias("AGREES"),
        bit("human_review_required").alias("HUMAN_REVIEW_REQUIRED"))


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated files with a header each; read the folder back with ``header``."""
    df.write.option("sep", "\t").option("header", True).csv(path)


def write_batches(df: DataFrame, pos: str, size: int, path: str) -> None:
    """Fixed-size numbered batches: rows in the order of their ``batch`` column, in files of normal
    size that hold many batches each."""
    (batches(df, pos, size).drop("row_no").repartitionByRange("batch").sortWithinPartitions("batch", pos)
     .write.json(path))


def write_fan_out(predictions: DataFrame, raw: DataFrame, audit: DataFrame, path: str) -> None:
    """Predictions, raw responses and audit rows of a run, side by side."""
    write_lines(predictions, f"{path}/predictions")
    write_lines(raw, f"{path}/raw")
    write_lines(audit, f"{path}/audit")
