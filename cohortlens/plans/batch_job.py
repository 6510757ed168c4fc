"""Numbered batches of records: taken in as they come, combined per patient, finished behind a gate.

A folder holds ``runs/run=<id>`` (checked lines of one call) and ``manifest`` (which batch came with which
run).  The manifest is written last, so rows of a call that died are never read, and a
batch counts once however often it is offered.  What a patient's record is follows from all committed
batches, not from the order in which they came: the first line of the lowest batch counts.

Results for odd input: a line that is not JSON, not an object, or without a patient is a reject and
never fails the job by itself; blank lines are nothing; a batch without lines leaves no mark; a batch offered by two calls at the
same time counts as the one with the smaller run id.  Patients without any record are ``missing``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.jsontext import strict_json
from ..session import broadcast_if_small

STAGED = "batch_no INT, line_pos BIGINT, patient_id STRING, record STRING, reason STRING, run STRING"
SEEN = "batch_no INT, run STRING"
PLACE = ["batch_no", "line_pos"]


def create(spark: SparkSession, folder: str) -> None:
    """An empty job folder."""
    spark.createDataFrame([], SEEN).write.parquet(f"{folder}/manifest")
    spark.createDataFrame([], STAGED).drop("run").write.parquet(f"{folder}/runs/run=none")


def _seen(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SEEN).parquet(f"{folder}/manifest").groupBy("batch_no").agg(
        F.min("run").alias("run"))


def checked(lines: DataFrame) -> DataFrame:
    """Lines with their patient, or with the reason why they are none of anybody's records."""
    v = F.col("v")
    patient = F.nullif(X.strip(F.try_variant_get(v, "$.patient_id", "string")), F.lit(""))
    rows = lines.withColumn("v", strict_json("value")).withColumn(
        "object", F.coalesce(X.is_object(v), F.lit(False)))
    return rows.select(
        *PLACE, F.when(F.col("object"), patient).alias("patient_id"), F.col("value").alias("record"),
        F.when(v.isNull(), "invalid JSON").when(~F.col("object"), "row is not an object")
        .when(patient.isNull(), "no patient id").alias("reason"))


def ingest(lines: DataFrame, folder: str) -> None:
    """Take in the batches (``batch_no``, ``line_pos``, ``value``) that no finished call has taken in before."""
    spark = lines.sparkSession
    fresh = lines.join(broadcast_if_small(_seen(spark, folder)), "batch_no", "left_anti")
    run = uuid.uuid4().hex
    own = f"{folder}/runs/run={run}"
    checked(fresh).write.parquet(own)
    (spark.read.schema(STAGED).parquet(own).select("batch_no").distinct()
     .select("batch_no", F.lit(run).alias("run")).write.mode("append").parquet(f"{folder}/manifest"))


def committed(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.schema(STAGED).parquet(f"{folder}/runs")
    return rows.join(broadcast_if_small(_seen(spark, folder)), ["batch_no", "run"], "left_semi").drop("run")


def combine(spark: SparkSession, folder: str, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(records, rejects)``: a row per expected patient, and every line that is nobody's record.

    Places are aggregated per patient before they meet the lines, so a patient with very many lines
    is no group that a task must hold.
    """
    rows = committed(spark, folder)
    read = rows.where("reason IS NULL")
    first = read.groupBy("patient_id").agg(
        F.min(F.struct(*PLACE)).alias("first"))
    known = expected.select("patient_id").distinct().join(first, "patient_id", "left")
    wanted = known.select(F.col("patient_id").alias("known"), "first")
    met = read.join(wanted, read["patient_id"] == wanted["known"], "left")
    judged = met.withColumn("reason", F.when(F.col("known").isNull(), "unknown patient").when(
        F.struct(*PLACE) != F.col("first"), "repeated patient"))
    kept = judged.where("reason IS NULL").select("patient_id", *PLACE, "record")
    records = known.select("patient_id").join(kept, "patient_id", "left").withColumn(
        "status", F.when(F.col("record").isNull(), "missing").otherwise("labelled"))
    # unreadable lines, which have no patient, meet nobody's place
    refused = rows.where("reason IS NOT NULL").unionByName(judged.drop("known", "first").where("reason IS NOT NULL"))
    return records, refused.select(*PLACE, "patient_id", "reason", "record")


def finalize(spark: SparkSession, folder: str, expected: DataFrame, out: str,
             fatal: tuple[str, ...] = ("missing", "unknown patient")) -> DataFrame:
    """Writes ``records``, ``rejects`` and ``summary`` below ``out``; the counts as a table.

    The result fails when it is read if a status or reason in ``fatal`` occurs: the tables are there by
    then, so what went wrong can be looked into.
    """
    records, rejects = combine(spark, folder, expected)
    records.write.parquet(f"{out}/records")
    rejects.write.parquet(f"{out}/rejects")
    counts = spark.read.schema(records.schema).parquet(f"{out}/records").select(
        F.col("status").alias("outcome")).unionByName(
        spark.read.schema(rejects.schema).parquet(f"{out}/rejects").select(F.col("reason").alias("outcome")))
    counts.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{out}/summary")
    summary = spark.read.schema("outcome STRING, n BIGINT").parquet(f"{out}/summary")
    bad = F.col("outcome").isin(list(fatal)) & (F.col("n") > 0)
    message = F.concat(F.lit("job is not complete: "), "outcome", F.lit(" "), F.col("n").cast("string"))
    return summary.where(F.assert_true(~bad, message).isNull())
