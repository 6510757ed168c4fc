"""File sources, always with an explicit schema."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas as S
from ..functions import exprs as X
from ..functions.jsontext import strict_json
from ..operators.normalize import normalize_patients, normalize_trials
from ..operators.ranking import keep_last
from ..operators.registry import normalize_studies, select_studies


def with_file_order(df: DataFrame, pos: str, *first: str) -> DataFrame:
    """Numbers rows in input order: by the columns ``first`` (say, a file's number), then by file
    path, block of the file and place in the block.

    Blocks are numbered first, one row each; rows keep their place behind their block's number.
    """
    at = df.withColumns({"_file": F.col("_metadata.file_path"),
                         "_start": F.col("_metadata.file_block_start")}).withColumn(
        "_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    blocks = at.select(*first, "_file", "_start").distinct()
    nth = F.row_number().over(W.orderBy(*first, "_file", "_start")) - 1
    blocks = blocks.select("_file", "_start", nth.cast("bigint").alias("_nth"))
    return at.join(blocks, ["_file", "_start"]).withColumn(
        pos, F.shiftleft("_nth", 33) + F.col("_row")).drop("_file", "_start", "_row", "_nth")


def read_array(spark: SparkSession, path: str, schema: str, pos: str = "pos") -> DataFrame:
    """A JSON file that is one array of records, with their order.

    Such a file is read by one task; JSON lines (:func:`read_lines`) are read by many.
    """
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return with_file_order(df, pos)


def read_lines(spark: SparkSession, path: str, schema: str, pos: str = "pos") -> DataFrame:
    """JSON lines; blank lines are skipped, unreadable ones kept in ``_corrupt_record``."""
    df = (spark.read.schema(schema + ", _corrupt_record STRING").option("mode", "PERMISSIVE")
          .json(path))
    return with_file_order(df, pos)


def read_wrapped(spark: SparkSession, path: str, schema: str, pos: str = "pos",
                 key: str = "records") -> DataFrame:
    """An object ``{"records": [...]}``."""
    df = spark.read.schema(f"{key} ARRAY<STRUCT<{_ddl_fields(schema)}>>").option(
        "multiLine", True).json(path)
    return df.select(F.posexplode(key).alias(pos, "r")).select(pos, "r.*")


def _ddl_fields(schema: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}"
                     for f in StructType.fromDDL(schema).fields)


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """A topic file: id is num, else id, else the 1-based position; the title is the note."""
    df = spark.read.schema(S.TOPICS).option("multiLine", True).json(path)
    t = df.select(F.posexplode("topics").alias("patient_pos", "t")).filter("t IS NOT NULL")
    return t.select(
        "patient_pos",
        F.coalesce(F.nullif("t.num", F.lit("")), F.nullif("t.id", F.lit("")),
                   (F.col("patient_pos") + 1).cast("string")).alias("patient_id"),
        X.text_or_empty("t.title").alias("clinical_note"),
        F.to_json("t").alias("source_topic"))


def patients_from_topics(topics: DataFrame) -> DataFrame:
    raw = topics.select("patient_pos", "patient_id", "clinical_note")
    for name in ("age", "sex", "diagnosis", "stage", "ecog"):
        raw = raw.withColumn(name, F.lit(None).cast("string"))
    raw = (raw.withColumn("biomarkers", F.lit(None).cast("map<string,string>"))
           .withColumn("prior_treatments", F.lit(None).cast("array<string>"))
           .withColumn("flags", F.lit(None).cast("map<string,string>"))
           .withColumn("location", F.lit(None).cast("map<string,string>")))
    return normalize_patients(raw)


def _read_any(spark, path, schema, pos):
    return (read_lines if path.endswith(".jsonl") else read_array)(spark, path, schema, pos)


def read_patients(spark: SparkSession, path: str) -> DataFrame:
    """Patient records of a JSON array or JSON-lines file."""
    return normalize_patients(_read_any(spark, path, S.RAW_PATIENTS, "patient_pos"))


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Trial records of a JSON array or JSON-lines file."""
    return normalize_trials(_read_any(spark, path, S.RAW_TRIALS, "trial_pos"))


def read_study_pages(spark: SparkSession, path: str, conditions: list[str], limit: int,
                     *, pages: DataFrame | None = None) -> DataFrame:
    """Landed registry pages (``<condition slug>-<n>.json``) to the trial table."""
    if pages is None:
        raw = spark.read.schema(S.STUDY_PAGES).option("multiLine", True).json(path)
        name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)-(\d+)\.json$", 1)
        number = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)-(\d+)\.json$", 2)
        pages = raw.select(name.alias("condition"), number.cast("int").alias("page_no"),
                           "studies")
    names = [re.sub("[^a-z0-9]+", "-", c.lower()).strip("-") or "query" for c in conditions]
    taken = select_studies(pages, names, limit)
    pos = F.col("condition_no").cast("bigint") * (1 << 40) + F.col("page_no") * (1 << 20) + F.col(
        "pos")
    return normalize_studies(taken.withColumn("trial_pos", pos))


def read_batches(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Numbered batch files (``…_batch_<n>.jsonl``) or folders (``batch=<n>``) with their number and
    line order."""
    return _numbered(spark.read.schema(schema).json(pattern))


def read_batch_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """The lines of numbered batches as texts (``value``), blank ones left out."""
    return _numbered(spark.read.text(pattern).where(X.strip("value") != ""))


def _numbered(df: DataFrame) -> DataFrame:
    name = lambda i: F.nullif(F.regexp_extract(
        F.col("_metadata.file_path"), r"(?:batch=(\d+)/[^/]+|(\d+)\.jsonl?)$", i), F.lit(""))
    n = F.coalesce(name(1), name(2)).cast("int")
    return with_file_order(df.withColumn("batch_no", n), "line_pos", "batch_no")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Answers, one array per patient; the last array of a patient counts."""
    rows = keep_last(read_lines(spark, path, S.ANSWERS, "_pos"), ["patient_id"], "_pos")
    return rows.select("patient_id", F.posexplode("simulated_patient_answers")
                       .alias("ans_pos", "a")).select("patient_id", "ans_pos", "a.*")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Blinded records: note and candidate trials per patient."""
    return read_lines(spark, path, S.RECORDS, "patient_pos")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Captured model answers in several encodings and envelopes: ``(path, text)``."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.select("path", unwrap_response(decode_bytes("content")).alias("text"))


def decode_bytes(c):
    """UTF-16 when marked so, else UTF-8 without its mark."""
    b = F.col(c)
    start = F.hex(F.substring(b, 1, 2))
    wide = start.isin("FFFE", "FEFF")
    return F.when(wide, F.decode(b, "UTF-16")).otherwise(
        F.regexp_replace(F.decode(b, "UTF-8"), "^﻿", ""))


def unwrap_response(text):
    """Text of a captured answer, inside or without a JSON envelope."""
    v = strict_json(text)
    keys = ("$.answerText", "$.answer", "$.content", "$.text", "$.answerArtifact.text",
            "$.answerArtifact.markdown")
    found = [F.when(F.schema_of_variant(F.try_variant_get(v, k, "variant")) == "STRING",
                    F.when(X.strip(F.try_variant_get(v, k, "string")) != "",
                           F.try_variant_get(v, k, "string"))) for k in keys]
    return F.coalesce(*found, text)
