"""Run summaries: distributions, usage sums, latencies and parse rates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as X
from .ranking import lower_percentile


def distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts per value of several columns at once: ``(dimension, value, n)``.

    Grouping sets: one pass over the table for all columns.
    """
    named = [F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value"))
             for c in columns]
    return (df.select(F.explode(F.array(*named)).alias("x")).select("x.*")
            .groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n")))


def as_one_map(dist: DataFrame) -> DataFrame:
    """A distribution's counts as one map per dimension (label sets are small)."""
    return dist.groupBy("dimension").agg(F.map_from_entries(F.array_sort(
        F.collect_list(F.struct("value", "n")))).alias("counts"))


def run_summary(assessed: DataFrame, judgments: DataFrame, questions: DataFrame,
                answers: DataFrame) -> DataFrame:
    """One row per measure: totals and label distributions of a run."""
    def total(df, name):
        return df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("dimension"), F.lit("").alias("value"), "n")
    patients = assessed.agg(F.count_distinct("patient_id").alias("n")).select(
        F.lit("patient_count").alias("dimension"), F.lit("").alias("value"), "n")
    parts = [patients, total(assessed, "final_trial_judgment_count"),
             total(questions, "follow_up_question_count"),
             total(answers, "simulated_patient_answer_count"),
             distribution(assessed, ["eligibility"]), distribution(judgments, ["status"])]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def batch_summary(labels: DataFrame) -> DataFrame:
    """Counts of a batch of pair labels, overall and per eligibility.

    ``labels``: patient_id, eligibility, criterion_results, follow_up_questions.
    """
    asked = F.size("follow_up_questions")
    return labels.rollup("eligibility").agg(
        F.count(F.lit(1)).alias("recommendations"),
        F.sum(F.size("criterion_results")).cast("bigint").alias("criterion_results"),
        F.sum(asked).cast("bigint").alias("questions"),
        F.count_distinct("patient_id").alias("patients"),
        F.count_distinct(F.when(asked > 0, F.col("patient_id"))).alias("patients_asked"))


def usage_of(raw: Column | str) -> Column:
    """Token usage of a provider payload (VARIANT) under one set of names.

    Aliases are resolved, negative and non-integer values are dropped, and a missing total is
    the sum of its parts.
    """
    return X.let(X.col(raw), _usage)


def _usage(v: Column) -> Column:
    def whole(*paths):
        # the first present alias is the value, also when it is then refused
        found = F.coalesce(*[F.try_variant_get(v, p, "variant") for p in paths])
        return X.let(found, lambda x: F.when(
            F.schema_of_variant(x).isin("BIGINT", "INT", "SMALLINT", "TINYINT")
            & (F.try_variant_get(x, "$", "bigint") >= 0), F.try_variant_get(x, "$", "bigint")))
    parts = F.struct(
        whole("$.prompt_tokens", "$.input_tokens").alias("prompt"),
        whole("$.completion_tokens", "$.output_tokens").alias("completion"),
        whole("$.total_tokens").alias("total"),
        whole("$.prompt_tokens_details.cached_tokens").alias("cached"),
        whole("$.completion_tokens_details.reasoning_tokens").alias("reasoning"))

    def named(p):
        entries = [("prompt_tokens", p["prompt"]), ("completion_tokens", p["completion"]),
                   ("total_tokens", F.coalesce(p["total"], p["prompt"] + p["completion"])),
                   ("cached_tokens", p["cached"]), ("reasoning_tokens", p["reasoning"])]
        full = F.create_map(*[x for k, c in entries for x in (F.lit(k), c)])
        return F.map_filter(full, lambda k, n: n.isNotNull())
    return X.let(parts, named)


def usage_rollup(calls: DataFrame, by: Sequence[str] = ("agent",)) -> DataFrame:
    """Token sums per agent and over all agents (NULL agent) in one rollup.

    ``calls``: agent, token_usage MAP<STRING,BIGINT>.
    """
    flat = calls.select(*by, F.explode("token_usage").alias("counter", "tokens")).filter(
        "tokens >= 0")
    agg = flat.groupingSets([[*by, "counter"], ["counter"]], *by, "counter")
    return agg.agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("calls"))


def merged_calls(calls: DataFrame) -> DataFrame:
    """A patient's calls as one row: all ok, joined statuses, summed time, first errors.

    A patient's run has a fixed small number of calls.
    """
    good = F.coalesce("ok", F.lit(False)) & F.coalesce("json_ok", F.lit(False))
    agg = calls.groupBy("patient_id").agg(
        F.bool_and(good).alias("ok"),
        F.array_sort(F.collect_list(F.struct(
            "call_pos", X.text_or_empty("http_status").alias("s")))).alias("_s"),
        F.array_sort(F.collect_list(F.when(~good, F.struct(
            "call_pos", F.concat("agent", F.lit(": "), X.text_or_empty("error")).alias("e")))))
        .alias("_e"),
        F.sum(F.coalesce("ms", F.lit(0))).alias("ms"), F.count(F.lit(1)).alias("calls"))
    statuses = F.array_join(F.transform("_s", lambda x: x["s"]), ",")
    return agg.select(
        "patient_id", "ok", F.when(F.col("ok"), F.lit("200")).otherwise(statuses)
        .alias("http_status"), "ms",
        F.array_join(F.transform("_e", lambda x: x["e"]), "; ").alias("error"), "calls")


def call_report(calls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Call totals, failures and the JSON-parse rate (an empty run counts as 1.0)."""
    grouped = calls.groupBy(*by)
    out = grouped.agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed_calls"),
        F.count_if(F.coalesce("json_ok", F.lit(False))).alias("parsed"),
        F.array_sort(F.collect_set(F.nullif("retry_after", F.lit("")))).alias("retry_values"))
    return out.withColumn("json_parse_rate", X.safe_ratio("parsed", "calls", empty=1.0, places=3))


def label_report(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Valid, agreeing and fallback label rates.  ``labels``: decision, agrees, fallback."""
    valid = F.col("decision").isin(K.DECISIONS)
    out = labels.groupBy(*by).agg(
        F.count(F.lit(1)).alias("labels"), F.count_if(valid).alias("valid"),
        F.count_if(valid & F.col("agrees")).alias("agreed"),
        F.count_if("fallback").alias("fallbacks"))
    return (out.withColumn("valid_rate", X.safe_ratio("valid", "labels", empty=1.0, places=3))
            .withColumn("agreement_rate", X.safe_ratio("agreed", "valid", empty=1.0, places=3))
            .withColumn("fallback_rate", X.safe_ratio("fallbacks", "labels", empty=1.0,
                                                      places=3)))


def latency_percentiles(calls: DataFrame, by: Sequence[str] = (), points=(0.5, 0.95),
                        value: str = "ms") -> DataFrame:
    return lower_percentile(calls, list(by), value, points)


def canonical_row(df: DataFrame) -> Column:
    """A row as text, the same in any engine: columns by name, numbers with six places, times in
    microseconds, null as a mark."""
    def text(name):
        kind = df.schema[name].dataType.typeName()
        c = df[name]
        if kind in ("double", "float", "decimal"):
            c = c.cast("decimal(38,6)")
        elif kind.startswith("timestamp"):
            c = F.unix_micros(c.cast("timestamp"))
        elif kind in ("array", "map", "struct"):
            c = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
        return F.coalesce(c.cast("string"), F.lit("null"))
    return F.concat_ws("|", *[text(c) for c in sorted(df.columns)])


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free content hash of a table, as one row.

    Sums of two 32-bit pieces of each row's digest: equal rows do not cancel.
    """
    digest = df.select(F.sha2(canonical_row(df), 256).alias("h"))
    piece = lambda at: F.coalesce(F.sum(F.conv(
        F.substring("h", at, 8), 16, 10).cast("bigint")), F.lit(0))
    return digest.agg(F.count(F.lit(1)).alias("rows"), piece(1).alias("sum_high"),
                      piece(9).alias("sum_low"))


def run_times(started: datetime) -> dict[str, str]:
    """When a run started (UTC) and how many seconds have gone by, as settings of a manifest."""
    started = started.astimezone(timezone.utc)
    elapsed = datetime.now(timezone.utc) - started
    return {"started_at": started.isoformat(timespec="seconds"),
            "elapsed_seconds": f"{elapsed.total_seconds():.3f}"}


def manifest(tables: dict[str, DataFrame], settings: dict[str, str]) -> DataFrame:
    """One row per table (rows and fingerprint) and per setting of a run."""
    out = None
    for name, df in tables.items():
        part = fingerprint(df).select(
            F.lit("table").alias("kind"), F.lit(name).alias("name"),
            F.concat_ws(":", "rows", "sum_high", "sum_low").alias("value"))
        out = part if out is None else out.unionByName(part)
    spark = next(iter(tables.values())).sparkSession
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("value"))
                      for k, v in sorted(settings.items())])
    if settings:
        rows = spark.range(1).select(F.explode(pairs).alias("s")).select(
            F.lit("setting").alias("kind"), "s.name", "s.value")
        out = out.unionByName(rows)
    return out
