"""Retrieval, judging and ranking put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.notes import render_note
from ..operators import matching as M
from ..operators import ranking as R
from ..operators import retrieval as T
from ..operators import rollup as U
from ..operators.evaluation import expected_pairs, recall_at_k
from ..operators.normalize import sparse_profile
from ..operators.questions import report_questions, with_questions
from ..session import shuffled


def with_notes(patients: DataFrame) -> DataFrame:
    return patients.withColumn("note", render_note("patient_pos"))


def recommend(patients: DataFrame, trials: DataFrame, *, pairs: DataFrame | None = None,
              k: int = 30, n: int = 3, limit: int | None = None) -> DataFrame:
    """Top ``n`` trials per patient with evidence and questions.

    Judges the given ``pairs``, else the ``k`` trials retrieved for each patient's note; no
    table of all patients times all trials is made.
    """
    if limit is not None:
        patients = R.head_rows(patients, "patient_pos", limit)
    if pairs is None:
        pairs = T.candidates(with_notes(patients), trials, k).select("patient_id", "trial_id")
    ranked = R.recommend_top(M.decide(M.judge_pairs(pairs, patients, trials, detail=False)), n)
    winners = M.judge_pairs(ranked.select("patient_id", "trial_id", "rank"), patients, trials)
    return with_questions(M.decide(winners))


def report(patients: DataFrame, trials: DataFrame, *, k: int = 10) -> DataFrame:
    """Report rows of the retrieved pairs, ranked per patient."""
    found = T.candidates(with_notes(patients), trials, k).select(
        "patient_id", "trial_id", "retrieval_score",
        F.col("retrieval_rank").cast("bigint").alias("retrieval_pos"))
    decided = M.decide(M.judge_pairs(found, patients, trials))
    rows = U.report_recommendations(decided, trials)
    rows = rows.withColumn("questions", report_questions("evidence", "criterion_results"))
    return R.rank_report(rows)


def nest_report(reported: DataFrame, patients: DataFrame) -> DataFrame:
    """One report per patient; at most ``k`` recommendations each, as retrieved."""
    item = F.struct("rank", "trial_id", "trial_title", "trial_source_url", "eligibility",
                    F.col("decision").alias("internal_decision"), "recommendation_score",
                    "retrieval_score", "criterion_results",
                    F.col("questions").alias("follow_up_questions"), "explanation", "patient_id")
    nested = reported.groupBy("patient_id").agg(F.array_sort(F.collect_list(item))
                                                .alias("recommendations"))
    base = sparse_profile(with_notes(patients)).select(
        "patient_id", F.col("note").alias("clinical_note"),
        F.col("profile").alias("extracted_profile"))
    return base.join(nested, "patient_id").withColumn(
        "recommended_trial_order", F.transform("recommendations", lambda r: r["trial_id"]))


def report_header(trials: DataFrame, patients: DataFrame) -> DataFrame:
    """The report's one-row header."""
    t = trials.agg(F.count(F.lit(1))).scalar()
    return patients.agg(F.count(F.lit(1)).alias("patient_count")).select(
        F.lit("report-v1").alias("schema_version"),
        F.array(*[F.lit(x) for x in K.ELIGIBILITY]).alias("eligibility_labels"),
        F.array(*[F.lit(x) for x in K.CRITERION_STATUS]).alias("criterion_labels"),
        F.lit(K.DISCLAIMER).alias("disclaimer"), t.alias("trial_count"), "patient_count")


def candidate_job(patients: DataFrame, trials: DataFrame, judged_pairs: DataFrame, *,
                  k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Retrieved candidates with baseline labels, and recall counters.

    ``judged_pairs`` are the decided pairs the expectation is taken from.
    """
    found = T.candidates(with_notes(patients), trials, k)
    labels = found.join(shuffled(judged_pairs.select("patient_id", "trial_id", "decision", "score")),
                        ["patient_id", "trial_id"], "left").withColumn(
        "eligibility", U.eligibility_of_decision("decision"))
    targets = patients.filter(F.col("target_trial_id").isNotNull()).select(
        "patient_id", F.col("target_trial_id").alias("trial_id"))
    return labels, recall_at_k(found, expected_pairs(judged_pairs, targets))


def target_pairs(patients: DataFrame, trials: DataFrame, count: int | None = None) -> DataFrame:
    """Each patient with its known target trial; patients without one are dropped."""
    p = patients if count is None else R.head_rows(patients, "patient_pos", count)
    t = trials.select("trial_id")
    pairs = p.select("patient_id", "patient_pos", F.col("target_trial_id").alias("trial_id"),
                     F.coalesce("scenario", F.lit("")).alias("scenario"))
    return pairs.join(t, "trial_id").withColumn(
        "pair_id", F.concat("patient_id", F.lit("__"), "trial_id"))
