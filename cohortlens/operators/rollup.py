"""Rolling criteria up to eligibility, scores and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as X
from ..session import broadcast_if_small
from .matching import count_status

# How ``not_applicable`` and an empty criteria list are read.
POLICIES = {
    # ignored; nothing satisfied leaves the pair open
    "ignore": {"na": "ignore", "empty": "uncertain"},
    # counts as fulfilled
    "accept": {"na": "accept", "empty": "uncertain"},
    # makes the pair ineligible; no criteria at all is eligible
    "reject": {"na": "reject", "empty": "eligible"},
}


def eligibility_of(violated: Column, unknown: Column, satisfied: Column, na: Column, *,
                   na_policy: str = "ignore", empty: str = "uncertain") -> Column:
    """Eligibility from the counts of the four statuses."""
    bad = violated > 0
    if na_policy == "reject":
        bad = bad | (na > 0)
    good = satisfied > 0
    if na_policy == "accept":
        good = good | (na > 0)
    return (F.when(bad, "ineligible").when(unknown > 0, "uncertain")
            .when(good, "eligible").otherwise(F.lit(empty)))


def status_counts(rows: Column | str) -> list[Column]:
    return [count_status(rows, s).alias(s) for s in K.CRITERION_STATUS]


def roll_up_array(rows: Column | str, *, na_policy: str = "ignore",
                  empty: str = "uncertain") -> Column:
    """Eligibility of a pair whose criterion rows sit in one array (no shuffle)."""
    # whether a status occurs is all that counts, and finding it makes no list
    v, u, s, n = (F.array_position(X.col(rows)["status"], F.lit(x)) for x in
                  ("violated", "unknown", "satisfied", "not_applicable"))
    return eligibility_of(v, u, s, n, na_policy=na_policy, empty=empty)


def roll_up(judgments: DataFrame, *, keys=("patient_id", "trial_id"),
            na_policy: str = "ignore", empty: str = "uncertain") -> DataFrame:
    """Eligibility per pair from flat judgment rows: one aggregation with partial counts."""
    n = lambda s: F.count_if(F.col("status") == s)
    counted = judgments.groupBy(*keys).agg(
        *[n(s).cast("int").alias(s) for s in K.CRITERION_STATUS])
    return counted.withColumn("eligibility", eligibility_of(
        *[F.col(c) for c in ("violated", "unknown", "satisfied", "not_applicable")],
        na_policy=na_policy, empty=empty))


def confidence(status: Column | str) -> Column:
    return X.mapped(status, K.STATUS_CONFIDENCE, 1.0)


def eligibility_of_decision(decision: Column | str) -> Column:
    return X.mapped(decision, K.DECISION_TO_ELIGIBILITY, "uncertain")


def status_of_evidence(status: Column | str) -> Column:
    return X.mapped(status, K.EVIDENCE_TO_STATUS, "unknown")


def report_score(eligibility: Column | str, baseline: Column | str,
                 unknown: Column | str) -> Column:
    """Score band of the label plus a share of the baseline, less a penalty per unknown."""
    e, b = X.col(eligibility), X.col(baseline)
    penalty = F.least(F.lit(0.2), X.col(unknown).cast("double") * 0.03)
    base = (F.when(e == "eligible", 0.75 + 0.25 * b)
            .when(e == "uncertain", 0.45 + 0.25 * b - penalty)
            .otherwise(0.1 + 0.2 * b))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base))


def _after_colon(c: Column) -> Column:
    return F.regexp_replace(c, "^[^:]*:", "")


def trial_side_text(criterion: Column) -> Column:
    """What the trial says about the checked criterion (columns ``t_*`` in scope)."""
    s = X.sql_text
    tail = _after_colon(criterion)
    return (
        F.when(criterion == "condition", F.concat(
            F.lit("Trial conditions: "), F.array_join("t_conditions", ", ")))
        .when(criterion == "age", F.concat(
            F.lit("Trial age range: "), s("t_min_age"), F.lit(" to "), s("t_max_age")))
        .when(criterion == "sex", F.concat(F.lit("Trial sex criterion: "), F.col("t_sex")))
        .when(criterion == "stage", F.concat(
            F.lit("Allowed stages: "), F.array_join("t_allowed_stages", ", ")))
        .when(criterion == "ecog", F.concat(F.lit("Maximum ECOG: "), s("t_max_ecog")))
        .when(F.startswith(criterion, F.lit("biomarker:")), F.concat(
            F.lit("Required biomarker "), tail, F.lit(": "),
            F.coalesce(F.try_element_at("t_required_biomarkers", tail), F.lit(""))))
        .when(F.startswith(criterion, F.lit("flag:")), F.concat(
            F.lit("Exclusion criterion: "), X.spaced(tail)))
        .when(F.startswith(criterion, F.lit("field:")), F.concat(
            F.lit("Required patient field: "), tail))
        .otherwise(F.coalesce(F.nullif("t_eligibility_criteria", F.lit("")),
                              F.nullif("t_summary", F.lit("")), F.col("t_title")))
    )


def report_criteria(judged: DataFrame, trials: DataFrame) -> DataFrame:
    """Numbered criterion results of every judged pair, then the unrestricted checks.

    All in the pair's row: numbering is the array position, ``not_applicable`` rows follow.
    """
    t = trials.select("trial_id", *[F.col(c).alias("t_" + c) for c in (
        "title", "conditions", "min_age", "max_age", "sex", "allowed_stages", "max_ecog",
        "required_biomarkers", "eligibility_criteria", "summary", "source_url")])
    pairs = judged.join(broadcast_if_small(t, counted=trials), "trial_id")

    def one(e, i):
        exclusion = F.startswith(e["criterion"], F.lit("flag:"))
        status = status_of_evidence(e["status"])
        return F.struct(
            F.concat(F.col("trial_id"), F.when(exclusion, F.lit("-E-")).otherwise(F.lit("-I-")),
                     X.padded(i + 1, 3)).alias("criterion_id"),
            F.when(exclusion, F.lit("exclusion")).otherwise(F.lit("inclusion"))
            .alias("criterion_type"),
            e["criterion"].alias("criterion"), status.alias("status"),
            trial_side_text(e["criterion"]).alias("trial_evidence"),
            e["detail"].alias("patient_evidence"), e["detail"].alias("reason"),
            confidence(status).alias("confidence"))

    checks = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(name).alias("n"), F.lit(text).alias("t")))
        for cond, name, text in (
            (F.lower(F.coalesce("t_sex", F.lit(""))).isin("", "all", "any"), "sex",
             "Trial is open to all recorded sexes."),
            (F.size("t_allowed_stages") == 0, "stage",
             "No explicit stage restriction was normalized."),
            (F.col("t_max_ecog").isNull(), "ecog",
             "No explicit ECOG threshold was normalized."),
            (F.size("t_required_biomarkers") == 0, "biomarker",
             "No required biomarker was normalized."),
        )]))

    def open_check(c, i):
        return F.struct(
            F.concat(F.col("trial_id"), F.lit("-N-"), X.padded(F.size("evidence") + i + 1, 3)).alias("criterion_id"),
            F.lit("not_applicable").alias("criterion_type"), c["n"].alias("criterion"),
            F.lit("not_applicable").alias("status"), c["t"].alias("trial_evidence"),
            F.lit("").alias("patient_evidence"), c["t"].alias("reason"),
            F.lit(1.0).alias("confidence"))

    return pairs.select(
        *judged.columns, X.text_or_empty("t_source_url").alias("trial_source_url"),
        F.concat(F.transform("evidence", one), F.transform(checks, open_check))
        .alias("criterion_results"))


def report_recommendations(judged: DataFrame, trials: DataFrame) -> DataFrame:
    """One report row per pair: label, scores, questions and explanation."""
    rows = report_criteria(judged, trials)
    c = F.col("criterion_results")
    labelled = rows.select(
        *rows.columns, *status_counts(c),
        roll_up_array(c, na_policy="ignore").alias("eligibility"))
    scored = labelled.withColumn(
        "_score", report_score("eligibility", "score", "unknown"))
    return (scored.withColumn("recommendation_score", X.round_exact("_score", 3))
            .withColumn("explanation", report_explanation()).drop("_score"))


def report_explanation() -> Column:
    s = lambda c: F.col(c).cast("string")
    return (
        F.when(F.col("eligibility") == "eligible", F.concat(
            F.lit("Ranked as eligible because "), s("satisfied"), F.lit(
                " applicable criteria were satisfied and no violated or unknown criteria were "
                "found.")))
        .when(F.col("eligibility") == "ineligible", F.concat(
            F.lit("Ranked as ineligible because "), s("violated"),
            F.lit(" criterion conflicts were found. Baseline rationale: "), F.col("rationale")))
        .otherwise(F.concat(
            F.lit("Ranked as uncertain because "), s("unknown"),
            F.lit(" required criteria need more information. Baseline rationale: "),
            F.col("rationale")))
    )


def first_reasons(rows: Column | str, status: str, n: int = 3) -> Column:
    hits = F.slice(F.filter(rows, lambda r: r["status"] == status), 1, n)
    return F.array_join(F.transform(
        hits, lambda r: F.concat(r["criterion_id"], F.lit(": "), r["reason"])), "; ")


def assessment_explanation(eligibility: Column | str, rows: Column | str) -> Column:
    """Explanation of a note-based assessment: counts, or the first three reasons."""
    e = X.col(eligibility)
    pairs = []
    for status in sorted(K.CRITERION_STATUS):
        pairs.append(F.concat(F.lit(f"'{status}': "), count_status(rows, status).cast("string")))
    counts = F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))
    return (
        F.when(e == "eligible", F.concat(
            F.lit("Eligible because no violated or unknown supplied criteria remain; counts="),
            counts, F.lit(".")))
        .when(e == "ineligible", F.concat(
            F.lit("Ineligible because supplied criteria are violated: "),
            first_reasons(rows, "violated")))
        .otherwise(F.concat(
            F.lit("Uncertain because required information is missing: "),
            first_reasons(rows, "unknown")))
    )


def draft_explanation(eligibility: Column | str, rows: Column | str) -> Column:
    """Explanation derived for a label whose own text is missing."""
    e = X.col(eligibility)
    unknown, violated = first_reasons(rows, "unknown"), first_reasons(rows, "violated")
    return (
        F.when(e == "eligible", F.lit(
            "Eligible because all normalized criterion judgments are satisfied or not "
            "applicable."))
        .when((e == "uncertain") & (unknown != ""), F.concat(
            F.lit("Uncertain because required information remains unknown: "), unknown))
        .when(e == "uncertain", F.lit(
            "Uncertain based on the final judgment; no unresolved criterion-level reason was "
            "preserved."))
        .when(violated != "", F.concat(
            F.lit("Excluded because criterion-level violations were found: "), violated))
        .otherwise(F.lit(
            "Excluded based on the final judgment; no criterion-level violation reason was "
            "preserved."))
    )


def label_rationale(eligibility: Column | str, rows: Column | str) -> Column:
    """Rationale of a rule-based pair label, from the status counts."""
    e = X.col(eligibility)
    n = lambda s: count_status(rows, s).cast("string")
    return (
        F.when(e == "eligible", F.concat(
            F.lit("All "), n("satisfied"), F.lit(" listed required criteria were satisfied.")))
        .when(e == "ineligible", F.concat(
            n("violated"), F.lit(" listed criterion conflicts were found.")))
        .otherwise(F.concat(n("unknown"), F.lit(" listed criteria need more information.")))
    )


def patient_summary(ranked: DataFrame, *, listed: int = 1000) -> DataFrame:
    """Lines per patient (``line_no`` from 1) from the bucket ranks.

    Ids are listed in rank order, ``listed`` on a line, so every id is named and no row grows with
    a hot patient's bucket.  Further lines go on with the ids.
    """
    labels = ("eligible", "uncertain", "ineligible")
    counts = ranked.groupBy("patient_id").agg(*[
        F.count_if(F.col("eligibility") == label).alias(label) for label in labels])
    shown = F.when(F.col("eligible") > 0, "eligible").when(F.col("uncertain") > 0, "uncertain")
    counts = counts.withColumn("shown", shown)
    lines = (ranked.where(F.col("eligibility").isin("eligible", "uncertain"))
             .groupBy("patient_id", F.col("eligibility").alias("shown"),
                      (F.floor((F.col("bucket_rank") - 1) / F.lit(listed)) + 1).cast("int").alias("line_no"))
             .agg(F.array_sort(F.collect_list(F.struct("bucket_rank", "trial_id"))).alias("rows")))
    ids = F.array_join(F.transform("rows", lambda x: x["trial_id"]), ", ")
    head = F.when(F.col("line_no") > 1, "").when(
        F.col("shown") == "eligible", "Recommended eligible trial ids after final matching: ").otherwise(
        "No eligible trial was identified; uncertain trials needing more information: ")
    size = F.when(F.col("shown") == "eligible", F.col("eligible")).otherwise(F.col("uncertain"))
    tail = F.when(F.col("line_no") * listed >= size, ".").otherwise(",")
    none = F.concat(F.lit("No eligible or uncertain trial was identified; excluded trial count: "),
                    F.col("ineligible").cast("string"), F.lit("."))
    return (counts.join(lines, ["patient_id", "shown"], "left")
            .withColumn("patient_level_summary", F.when(F.col("shown").isNull(), none).otherwise(
                F.concat(head, ids, tail)))
            .withColumn("line_no", F.coalesce("line_no", F.lit(1)))
            .drop("rows", "shown"))
