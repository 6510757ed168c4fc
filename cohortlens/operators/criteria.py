"""Criterion rows of a trial and their classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as X


def _criterion(cond, suffix, kind, text, value) -> Column:
    made = F.struct(
        F.concat(F.col("trial_id"), suffix if isinstance(suffix, Column) else F.lit(suffix))
        .alias("criterion_id"),
        F.lit(kind).alias("criterion_type"),
        (text if isinstance(text, Column) else F.lit(text)).alias("criterion"),
        value.alias("structured_json"),
        F.lit(True).alias("required"))
    return made if cond is None else F.when(cond, made)


@X.reused
def criteria_array() -> Column:
    """All criteria of a trial row, in their fixed order."""
    quoted = lambda c: F.to_json(F.array(c))
    json_text = lambda c: F.substring(quoted(c), 2, 1 << 30)
    scalar = lambda c: F.regexp_replace(json_text(c), r"\]$", "")
    restricted = ~F.lower(F.coalesce("sex", F.lit(""))).isin("", "all", "any")
    # absent bounds stay as JSON nulls, as a reader of the bounds expects both keys
    num = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    bounds = F.concat(F.lit('{"min_age":'), num("min_age"), F.lit(',"max_age":'),
                      num("max_age"), F.lit("}"))
    singles = F.array_compact(F.array(
        _criterion(None, "-I-condition", "inclusion",
                   "Patient diagnosis should match the trial condition.",
                   F.to_json("conditions")),
        _criterion(F.col("min_age").isNotNull() | F.col("max_age").isNotNull(), "-I-age",
                   "inclusion", "Patient age should be within trial bounds.", bounds),
        _criterion(restricted, "-I-sex", "inclusion",
                   "Patient recorded sex should match the trial sex criterion.",
                   scalar(F.col("sex"))),
        _criterion(F.size("allowed_stages") > 0, "-I-stage", "inclusion",
                   "Patient disease stage should be allowed.", F.to_json("allowed_stages")),
        _criterion(F.col("max_ecog").isNotNull(), "-I-ecog", "inclusion",
                   "Patient ECOG performance status should be at or below the maximum.",
                   F.col("max_ecog").cast("string")),
    ))
    markers = F.transform(F.map_entries("required_biomarkers"), lambda e: _criterion(
        None, F.concat(F.lit("-I-biomarker-"), X.slug(e["key"])), "inclusion",
        F.concat(F.lit("Patient biomarker "), e["key"], F.lit(" should match "), e["value"],
                 F.lit(".")),
        F.to_json(F.map_from_arrays(F.array(e["key"]), F.array(e["value"])))))
    priors = F.transform("required_prior_treatments", lambda x: _criterion(
        None, F.concat(F.lit("-I-prior-"), X.slug(x)), "inclusion",
        F.concat(F.lit("Patient should have prior treatment: "), x, F.lit(".")), scalar(x)))
    flags = F.transform("excluded_flags", lambda x: _criterion(
        None, F.concat(F.lit("-E-"), X.slug(x)), "exclusion",
        F.concat(F.lit("Exclude if patient has "), X.spaced(x), F.lit(".")), scalar(x)))
    return F.concat(singles, markers, priors, flags)


def derive_criteria(trials: DataFrame) -> DataFrame:
    """``(trial_id, criterion_pos, criterion…)``; one row per criterion, no shuffle.

    ``structured_json`` is the criterion's value as JSON text; :func:`typed` turns it into a
    VARIANT where a reader needs one.
    """
    return trials.select(
        "trial_id", F.posexplode(criteria_array()).alias("criterion_pos", "c")
    ).select("trial_id", "criterion_pos", "c.*")


def typed(criteria: DataFrame) -> DataFrame:
    """Adds ``structured_value`` as VARIANT."""
    return criteria.withColumn("structured_value", F.try_parse_json("structured_json"))


def criterion_suffix(criterion_id: Column | str, trial_id: Column | str) -> Column:
    """The part after the trial id: ``I-age``, ``E-organ-transplant``."""
    return F.substr(X.col(criterion_id), F.length(X.col(trial_id)) + 2)


def matcher_field(criterion_id: Column | str, criterion: Column | str,
                  criterion_type: Column | str, structured_text: Column | str, *,
                  compat: bool = False) -> Column:
    """Field a criterion is about, for the note evaluator.

    ``compat`` tests loose substrings in the historic order (an id that contains ``stage``
    contains ``age`` first; sex, most prior treatments and the marker name are lost).  The
    default reads the id's own suffix.
    """
    cid = F.lower(X.text_or_empty(criterion_id))
    text = F.concat(cid, F.lit(" "), F.lower(X.text_or_empty(criterion)))
    exclusion = X.col(criterion_type) == "exclusion"
    has = lambda c, w: F.contains(c, F.lit(w))
    value = F.coalesce(F.nullif(X.col(structured_text), F.lit("")), cid)
    flag = F.concat(F.lit("flag_"), X.norm_flag(value))
    loose = (
        F.when(has(cid, "condition") | has(text, "diagnosis"), "condition")
        .when(has(cid, "age"), "age").when(has(cid, "stage"), "stage")
        .when(has(cid, "ecog") | has(text, "performance"), "ecog")
        .when(has(cid, "prior-platinum") | has(text, "platinum"), "prior_platinum_chemotherapy")
        .when(has(cid, "biomarker") | has(text, "molecular"), "biomarker_required")
        .when(exclusion, flag).otherwise("raw")
    )
    if compat:
        return loose
    part = F.nullif(F.regexp_extract(cid, r"-([ie]-[a-z0-9-]+)$", 1), F.lit(""))
    return (
        F.when(part == "i-condition", "condition").when(part == "i-age", "age")
        .when(part == "i-sex", "sex").when(part == "i-stage", "stage")
        .when(part == "i-ecog", "ecog")
        .when(F.startswith(part, F.lit("i-prior-")), F.concat(
            F.lit("prior_"), F.translate(F.substring(part, 9, 1 << 30), "-", "_")))
        .when(F.startswith(part, F.lit("i-biomarker-")), F.concat(
            F.lit("biomarker_"), F.translate(F.substring(part, 13, 1 << 30), "-", "_")))
        .when(exclusion, flag).otherwise(loose)
    )


def matcher_operator(field: Column | str) -> Column:
    f = X.col(field)
    return (
        F.when(f == "age", "within_range").when(f == "ecog", "<=")
        .when(F.startswith(f, F.lit("flag_")), "must_be_absent")
        .when(F.startswith(f, F.lit("prior_")), "must_be_present").otherwise("matches")
    )


def protocol_field(criterion_id: Column | str, criterion: Column | str,
                   id_pattern: str = r"^NCT\d+-[IE]-(.+)") -> Column:
    """Field named by the id itself, else guessed from the text."""
    cid, text = X.text_or_empty(criterion_id), F.lower(X.text_or_empty(criterion))
    part = F.nullif(F.regexp_extract(cid, id_pattern, 1), F.lit(""))
    has = lambda w: F.contains(text, F.lit(w))
    return F.coalesce(
        F.translate(part, "-", "_"),
        F.when(has("age"), "age").when(has("diagnosis") | has("condition"), "condition")
        .when(has("stage"), "stage").otherwise("clinical_fact"))


def protocol_operator(field: Column | str, criterion_type: Column | str,
                      structured_value: Column | str) -> Column:
    """Operator by the value's JSON type (``structured_value`` is a VARIANT)."""
    kind = F.schema_of_variant(X.col(structured_value))
    return (
        F.when(X.col(criterion_type) == "exclusion", "must_be_absent")
        .when((X.col(field) == "age") & F.startswith(kind, F.lit("OBJECT")), "range")
        .when(F.startswith(kind, F.lit("ARRAY")), "one_of")
        .when(kind.isNull() | (kind == "VOID"), "clinical_match").otherwise("equals")
    )


def criterion_family(criterion_id: Column | str, criterion_type: Column | str) -> Column:
    """Family of a criterion in evaluation tables."""
    cid = X.text_or_empty(criterion_id)
    has = lambda w: F.contains(cid, F.lit(w))
    out = None
    for name in ("condition", "age", "sex", "stage", "ecog"):
        hit = has(f"-I-{name}")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return (out.when(has("-I-biomarker-"), "biomarker").when(has("-I-prior-"), "prior_treatment")
            .when(has("-E-") | (X.col(criterion_type) == "exclusion"), "exclusion_flag")
            .otherwise("other"))


def parsed_rules(criteria: DataFrame, *, compat: bool = False) -> DataFrame:
    """Field and operator of every criterion, once per trial rather than per patient."""
    c = criteria if "structured_value" in criteria.columns else typed(criteria)
    plain = F.coalesce(F.try_variant_get("structured_value", "$", "string"), F.lit(""))
    return (c.withColumn("field", matcher_field(
        "criterion_id", "criterion", "criterion_type", plain, compat=compat))
        .withColumn("operator", matcher_operator("field")))


def expected_criteria(records: DataFrame) -> DataFrame:
    """``(patient_id, trial_id, criterion_pos, criterion…)`` of nested candidate records."""
    trials = records.select("patient_id", F.posexplode("candidate_trials")
                            .alias("candidate_pos", "t"))
    return trials.select(
        "patient_id", F.col("t.trial_id").alias("trial_id"), "candidate_pos",
        F.posexplode("t.criteria_to_assess").alias("criterion_pos", "c")
    ).select("patient_id", "trial_id", "candidate_pos", "criterion_pos", "c.*")


def expected_trials(records: DataFrame) -> DataFrame:
    t = records.select("patient_id", F.posexplode("candidate_trials").alias("candidate_pos", "t"))
    return t.select(
        "patient_id", "candidate_pos", F.col("t.trial_id").alias("trial_id"),
        F.coalesce(F.nullif("t.trial_title", F.lit("")), "t.title", F.lit(""))
        .alias("trial_title"),
        F.coalesce(F.nullif("t.trial_source_url", F.lit("")), "t.source_url", F.lit(""))
        .alias("trial_source_url"),
        F.col("t.conditions").alias("conditions"))


def unknown_judgments(expected: DataFrame, reason: str) -> DataFrame:
    """A judgment row of status ``unknown`` for every expected criterion."""
    return expected.withColumn("status", F.lit("unknown")).withColumn("reason", F.lit(reason))
