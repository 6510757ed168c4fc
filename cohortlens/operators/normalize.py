"""Patient and trial records: alias, coerce and infer into the typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as X
from ..functions import notes as N


def _has(df: DataFrame, name: str):
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def normalize_patients(raw: DataFrame) -> DataFrame:
    """Raw patient rows to the patient table; gaps are filled from the note.

    Keeps ``patient_pos`` when the source carries an ordinal.
    """
    note = X.first_text(_has(raw, "clinical_note"), _has(raw, "note"), _has(raw, "title"))
    base = raw.withColumn("_note", note)
    pos = [F.col("patient_pos")] if "patient_pos" in raw.columns else []
    flag_true = lambda k, v: F.coalesce(
        ~F.lower(v.cast("string")).isin("false", "", "0"), F.lit(False))
    return base.select(
        *pos,
        X.text_or_empty(F.coalesce(*[
            F.nullif(_has(raw, c).cast("string"), F.lit("")) for c in ("patient_id", "id", "num")
        ])).alias("patient_id"),
        F.coalesce(X.as_int("age"), N.age_from_note("_note")).alias("age"),
        F.coalesce(X.blank_to_null("sex"), N.sex_from_note("_note")).alias("sex"),
        F.coalesce(X.blank_to_null("diagnosis"), N.diagnosis_from_keywords("_note"))
        .alias("diagnosis"),
        X.blank_to_null("stage").alias("stage"),
        X.as_int("ecog").alias("ecog"),
        X.string_map("biomarkers").alias("biomarkers"),
        X.string_list("prior_treatments").alias("prior_treatments"),
        F.transform_values(
            F.coalesce(F.col("flags"), F.create_map().cast("map<string,string>")), flag_true
        ).alias("flags"),
        X.string_map("location").alias("location"),
        F.col("_note").alias("clinical_note"),
        X.blank_to_null(_has(raw, "scenario")).alias("scenario"),
        X.blank_to_null(_has(raw, "target_trial_id")).alias("target_trial_id"),
    )


def normalize_trials(raw: DataFrame) -> DataFrame:
    """Raw trial rows to the trial table."""
    pos = [F.col("trial_pos")] if "trial_pos" in raw.columns else []
    nonempty = lambda c: F.nullif(c.cast("string"), F.lit(""))
    lists = ["required_prior_treatments", "excluded_flags", "required_patient_fields"]
    return raw.select(
        *pos,
        X.text_or_empty(F.coalesce(*[
            nonempty(_has(raw, c)) for c in ("trial_id", "nct_id", "id")])).alias("trial_id"),
        F.coalesce(nonempty(F.col("title")), F.lit("Untitled trial")).alias("title"),
        X.blank_to_null("phase").alias("phase"),
        X.string_list("conditions").alias("conditions"),
        X.string_list("interventions").alias("interventions"),
        X.as_int("min_age").alias("min_age"),
        X.as_int("max_age").alias("max_age"),
        F.coalesce(nonempty(F.col("sex")), F.lit("all")).alias("sex"),
        X.string_list("allowed_stages").alias("allowed_stages"),
        X.as_int("max_ecog").alias("max_ecog"),
        X.string_map("required_biomarkers").alias("required_biomarkers"),
        *[X.string_list(c).alias(c) for c in lists],
        X.blank_to_null("summary").alias("summary"),
        X.blank_to_null("status").alias("status"),
        X.as_int("enrollment").alias("enrollment"),
        X.blank_to_null("source_url").alias("source_url"),
        X.blank_to_null("eligibility_criteria").alias("eligibility_criteria"),
        X.string_list("inclusion_criteria").alias("inclusion_criteria"),
        X.string_list("exclusion_criteria").alias("exclusion_criteria"),
    )


def blinded(records: DataFrame) -> DataFrame:
    """Only what a contestant may see."""
    return records.select(*K.RECORD_KEYS)


PROFILE_FIELDS = [
    "patient_id", "age", "sex", "diagnosis", "stage", "ecog", "biomarkers",
    "prior_treatments", "flags", "location", "scenario", "target_trial_id",
]


def sparse_profile(patients: DataFrame) -> DataFrame:
    """``profile`` as JSON without null or empty fields."""
    fields = []
    for name in PROFILE_FIELDS:
        c = F.col(name)
        if name in ("biomarkers", "flags", "location", "prior_treatments"):
            c = F.when(F.size(c) > 0, c)
        elif name not in ("age", "ecog"):
            c = F.nullif(c, F.lit(""))
        fields.append(c.alias(name))
    return patients.withColumn("profile", F.to_json(F.struct(*fields)))


def _shown(name: str, most: int | None) -> Column:
    return F.col(name) if most is None else F.slice(name, 1, most).alias(name)


def _excerpt(chars: int | None) -> Column:
    text = X.text_or_empty("eligibility_criteria") if chars is None else X.excerpt(
        "eligibility_criteria", chars)
    return text.alias("eligibility_criteria_excerpt")


def judging_view(trials: DataFrame, *, items: int | None = None, lines: int | None = None,
                 chars: int | None = None) -> DataFrame:
    """The trial columns a judge reads, whole unless limits are given (historic: 8, 12, 2400)."""
    return trials.select(
        "trial_id", "title", "conditions", _shown("interventions", items),
        "phase", "status", "source_url", "summary", "min_age", "max_age", "sex",
        "allowed_stages", "max_ecog", "required_biomarkers", "required_prior_treatments",
        "excluded_flags", "required_patient_fields",
        _shown("inclusion_criteria", lines), _shown("exclusion_criteria", lines), _excerpt(chars),
    )


def candidate_view(trials: DataFrame, *, items: int | None = None, lines: int | None = None,
                   chars: int | None = None) -> DataFrame:
    """The trial columns shown with a retrieved candidate (historic limits: 8, 10, 1800)."""
    known = ["min_age", "max_age", "sex", "allowed_stages", "max_ecog", "required_biomarkers",
             "required_prior_treatments", "excluded_flags"]
    return trials.select(
        "trial_id", F.col("title").alias("trial_title"),
        X.text_or_empty("source_url").alias("trial_source_url"),
        "conditions", "phase", "status",
        _shown("interventions", items),
        F.to_json(F.struct(*known)).alias("known_structured_fields"),
        F.struct(
            _shown("inclusion_criteria", lines).alias("inclusion"),
            _shown("exclusion_criteria", lines).alias("exclusion"), _excerpt(chars),
        ).alias("raw_criteria_excerpt"),
    )


def inspection_view(trials: DataFrame, chars: int) -> DataFrame:
    """The trial record with every text cut to ``chars``, at any depth."""
    out = []
    for field in trials.schema.fields:
        kind = field.dataType.simpleString()
        if field.name in ("enrollment", "trial_pos"):
            continue
        c = F.col(field.name)
        if kind == "string":
            c = X.cut(c, chars)
        elif kind == "array<string>":
            c = X.cut_list(c, chars)
        elif kind == "map<string,string>":
            c = F.transform_values(c, lambda k, v: X.cut(v, chars))
        out.append(c.alias(field.name))
    return trials.select(*out)


def with_trial_detail(candidates: DataFrame, trials: DataFrame, chars: int) -> DataFrame:
    """Each candidate with its full trial record when one exists (left join)."""
    view = inspection_view(trials, chars)
    detail = view.select("trial_id", F.struct(*view.columns).alias("database_record"))
    return candidates.join(detail, "trial_id", "left")
