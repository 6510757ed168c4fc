"""Test cohorts: patients made from trials with one targeted change each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as X
from ..functions.notes import is_oncology, render_note
from .ranking import full_rank


@X.reused
def scenarios() -> Column:
    """Scenarios a trial row supports, in fixed order."""
    w = lambda c, *names: F.when(c, X.words(names)).otherwise(X.no_strings())
    bounded = F.col("min_age").isNotNull() | F.col("max_age").isNotNull()
    return F.concat(
        X.words(["clear_candidate", "wrong_condition", "missing_age"]),
        w(bounded, "age_conflict"), w(F.col("sex").isin("female", "male"), "sex_conflict"),
        w(F.size("required_biomarkers") > 0, "missing_biomarker"),
        w(F.size("excluded_flags") > 0, "exclusion_conflict"),
        w(F.size("allowed_stages") > 0, "stage_conflict"),
        w(F.col("max_ecog").isNotNull(), "ecog_conflict", "missing_ecog"),
        w(F.size("required_prior_treatments") > 0, "prior_treatment_gap"))


def usable_trials(trials: DataFrame) -> DataFrame:
    """Trials with conditions (all trials when none has any), numbered from 0."""
    some = F.size("conditions") > 0
    any_usable = trials.agg(F.coalesce(F.bool_or(some), F.lit(False))).scalar()
    kept = trials.filter(some | ~any_usable).withColumn("_all", F.lit(1))
    return full_rank(kept, ["_all"], [], "trial_pos", "_no").drop("_all").withColumn(
        "trial_no", F.col("_no") - 1).drop("_no")


def _draw(name: str, seed: int, n: Column) -> Column:
    """A repeatable whole number in [0, n) per row and purpose."""
    return F.pmod(F.xxhash64(F.col("row_no"), F.lit(seed), F.lit(name)), n)


def _pick(values: Column, name: str, seed: int) -> Column:
    return F.get(values, _draw(name, seed, F.greatest(F.size(values), F.lit(1))).cast("int"))


def make_cohort(trials: DataFrame, n: int, seed: int = 20260707) -> DataFrame:
    """``n`` patients, trial and scenario taken round-robin by row number.

    Row ``i`` uses trial ``i mod T`` and, in round ``i div T``, the trial's scenario number
    ``(trial_no + round) mod count``.  Rows come from a range, so generation is spread over
    the cluster; draws are hashes of row, seed and purpose.
    """
    numbered = usable_trials(trials)
    total = numbered.agg(F.count(F.lit(1))).scalar()
    spark = trials.sparkSession
    rows = spark.range(n).select(F.col("id").alias("row_no"), total.alias("_t")).filter("_t > 0")
    rows = rows.select("row_no", F.pmod("row_no", F.col("_t")).alias("trial_no"),
                       F.floor(F.col("row_no") / F.col("_t")).alias("round"))
    prepared = numbered.withColumn("_s", scenarios())
    joined = rows.join(prepared, "trial_no")
    at = F.pmod(F.col("trial_no") + F.col("round"), F.size("_s")).cast("int")
    return _patients(joined.withColumn("scenario", F.get("_s", at)), seed)


def _patients(rows: DataFrame, seed: int) -> DataFrame:
    sc = F.col("scenario")
    low, high = F.col("min_age"), F.col("max_age")
    least = F.coalesce(low, F.lit(18))
    most = F.greatest(least, F.least(F.coalesce(high, F.lit(82)), F.lit(88)))
    drawn = least + _draw("age", seed, most - least + 1).cast("int")
    age = (F.when(sc == "missing_age", F.lit(None).cast("int"))
           .when((sc == "age_conflict") & (low > 0), low - 1)
           .when((sc == "age_conflict") & high.isNotNull(), high + 1).otherwise(drawn))
    fixed_sex = F.col("sex").isin("female", "male")
    sex = (F.when((sc == "sex_conflict") & (F.col("sex") == "female"), "male")
           .when((sc == "sex_conflict") & (F.col("sex") == "male"), "female")
           .when(fixed_sex, F.col("sex"))
           .otherwise(_pick(X.words(["female", "male"]), "sex", seed)))
    name = F.lower(F.get("conditions", F.lit(0)))
    dx = (F.when(sc == "wrong_condition", _pick(X.words(K.WRONG_DIAGNOSES), "dx", seed))
          .when(name.isNull(), "advanced solid tumor")
          .when(is_oncology(name), F.concat(F.lit("metastatic "), name)).otherwise(name))
    onc = F.exists("conditions", lambda c: _has_term(c))
    stages = F.size("allowed_stages") > 0
    open_stage = F.get(F.array(F.lit("III"), F.lit("IV"), F.lit(None).cast("string")),
                       _draw("stage", seed, F.lit(3)).cast("int"))
    stage = (F.when(~stages & ~onc, F.lit(None).cast("string"))
             .when(sc == "stage_conflict", "I")
             .when(stages, _pick(F.col("allowed_stages"), "stage", seed)).otherwise(open_stage))
    limit = F.coalesce("max_ecog", F.lit(2))
    ecog = (F.when((sc == "missing_ecog") | (F.col("max_ecog").isNull() & ~onc),
                   F.lit(None).cast("int"))
            .when(sc == "ecog_conflict", F.least(F.lit(4), limit + 1))
            .otherwise(_draw("ecog", seed, F.greatest(F.lit(0), limit) + 1).cast("int")))
    negatives = F.create_map(*[F.lit(x) for kv in K.NEGATIVE_BIOMARKERS.items() for x in kv])
    bio = (F.when(sc == "missing_biomarker", F.create_map().cast("map<string,string>"))
           .when(sc == "wrong_condition", F.transform_values(
               "required_biomarkers", lambda k, v: F.coalesce(
                   F.try_element_at(negatives, k), F.lit("negative"))))
           .otherwise(F.col("required_biomarkers")))
    prior = F.when(sc == "prior_treatment_gap", X.no_strings()).otherwise(
        F.col("required_prior_treatments"))
    first = F.get("excluded_flags", F.lit(0))
    flags = F.map_from_entries(F.transform(F.array_distinct("excluded_flags"), lambda f: F.struct(
        f.alias("key"), ((sc == "exclusion_conflict") & (f == first)).alias("value"))))
    no = F.col("row_no") + 1
    pid = F.concat(F.lit("SYN-GEN-"), F.lpad(
        no.cast("string"), F.greatest(F.lit(5), F.length(no.cast("string"))), F.lit("0")))
    state = F.get(X.words(K.US_STATES), F.pmod("row_no", F.lit(len(K.US_STATES))).cast("int"))
    made = rows.select(
        F.col("row_no").alias("patient_pos"), pid.alias("patient_id"), age.alias("age"),
        sex.alias("sex"), dx.alias("diagnosis"), stage.alias("stage"), ecog.alias("ecog"),
        bio.alias("biomarkers"), prior.alias("prior_treatments"), flags.alias("flags"),
        F.create_map(F.lit("country"), F.lit("US"), F.lit("state"), state).alias("location"),
        F.lit(None).cast("string").alias("clinical_note"), "scenario",
        F.col("trial_id").alias("target_trial_id"))
    return made.withColumn("clinical_note", render_note("patient_pos"))


def _has_term(c: Column) -> Column:
    """Disease terms as written; upper-case names do not count."""
    cond = F.lit(False)
    for word in K.ONCOLOGY_WORDS:
        cond = cond | F.contains(c, F.lit(word))
    return cond
