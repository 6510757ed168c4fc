"""Judging pairs: every check of a pair is one array expression in the pair's own row.

Text is normalized once per patient and once per trial, so a pair only compares prepared
values.  Nothing here shuffles apart from the two joins that attach the records to the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as X
from ..session import broadcast_if_small

SCALAR_FIELDS = ["age", "sex", "diagnosis", "stage", "ecog", "clinical_note", "scenario",
                 "target_trial_id"]
LIST_FIELDS = ["biomarkers", "prior_treatments", "flags", "location"]


def disease_tokens(c: Column, generic=K.PAIR_GENERIC_WORDS) -> Column:
    """Words longer than three letters that are not generic."""
    stop = X.words(generic)
    parts = F.split(c, r"\s+")
    return F.array_distinct(F.filter(
        parts, lambda t: (F.length(t) > 3) & ~F.array_contains(stop, t)))


def note_tokens(c: Column, generic=K.NOTE_GENERIC_WORDS) -> Column:
    stop = X.words(generic)
    parts = F.regexp_extract_all(c, F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(
        parts, lambda t: (F.length(t) > 3) & ~F.array_contains(stop, t)))


def _entries(m: Column) -> Column:
    return F.transform(F.map_entries(m), lambda e: F.struct(
        e["key"].alias("name"), X.norm_key(e["key"]).alias("key"), e["value"].alias("value"),
        X.norm_key(e["value"]).alias("norm")))


@X.reused
def _patient_columns() -> list[Column]:
    dx = X.norm_key("diagnosis")
    missing = [F.when(F.col(c).isNull(), F.lit(c)) for c in SCALAR_FIELDS]
    missing += [F.when(F.size(c) == 0, F.lit(c)) for c in LIST_FIELDS]
    return [
        *[F.col(c).alias("p_" + c) for c in ("age", "sex", "diagnosis", "stage", "ecog",
                                             "flags")],
        F.nullif(F.col("diagnosis"), F.lit("")).isNotNull().alias("p_has_dx"),
        dx.alias("p_dx"),
        disease_tokens(dx).alias("p_dx_tokens"),
        X.norm_key("sex").alias("p_sex_key"),
        X.norm_key("stage").alias("p_stage_key"),
        _entries(F.col("biomarkers")).alias("p_markers"),
        F.array_distinct(F.transform("prior_treatments", X.norm_key)).alias("p_priors"),
        F.array_compact(F.array(*missing)).alias("p_missing"),
    ]


def prepare_patients(patients: DataFrame) -> DataFrame:
    """Patient columns with a ``p_`` prefix plus their comparison forms."""
    keep = [c for c in ("patient_pos",) if c in patients.columns]
    return patients.select("patient_id", *keep, *_patient_columns())


@X.reused
def _trial_columns() -> list[Column]:
    return [
        *[F.col(c).alias("t_" + c) for c in (
            "title", "min_age", "max_age", "sex", "allowed_stages", "max_ecog",
            "required_biomarkers", "excluded_flags", "required_patient_fields", "conditions")],
        F.transform("conditions", lambda c: F.struct(
            c.alias("raw"), X.norm_key(c).alias("norm"),
            disease_tokens(X.norm_key(c)).alias("tokens"))).alias("t_terms"),
        X.norm_key("sex").alias("t_sex_key"),
        F.transform("allowed_stages", X.norm_key).alias("t_stage_keys"),
        _entries(F.col("required_biomarkers")).alias("t_markers"),
        F.transform("required_prior_treatments", lambda x: F.struct(
            x.alias("raw"), X.norm_key(x).alias("norm"))).alias("t_priors"),
    ]


def prepare_trials(trials: DataFrame) -> DataFrame:
    """Trial columns with a ``t_`` prefix plus their comparison forms."""
    keep = [c for c in ("trial_pos",) if c in trials.columns]
    return trials.select("trial_id", *keep, *_trial_columns())


def attach_records(pairs: DataFrame, patients: DataFrame, trials: DataFrame) -> DataFrame:
    """Prepared patient and trial columns on each given pair (two equi-joins).

    The pairs say what is judged: retrieved candidates, referrals, or any table with
    ``patient_id`` and ``trial_id``.  A side is broadcast only if it has few rows.
    """
    p, t = prepare_patients(patients), prepare_trials(trials)
    return (pairs.join(broadcast_if_small(p, counted=patients), "patient_id")
            .join(broadcast_if_small(t, counted=trials), "trial_id"))


def _row(criterion, status, detail) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(as_col(criterion).alias("criterion"), as_col(status).alias("status"),
                    as_col(detail).alias("detail"))


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def term_matches(dx: Column, tokens: Column, term: Column) -> Column:
    """Either text contains the other, or they share an identifying word."""
    return (F.contains(dx, term["norm"]) | F.contains(term["norm"], dx)
            | F.arrays_overlap(tokens, term["tokens"]))


def required_field_rows(row=_row) -> Column:
    known = [*SCALAR_FIELDS, *LIST_FIELDS, "patient_id"]
    fields = F.filter("t_required_patient_fields", lambda f: F.array_contains("p_missing", f)
                      | ~f.isin(known))
    return F.transform(fields, lambda f: row(
        F.concat(F.lit("field:"), f), "missing",
        _text("Required patient field '", f, "' is missing.")))


def condition_row(row=_row) -> Column:
    hit = X.pick(F.col("t_terms"),
                 lambda t: term_matches(F.col("p_dx"), F.col("p_dx_tokens"), t))
    dx = F.col("p_diagnosis")
    return F.when(F.size("t_terms") == 0, F.lit(None)).when(
        ~F.col("p_has_dx"), row("field:diagnosis", "missing", "Patient diagnosis is missing.")
    ).when(hit.isNotNull(), row("condition", "matched", _text(
        "Diagnosis '", dx, "' matches trial condition '", hit["raw"], "'."))
    ).otherwise(row("condition", "conflict", _text(
        "Diagnosis '", dx, "' does not match trial conditions.")))


def age_row(row=_row) -> Column:
    age, low, high = F.col("p_age"), F.col("t_min_age"), F.col("t_max_age")
    s = lambda c: c.cast("string")
    return F.when(low.isNull() & high.isNull(), F.lit(None)).when(
        age.isNull(), row("field:age", "missing", "Patient age is missing.")
    ).when(age < low, row("age", "conflict", _text(
        "Age ", s(age), " is below minimum age ", s(low), "."))
    ).when(age > high, row("age", "conflict", _text(
        "Age ", s(age), " is above maximum age ", s(high), "."))
    ).otherwise(row("age", "matched", _text("Age ", s(age), " is within bounds.")))


def sex_row(row=_row) -> Column:
    sex = F.col("p_sex")
    return F.when(F.col("t_sex_key").isin("all", "any", ""), F.lit(None)).when(
        F.nullif(sex, F.lit("")).isNull(), row("field:sex", "missing", "Patient sex is missing.")
    ).when(F.col("p_sex_key") == F.col("t_sex_key"),
           row("sex", "matched", _text("Sex '", sex, "' matches."))
    ).otherwise(row("sex", "conflict", _text(
        "Sex '", sex, "' does not match trial criterion '", F.col("t_sex"), "'.")))


def list_text(c: Column | str) -> Column:
    """A list of strings as ``['a', 'b']``."""
    return F.concat(F.lit("["), F.array_join(F.transform(
        X.col(c), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def stage_row(row=_row) -> Column:
    stage = F.col("p_stage")
    return F.when(F.size("t_allowed_stages") == 0, F.lit(None)).when(
        F.nullif(stage, F.lit("")).isNull(),
        row("field:stage", "missing", "Patient stage is missing.")
    ).when(F.array_contains("t_stage_keys", F.col("p_stage_key")),
           row("stage", "matched", _text("Stage '", stage, "' is allowed."))
    ).otherwise(row("stage", "conflict", _text(
        "Stage '", stage, "' is not in allowed stages ", list_text("t_allowed_stages"), ".")))


def ecog_row(row=_row) -> Column:
    ecog, limit = F.col("p_ecog"), F.col("t_max_ecog")
    s = lambda c: c.cast("string")
    return F.when(limit.isNull(), F.lit(None)).when(
        ecog.isNull(), row("field:ecog", "missing", "Patient ECOG is missing.")
    ).when(ecog <= limit, row("ecog", "matched", _text(
        "ECOG ", s(ecog), " is at or below maximum ", s(limit), "."))
    ).otherwise(row("ecog", "conflict", _text(
        "ECOG ", s(ecog), " is above maximum ", s(limit), ".")))


def marker_matches(observed: Column, required: Column) -> Column:
    """Normalized values; ``positive`` and ``negative`` stand for groups of values."""
    return (
        F.when(required == "positive",
               ~observed.isin("negative", "not detected", "wild type", "stable"))
        .when(required == "negative", observed.isin("negative", "not detected", "wild type"))
        .otherwise(F.array_contains(F.split(required, "_or_"), observed))
    )


def biomarker_rows(row=_row) -> Column:
    def one(need):
        # the last entry wins when two patient keys read the same
        have = F.try_element_at(
            F.filter("p_markers", lambda e: e["key"] == need["key"]), F.lit(-1))
        name = F.concat(F.lit("biomarker:"), need["name"])
        return F.when(have["value"].isNull(), row(name, "missing", _text(
            "Required biomarker '", need["name"], "' is missing."))
        ).when(marker_matches(have["norm"], need["norm"]), row(name, "matched", _text(
            need["name"], " value '", have["value"], "' matches '", need["value"], "'."))
        ).otherwise(row(name, "conflict", _text(
            need["name"], " value '", have["value"], "' does not match '", need["value"], "'.")))
    return F.transform("t_markers", one)


def prior_treatment_rows(row=_row) -> Column:
    def one(need):
        seen = F.exists("p_priors", lambda x: F.contains(x, need["norm"])
                        | F.contains(need["norm"], x))
        name = F.concat(F.lit("prior_treatment:"), need["raw"])
        return F.when(seen, row(name, "matched", _text(
            "Prior treatment '", need["raw"], "' is documented."))
        ).otherwise(row(name, "conflict", _text(
            "Prior treatment '", need["raw"], "' is not documented.")))
    rows = F.transform("t_priors", one)
    none = F.array(row("field:prior_treatments", "missing",
                        "Prior treatment history is missing."))
    return F.when((F.size("t_priors") > 0) & (F.size("p_priors") == 0), none).otherwise(rows)


def exclusion_flag_rows(row=_row) -> Column:
    def one(flag):
        value = F.try_element_at("p_flags", flag)
        name = F.concat(F.lit("flag:"), flag)
        return F.when(value.isNull(), row(name, "missing", _text(
            "Exclusion flag '", flag, "' is unknown."))
        ).when(value, row(name, "conflict", _text(
            "Patient has exclusion flag '", flag, "'."))
        ).otherwise(row(name, "matched", _text(
            "Patient does not have exclusion flag '", flag, "'.")))
    return F.transform("t_excluded_flags", one)


def _status_only(_criterion, status, _detail) -> Column:
    return F.struct((status if isinstance(status, Column) else F.lit(status)).alias("status"))


def _without_text(criterion, status, _detail) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n)
                      for n, v in (("criterion", criterion), ("status", status))])


@X.reused
def evidence_array(detail: bool = True, texts: bool = True) -> Column:
    """All checks of a pair, in their fixed order (a bag: repeats are kept).

    Without ``detail`` a check is its status alone, which is all that scoring needs; without ``texts``
    it is its criterion and status.
    """
    row = (_row if texts else _without_text) if detail else _status_only
    singles = F.array_compact(F.array(*[
        one(row) for one in (condition_row, age_row, sex_row, stage_row, ecog_row)]))
    return F.concat(required_field_rows(row), singles, biomarker_rows(row),
                    prior_treatment_rows(row), exclusion_flag_rows(row))


def count_status(evidence: Column | str, status: str) -> Column:
    return F.size(F.filter(evidence, lambda e: e["status"] == status)).cast("int")


@X.reused
def evidence_score(evidence: Column | str, missing_weight: float = K.MISSING_WEIGHT) -> Column:
    """Share of points; the fold adds in evidence order so sums are reproducible."""
    points = F.aggregate(evidence, F.lit(0.0), lambda acc, e: acc + F.when(
        e["status"] == "matched", F.lit(1.0)).when(
        e["status"] == "missing", F.lit(float(missing_weight))).otherwise(F.lit(0.0)))
    return F.when(F.size(evidence) == 0, F.lit(0.0)).otherwise(
        F.try_divide(points, F.size(evidence).cast("double")))


def judge_pairs(pairs: DataFrame, patients: DataFrame, trials: DataFrame, *,
                missing_weight: float = K.MISSING_WEIGHT, detail: bool = True,
                texts: bool = True) -> DataFrame:
    """Evidence, counts and score of every given pair.

    ``detail=False`` leaves the evidence rows and their texts out: rank with it first, then
    judge the few winners in full.  ``texts=False`` keeps the rows without their texts.
    """
    rows = attach_records(pairs, patients, trials)
    carried = [c for c in pairs.columns if c not in ("patient_id", "trial_id")]
    order = [c for c in ("patient_pos", "trial_pos") if c in rows.columns and c not in carried]
    judged = rows.select(
        "patient_id", "trial_id", *carried, *order, F.col("t_title").alias("trial_title"),
        evidence_array(detail, texts).alias("evidence"))
    scored = judged.withColumn("_share", evidence_score("evidence", missing_weight))
    kept = [c for c in judged.columns if detail or c != "evidence"]
    return scored.select(*kept, *_measures())


@X.reused
def _measures() -> list[Column]:
    return [
        count_status("evidence", "matched").alias("matched"),
        count_status("evidence", "missing").alias("missing"),
        count_status("evidence", "conflict").alias("conflicts"),
        X.round_exact("_share", 3).alias("score"),
    ]


def decide(judged: DataFrame, *, recommend: float = K.RECOMMEND_AT,
           info: float = K.INFO_AT) -> DataFrame:
    """Decision and rationale from the counts and the score."""
    decision, rationale = _decision_columns(recommend, info)
    return judged.withColumn("decision", decision).withColumn("rationale", rationale)


@X.reused
def _decision_columns(recommend: float, info: float) -> tuple[Column, Column]:
    decision = (
        F.when(F.col("conflicts") > 0, "not_recommended")
        .when(F.col("missing") > 0,
              F.when(F.col("score") >= info, "needs_more_info").otherwise("not_recommended"))
        .when(F.col("score") >= recommend, "recommend")
        .otherwise("not_recommended")
    )
    s = lambda c: F.col(c).cast("string")
    rationale = (
        F.when(F.col("decision") == "recommend", F.concat(
            F.lit("Eligible-looking match across "), s("matched"), F.lit(" checked criteria.")))
        .when(F.col("decision") == "needs_more_info", F.concat(
            F.lit("Potential match, but "), s("missing"),
            F.lit(" required criteria need confirmation.")))
        .otherwise(F.concat(
            F.lit("Not recommended because "), s("conflicts"), F.lit(" conflicts and "),
            s("missing"), F.lit(" missing items were found.")))
    )
    return decision, rationale


def evidence_rows(judged: DataFrame) -> DataFrame:
    """One row per check, ``ev_pos`` from 0."""
    return judged.select(
        "patient_id", "trial_id", F.posexplode("evidence").alias("ev_pos", "e")
    ).select("patient_id", "trial_id", "ev_pos", "e.criterion", "e.status", "e.detail")


def condition_links(patients: DataFrame, trials: DataFrame, gram: int = 4) -> DataFrame:
    """Which distinct diagnoses match which distinct condition names.

    Works on the two vocabularies and only with equi-joins: a shared identifying word, or
    containment found through character grams (a contained text of ``gram`` letters or more
    shares its first gram with the container; a shorter one is itself a gram).  Join the
    result back on the names to get compatible pairs; no record is compared with every other.
    """
    dx = (patients.filter(X.blank_to_null("diagnosis").isNotNull())
          .select(X.norm_key("diagnosis").alias("dx")).distinct()
          .withColumn("dx_tokens", disease_tokens(F.col("dx"))))
    cond = (trials.select(F.explode("conditions").alias("raw"))
            .select(X.norm_key("raw").alias("cond")).distinct()
            .withColumn("cond_tokens", disease_tokens(F.col("cond"))))
    by_word = (dx.select("dx", F.explode("dx_tokens").alias("w"))
               .join(cond.select("cond", F.explode("cond_tokens").alias("w")), "w")
               .select("dx", "cond"))

    def anchor(c):
        return F.substring(c, 1, gram)

    def grams(c):
        at = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))
        return F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(
            F.sequence(F.lit(1), F.lit(gram)), lambda n: F.substring(c, i, n)))))

    def inside(small, big, s, b):
        left = small.select(s, anchor(F.col(s)).alias("g"))
        right = big.select(b, F.explode(grams(F.col(b))).alias("g"))
        return (left.join(right, "g").filter(F.contains(F.col(b), F.col(s)))
                .select("dx", "cond"))

    return (by_word.unionByName(inside(cond, dx, "cond", "dx"))
            .unionByName(inside(dx, cond, "dx", "cond")).distinct())


def note_marker_matches(observed: Column, required: Column) -> Column:
    """The note evaluator's looser biomarker rule."""
    o, r = X.norm_text(observed), X.norm_text(required)
    return (
        F.when(r.isin("", "none"), F.lit(True))
        .when(r == "positive", ~o.isin("negative", "not detected", "wild type"))
        .when(r == "negative", o.isin("negative", "not detected", "wild type"))
        .otherwise(F.contains(o, r) | F.contains(r, o))
    )


def recruiting_only(trials: DataFrame, statuses=K.RECRUITING) -> DataFrame:
    """Trials in an accepted status; a missing status passes."""
    s = F.nullif(F.col("status"), F.lit(""))
    return trials.filter(s.isNull() | F.upper(s).isin(list(statuses)))
