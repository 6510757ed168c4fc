"""Notes, facts, note-based judging, questions and answers over the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as X
from ..functions import notes as N
from ..operators import criteria as C
from ..operators import evaluation as E
from ..operators import note_matching as NM
from ..operators import questions as Q
from ..operators import rollup as U
from ..session import broadcast_if_small, spread
from . import roles
from . import roles_sql as S
from .registry import Registry

QUERIES = Registry()
PAIR = ["patient_id", "trial_id"]


def facts(spark, sf_dir):
    return N.extract_facts(roles.notes(spark, sf_dir))


def answers(spark, sf_dir):
    return answer_rows(roles.table(spark, sf_dir, "events"))


def answer_rows(events):
    """Events read as answers of the customer with the same number."""
    e = F.col("event_id")
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.concat(
            F.lit("ECOG performance status is "), (e % 6).cast("string"), F.lit(".")))
        .when(kind == "view", F.when(e % 2 == 0, "Now stage IV disease.")
              .otherwise("It is stage 3."))
        .when(kind == "error", "There is no organ transplant history.")
        .when(kind == "signup", F.concat(
            F.lit("Had prior platinum in "), (e % 24 + 2000).cast("string"), F.lit(".")))
        .otherwise("An active autoimmune disease was found.")
    )
    return events.select(
        F.concat(F.lit("P"), X.padded(F.col("user_id"), 12))
        .alias("patient_id"), text.alias("answer"), F.struct("ts", "event_id").alias("ans_pos"))


def trial_criteria(spark, sf_dir, rules=("new",)):
    """The criteria of every trial as one array, prepared once for each set of field rules."""
    crit = C.typed(C.derive_criteria(spread(roles.trials(spark, sf_dir)))).drop("structured_json")
    prepared = [NM.prepare_criteria(crit, compat=r == "old").withColumn("rules", F.lit(r))
                for r in rules]
    return NM.criteria_of_trials(reduce(lambda a, b: a.unionByName(b), prepared))


def patient_phases(spark, sf_dir, phases=("initial", "final")):
    """A patient's facts of every phase as one array."""
    f = facts(spark, sf_dir)
    if "final" in phases:
        f = Q.apply_answers(f.withColumn("before", F.struct(*NM.FACTS)), answers(spark, sf_dir))
    at = {"initial": "before." if "final" in phases else "", "final": ""}
    return f.select("patient_id", F.array(*[
        F.struct(F.lit(p).alias("phase"), *NM.prepared_facts(at[p])) for p in phases])
        .alias("phases"))


def judgments(spark, sf_dir, *, rules=("new",), phases=("initial", "final"), by_pair=False):
    """Verdicts over the ordered pairs: one scan of the pairs for all rules and phases.

    ``by_pair``: what follows groups by pair, so the pairs are dealt by it while they are narrow, if
    both sides are broadcast; else the verdicts lie by trial.
    """
    pairs = roles.pair_columns(spark, sf_dir)
    facts_of = broadcast_if_small(patient_phases(spark, sf_dir, phases),
                                  counted=roles.table(spark, sf_dir, "customer"))
    criteria = broadcast_if_small(trial_criteria(spark, sf_dir, rules),
                                  counted=roles.table(spark, sf_dir, "part"))
    return NM.judge_trials(pairs.repartition(*PAIR) if by_pair else pairs, facts_of, criteria)


def part():
    return C.criterion_suffix("criterion_id", "trial_id").alias("part")


def bool_text(c):
    return F.coalesce(c.cast("string"), F.lit("?"))


@QUERIES.add("note_facts", "NRM-05 NRM-19 NRM-20 NRM-22 NRM-27",
             S.with_roles(S.NOTES, S.FACTS) + """
SELECT patient_id, md5(note) AS note_md5, age, sex, diagnosis, stage, ecog, b_egfr AS egfr,
  b_alk AS alk, b_her2 AS her2, state,
  concat_ws('|', coalesce(platinum::VARCHAR, '?'),
    coalesce(f_active_autoimmune_disease::VARCHAR, '?'),
    coalesce(f_uncontrolled_cardiac_disease::VARCHAR, '?'),
    coalesce(f_organ_transplant::VARCHAR, '?'),
    coalesce(f_active_interstitial_lung_disease::VARCHAR, '?')) AS known,
  CASE WHEN concat_ws('', age, sex, diagnosis, stage, ecog) = ''
    THEN 'No core patient facts were deterministically extracted.'
    ELSE concat_ws(', ', 'age=' || age, 'sex=' || sex, 'diagnosis=' || diagnosis,
      'stage=' || stage, 'ecog=' || ecog) END AS summary
FROM facts""")
def note_facts(spark, sf_dir):
    f = facts(spark, sf_dir)
    at = lambda m, k: F.try_element_at(m, F.lit(k))
    return f.select(
        "patient_id", F.md5("source_note").alias("note_md5"), "age", "sex", "diagnosis", "stage",
        "ecog", *[at("biomarkers", m).alias(m.lower()) for m in ("EGFR", "ALK", "HER2")],
        at("location", "state").alias("state"),
        F.concat_ws("|", bool_text(at("prior_treatments", "prior_platinum_chemotherapy")),
                    *[bool_text(at("flags", n)) for n in (
                        "active_autoimmune_disease", "uncontrolled_cardiac_disease",
                        "organ_transplant", "active_interstitial_lung_disease")])
        .alias("known"), N.fact_summary().alias("summary"))


@QUERIES.add("note_overlay", "NRM-21", S.with_roles(S.NOTES) + """,
listed AS (SELECT p.*, n.note, nullif(regexp_extract(note,
    '(?i)Molecular testing shows\\s+([^.]*)\\.', 1), '') AS body FROM patients p
  JOIN notes n USING (patient_id))
SELECT patient_id, coalesce(nullif(regexp_extract(note,
    '(?i)\\bwith\\s+([^.;]+?)(?:\\.| Stage| No formal stage)', 1), ''), '') AS diagnosis,
  coalesce(nullif(regexp_extract(note, '(?i)\\b(\\d{2,3})-year-old\\s+(female|male)\\b', 1),
    '')::INT, -1) AS age,
  CASE WHEN contains(body, 'EGFR exon19del') THEN 'exon19del'
    WHEN contains(body, 'EGFR negative') THEN 'negative' ELSE 'given' END AS egfr,
  array_to_string(prior_treatments, ',') AS prior,
  coalesce(flags['organ_transplant']::VARCHAR, 'true') AS transplant
FROM listed""")
def note_overlay(spark, sf_dir):
    given = roles.notes(spark, sf_dir).select(
        "patient_id", "note", F.lit(None).cast("int").alias("age"),
        F.lit(None).cast("string").alias("sex"), F.lit("").alias("diagnosis"),
        F.lit(None).cast("string").alias("stage"), F.lit(None).cast("int").alias("ecog"),
        F.create_map(F.lit("EGFR"), F.lit("given")).alias("biomarkers"),
        "prior_treatments",
        F.create_map(F.lit("organ_transplant"), F.lit(True)).alias("flags"))
    o = N.overlay_note_facts(given)
    return o.select(
        "patient_id", F.coalesce("diagnosis", F.lit("")).alias("diagnosis"),
        F.coalesce("age", F.lit(-1)).alias("age"),
        F.try_element_at("biomarkers", F.lit("EGFR")).alias("egfr"),
        F.array_join("prior_treatments", ",").alias("prior"),
        F.try_element_at("flags", F.lit("organ_transplant")).cast("string").alias("transplant"))


@QUERIES.add("criteria_rows", "CRT-01 CRT-02 CRT-03 CRT-04 CRT-05",
             S.with_roles(S.CRITERIA) + """
SELECT trial_id || '-' || part AS criterion_id, ctype AS criterion_type, criterion,
  CASE WHEN ctype = 'exclusion' THEN 'flag_' || name
    WHEN part LIKE 'I-prior-%' THEN 'prior_' || replace(name, ' ', '_')
    WHEN need IS NOT NULL THEN 'biomarker_' || lower(name) ELSE substr(part, 3) END AS field,
  CASE WHEN ctype = 'exclusion' THEN 'must_be_absent' WHEN part LIKE 'I-prior-%'
    THEN 'must_be_present' WHEN part = 'I-age' THEN 'within_range' WHEN part = 'I-ecog' THEN '<='
    ELSE 'matches' END AS operator,
  CASE WHEN ctype = 'exclusion' THEN 'exclusion_flag' WHEN part LIKE 'I-prior-%'
    THEN 'prior_treatment' WHEN need IS NOT NULL THEN 'biomarker' ELSE substr(part, 3) END
    AS family,
  (row_number() OVER (PARTITION BY trial_id ORDER BY criterion_pos) - 1)::INT AS criterion_pos
FROM criteria""")
def criteria_rows(spark, sf_dir):
    rules = C.parsed_rules(C.derive_criteria(roles.trials(spark, sf_dir)))
    return rules.select(
        "criterion_id", "criterion_type", "criterion", "field", "operator",
        C.criterion_family("criterion_id", "criterion_type").alias("family"), "criterion_pos")


@QUERIES.add("note_judgments", "PRD-11 PRD-12 JON-15 JON-16 QST-11", S.with_roles(*S.LOOP) + """
SELECT phase, rules, part, status, count(*) AS n, min(patient_id) AS first_patient,
  max(trial_id) AS last_trial FROM verdicts GROUP BY ALL""")
def note_judgments(spark, sf_dir):
    cols = ["phase", "rules", "part", "status"]
    rows = judgments(spark, sf_dir, rules=("new", "old")).withColumn("part", part())
    # ids are compared as the numbers they hold: texts would be sorted before they are aggregated
    number = lambda c: F.substr(F.col(c), F.lit(2)).cast("bigint")
    text = lambda kind, n: F.concat(F.lit(kind), X.padded(F.col(n), 12))
    out = rows.groupBy(*cols).agg(
        F.count(F.lit(1)).alias("n"), F.min(number("patient_id")).alias("first"),
        F.max(number("trial_id")).alias("last"))
    return out.select(*cols, "n", text("P", "first").alias("first_patient"),
                      text("T", "last").alias("last_trial"))


@QUERIES.add("answered_facts", "QST-06", S.with_roles(*S.LOOP) + """
SELECT patient_id, stage, ecog, coalesce(platinum::VARCHAR, '?') AS platinum,
  coalesce(f_organ_transplant::VARCHAR, '?') AS transplant,
  coalesce(f_active_autoimmune_disease::VARCHAR, '?') AS autoimmune
FROM facts_both WHERE phase = 'final'""")
def answered_facts(spark, sf_dir):
    f = Q.apply_answers(facts(spark, sf_dir), answers(spark, sf_dir))
    at = lambda m, k: bool_text(F.try_element_at(m, F.lit(k)))
    return f.select(
        "patient_id", "stage", "ecog",
        at("prior_treatments", "prior_platinum_chemotherapy").alias("platinum"),
        at("flags", "organ_transplant").alias("transplant"),
        at("flags", "active_autoimmune_disease").alias("autoimmune"))


_FIELD = """CASE WHEN ctype = 'exclusion' THEN replace(substr(part, 3), '-', '_')
  WHEN part LIKE 'I-prior-%' THEN 'prior_' || replace(substr(part, 9), '-', '_')
  WHEN part LIKE 'I-biomarker-%' THEN 'biomarker_' || substr(part, 13)
  ELSE substr(part, 3) END"""
_ASKED = S.with_roles(*S.LOOP) + f""",
unknowns AS (SELECT patient_id, trial_id, part, {_FIELD} AS field FROM verdicts
  WHERE phase = 'initial' AND rules = 'new' AND status = 'unknown'),
asked AS (SELECT patient_id, field, patient_id || '-Q' || lpad(no, greatest(2, length(no))::INT, '0')
    AS question_id
  FROM (SELECT patient_id, field, (row_number() OVER (PARTITION BY patient_id ORDER BY field))::VARCHAR
    AS no FROM (SELECT DISTINCT patient_id, field FROM unknowns)))
"""


@QUERIES.add("question_groups", "QST-03", _ASKED + """
SELECT patient_id, question_id, field, CASE field WHEN 'age' THEN 'What is the patient''s age?'
    WHEN 'condition' THEN 'What is the patient''s confirmed diagnosis?'
    WHEN 'ecog' THEN 'What is the patient''s ECOG performance status?'
    WHEN 'stage' THEN 'What is the patient''s current disease stage?'
    WHEN 'sex' THEN 'What sex is recorded for trial eligibility purposes?'
    WHEN 'prior_platinum_chemotherapy'
      THEN 'Has the patient received prior platinum chemotherapy?'
    ELSE CASE WHEN field LIKE 'biomarker_%'
        THEN 'What relevant biomarker or molecular test result is documented?'
      WHEN field LIKE 'prior_%' THEN 'Has the patient received ' || replace(field, '_', ' ') || '?'
      ELSE 'Does the patient have ' || replace(field, '_', ' ') || '?' END END AS question
FROM asked""")
def question_groups(spark, sf_dir):
    questions, _ = Q.follow_up_questions(judgments(spark, sf_dir, phases=("initial",)))
    return questions.select("patient_id", "question_id", "field", "question")


@QUERIES.add("question_links", "QST-03", _ASKED + """
SELECT patient_id, question_id, count(*) AS links, count(DISTINCT trial_id) AS trials,
  min(trial_id || '-' || part) AS first_criterion
FROM unknowns JOIN asked USING (patient_id, field) GROUP BY ALL""")
def question_links(spark, sf_dir):
    _, links = Q.follow_up_questions(judgments(spark, sf_dir, phases=("initial",)), stored=True)
    return links.groupBy("patient_id", "question_id").agg(
        F.count(F.lit(1)).alias("links"), F.count_distinct("trial_id").alias("trials"),
        F.min("criterion_id").alias("first_criterion"))


@QUERIES.add("loop_transitions", "QST-11 AGG-04 JON-10", S.with_roles(*S.LOOP, S.ROLLED) + """
SELECT a.eligibility AS initial, b.eligibility AS final, count(*) AS pairs,
  count(DISTINCT patient_id) AS patients FROM rolled a JOIN rolled b USING (patient_id, trial_id)
WHERE a.rules = 'new' AND b.rules = 'new' AND a.phase = 'initial' AND b.phase = 'final'
GROUP BY ALL""")
def loop_transitions(spark, sf_dir):
    rolled = U.roll_up(judgments(spark, sf_dir, by_pair=True), keys=(*PAIR, "phase"),
                       na_policy="accept")
    both = rolled.groupBy(*PAIR).agg(*[
        F.max(F.when(F.col("phase") == p, F.col("eligibility"))).alias(p)
        for p in ("initial", "final")])
    return both.groupBy("initial", "final").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_distinct("patient_id").alias("patients"))


# --- evaluation: the current rules as gold, the historic rules as prediction -----------------

def _sides(spark, sf_dir, phases=("final",)):
    """Statuses by the current and the historic rules, in every phase, side by side."""
    rows = judgments(spark, sf_dir, rules=("new", "old"), phases=phases, by_pair=True)
    is_ = lambda r, p: (F.col("rules") == r) & (F.col("phase") == p)
    names = {"gold": "new", "pred": "old"}
    return E.side_by_side(rows, [*PAIR, "criterion_id", "criterion_type"], "status", K.CRITERION_STATUS, {
        n if len(phases) == 1 else f"{n}_{p}": is_(r, p) for n, r in names.items() for p in phases})


_COMPARED = S.with_roles(*S.LOOP, S.ROLLED) + """,
compared AS (SELECT part, ctype, max(status) FILTER (rules = 'new') AS gold,
    max(status) FILTER (rules = 'old') AS pred FROM verdicts WHERE phase = 'final'
  GROUP BY patient_id, trial_id, part, ctype)
"""


@QUERIES.add("criterion_confusion", "JON-05 EVL-02", _COMPARED + """
SELECT gold, pred, count(*) AS n FROM compared GROUP BY ALL""")
def criterion_confusion(spark, sf_dir):
    return E.confusion(_sides(spark, sf_dir))


_R4 = S.round_exact


@QUERIES.add("label_prf", "EVL-03 AGG-14", _COMPARED + f""",
labels AS (SELECT unnest(['satisfied', 'violated', 'unknown', 'not_applicable']) AS label),
c AS (SELECT label, (SELECT count(*) FROM compared WHERE gold = label AND pred = label) AS tp,
    (SELECT count(*) FROM compared WHERE gold = label) AS support,
    (SELECT count(*) FROM compared WHERE pred = label) AS predicted FROM labels)
SELECT label, tp AS true_positive, support, predicted,
  CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE {_R4('tp / predicted', 4)} END AS precision,
  CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE {_R4('tp / support', 4)} END AS recall,
  CASE WHEN support + predicted = 0 THEN 0.0::DOUBLE
    ELSE {_R4('2 * tp / (support + predicted)', 4)} END AS f1 FROM c""")
def label_prf(spark, sf_dir):
    return E.label_scores(E.confusion(_sides(spark, sf_dir)), C.K.CRITERION_STATUS)


@QUERIES.add("accuracy_by_family", "EVL-04 CRT-05", _COMPARED + f""",
f AS (SELECT CASE WHEN ctype = 'exclusion' THEN 'exclusion_flag' WHEN part LIKE 'I-prior-%'
    THEN 'prior_treatment' WHEN part LIKE 'I-biomarker-%' THEN 'biomarker'
    ELSE substr(part, 3) END AS family, count(*) FILTER (gold = pred) AS correct,
    count(*) AS total FROM compared GROUP BY 1)
SELECT family, correct, total, {_R4('correct / total', 4)} AS accuracy FROM f""")
def accuracy_by_family(spark, sf_dir):
    return E.family_accuracy(_sides(spark, sf_dir))


@QUERIES.add("transition_accuracy", "JON-06 EVL-05", S.with_roles(*S.LOOP) + f""",
w AS (SELECT part, max(status) FILTER (rules = 'new' AND phase = 'initial') AS gi,
    max(status) FILTER (rules = 'new' AND phase = 'final') AS gf,
    max(status) FILTER (rules = 'old' AND phase = 'initial') AS pi,
    max(status) FILTER (rules = 'old' AND phase = 'final') AS pf
  FROM verdicts GROUP BY patient_id, trial_id, part),
c AS (SELECT part, count(*) FILTER (gi = pi AND gf = pf) AS exact, count(*) AS total,
    count(*) FILTER (gi <> gf AND gi = pi AND gf = pf) AS changed_exact,
    count(*) FILTER (gi <> gf) AS changed_total FROM w GROUP BY part)
SELECT *, {_R4('exact / total', 4)} AS accuracy, CASE WHEN changed_total = 0 THEN 0.0::DOUBLE
    ELSE {_R4('changed_exact / changed_total', 4)} END AS changed_accuracy FROM c""")
def transition_accuracy(spark, sf_dir):
    rows = _sides(spark, sf_dir, ("initial", "final"))
    return E.transition_accuracy(rows.withColumn("part", part()), ["part"])


@QUERIES.add("recommendation_sets", "EVL-06 SET-02 SET-05 SET-06",
             S.with_roles(*S.LOOP, S.ROLLED) + f""",
sides AS (SELECT patient_id, trial_id, bool_or(rules = 'new' AND eligibility = 'eligible') AS g,
    bool_or(rules = 'old' AND eligibility = 'eligible') AS p FROM rolled WHERE phase = 'final'
  GROUP BY ALL),
per AS (SELECT patient_id, count(*) FILTER (g) AS gold, count(*) FILTER (p) AS pred,
    count(*) FILTER (g AND p) AS hit FROM sides GROUP BY patient_id),
t AS (SELECT count(*) FILTER (hit = gold AND hit = pred) AS exact_match, count(*) AS total,
    sum(gold)::BIGINT AS gold, sum(pred)::BIGINT AS pred, sum(hit)::BIGINT AS hit FROM per)
SELECT *, {_R4('exact_match / total', 4)} AS accuracy,
  CASE WHEN pred = 0 THEN 0.0::DOUBLE ELSE {_R4('hit / pred', 4)} END AS precision,
  CASE WHEN gold = 0 THEN 0.0::DOUBLE ELSE {_R4('hit / gold', 4)} END AS recall,
  CASE WHEN gold + pred = 0 THEN 0.0::DOUBLE ELSE {_R4('2 * hit / (gold + pred)', 4)} END AS f1
FROM t""")
def recommendation_sets(spark, sf_dir):
    rows = judgments(spark, sf_dir, rules=("new", "old"), phases=("final",), by_pair=True)
    rolled = U.roll_up(rows, keys=(*PAIR, "rules"), na_policy="accept")
    sides = E.side_by_side(rolled, PAIR, "eligibility", K.ELIGIBILITY, {
        n: F.col("rules") == r for n, r in (("gold", "new"), ("pred", "old"))})
    return E.set_scores(E.flag_overlap(sides, ["patient_id"], F.col("gold") == "eligible",
                                       F.col("pred") == "eligible"))
