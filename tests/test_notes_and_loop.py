"""Notes, protocol text and the two-phase loop."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cohortlens import schemas as S
from cohortlens.functions import notes as N
from cohortlens.functions import protocol as P
from cohortlens.operators import criteria as C
from cohortlens.operators import note_matching as NM
from cohortlens.operators import questions as Q
from cohortlens.operators import registry as G
from cohortlens.plans import two_phase as L
from cohortlens.sources import readers

from . import fixtures as X


def test_topics_are_inferred(spark, tmp_path):
    path = tmp_path / "topics.json"
    path.write_text(json.dumps({"topics": [
        {"num": k, "title": v[0]} for k, v in X.TOPIC_NOTES.items()] + [{"title": "No id."}]}))
    rows = readers.patients_from_topics(readers.read_topics(spark, str(path))).collect()
    got = {r.patient_id: (r.age, r.sex, r.diagnosis) for r in rows}
    want = {k: v[1:] for k, v in X.TOPIC_NOTES.items()}
    assert {k: got[k] for k in want} == want
    assert got["7"] == (None, None, None)


def test_note_round_trip(spark):
    p = X.patients(spark).withColumn("note", N.render_note("patient_pos"))
    facts = {r.patient_id: r for r in N.extract_facts(p).collect()}
    for row in X.PATIENTS:
        f = facts[row["patient_id"]]
        # a diagnosis is only read when stage or ECOG follows it directly
        dx = row["diagnosis"] if row["stage"] else None
        assert (f.age, f.sex, f.diagnosis, f.stage, f.ecog) == (
            row["age"], row["sex"], dx, row["stage"], row["ecog"])
        assert f.location == row["location"]
        known = {k: v for k, v in row["flags"].items() if k in N.K.CANONICAL_FLAGS}
        assert f.flags == known
    notes = {r.patient_id: r.note for r in p.collect()}
    assert notes["SYN-001"].startswith(
        "Oncology referral note: SYN-001 is a 62-year-old female with metastatic non-small cell "
        "lung cancer. Stage is recorded as IV. ECOG performance status is 1. Molecular testing "
        "shows EGFR L858R, ALK negative, PD-L1 60%. Prior therapy includes platinum "
        "chemotherapy. No untreated brain metastases is reported.")
    assert notes["SYN-002"].startswith("Tumor board intake: SYN-002")
    assert facts["SYN-001"].biomarkers == {"EGFR": "L858R", "ALK": "negative"}
    assert facts["SYN-001"].prior_treatments == {"prior_platinum_chemotherapy": True}
    assert facts["SYN-002"].prior_treatments == {}


def test_overlay_keeps_given_values_and_prefers_the_note(spark):
    p = X.patients(spark).withColumn("note", N.render_note("patient_pos")).filter(
        "patient_id = 'SYN-006'")
    given = p.select("patient_id", F.lit(40).alias("age"), F.lit(None).cast("string").alias("sex"),
                     F.lit("").alias("diagnosis"), F.lit(None).cast("string").alias("stage"),
                     F.lit(None).cast("int").alias("ecog"),
                     F.expr("map('MSI','x','ZZ','1')").alias("biomarkers"),
                     F.array(F.lit("oxaliplatin"), F.lit("other")).alias("prior_treatments"),
                     F.expr("map('organ_transplant', true)").alias("flags"), "note")
    r = N.overlay_note_facts(given).first()
    assert (r.age, r.sex, r.diagnosis, r.stage, r.ecog) == (
        40, "female", "metastatic colorectal cancer", "IV", 1)
    assert r.biomarkers == {"ZZ": "1", "MSI": "MSI-H", "KRAS": "wild type"}
    assert r.prior_treatments == ["oxaliplatin", "other", "fluoropyrimidine"]
    assert r.flags == {"active_autoimmune_disease": False, "organ_transplant": False}


def test_study_normalization(spark):
    df = X.rows_json(spark, [{"study": X.STUDY}, {"study": X.PLAIN_STUDY}], f"study {S.STUDY}")
    rows = {r.trial_id: r for r in G.normalize_studies(df).collect()}
    a, b = rows["NCT123"], rows["NCT456"]
    assert (a.min_age, a.max_age, a.sex, a.phase, a.enrollment) == (18, 80, "all", "PHASE2", 40)
    assert a.allowed_stages == ["IV"] and a.max_ecog == 2
    assert a.required_biomarkers == {"EGFR": "exon19del"}
    assert a.excluded_flags == ["untreated_brain_metastases", "active_interstitial_lung_disease"]
    assert a.required_patient_fields == ["diagnosis", "stage", "ecog", "biomarkers"]
    assert len(a.inclusion_criteria) == 3 and len(a.exclusion_criteria) == 2
    assert b.required_patient_fields == ["diagnosis"] and b.max_age is None
    assert a.conditions == ["Non-Small Cell Lung Cancer"]
    merged = {r.trial_id: r for r in G.normalize_studies(df, merge_biomarkers=True).collect()}
    assert merged["NCT123"].required_biomarkers == {"EGFR": "L858R_or_exon19del"}


def test_quota_selection(spark):
    def page(cond, no, *ids):
        return {"condition": cond, "page_no": no, "studies": [
            {"protocolSection": {"identificationModule": {"nctId": i.split(":")[0]},
                                 "statusModule": {"overallStatus": (i.split(":") + [""])[1]}}}
            for i in ids]}
    pages = X.rows_json(spark, [
        page("lung", 0, "N1", "N2:COMPLETED", "N3"), page("lung", 1, "N4", "N5"),
        page("skin", 0, "N1", "N5", "N6:recruiting"), page("skin", 1, "N7", "N8")],
        f"condition STRING, page_no INT, studies ARRAY<{S.STUDY}>")
    got = [(r.condition_no, r.trial_id) for r in G.select_studies(
        pages, ["lung", "skin"], 5).orderBy("condition_no", "page_no", "pos").collect()]
    # quota 3 each, 5 overall: N5 had no room under lung and is taken by skin
    assert got == [(0, "N1"), (0, "N3"), (0, "N4"), (1, "N5"), (1, "N6")]


@pytest.mark.parametrize("seed", range(3))
def test_conditions_choose_in_rounds_as_one_after_the_other(spark, seed):
    rnd = random.Random(seed)
    names = ["a", "b", "c", "d"]
    lists = {c: [f"N{rnd.randrange(18)}" for _ in range(rnd.randrange(20))] for c in names}
    pages = X.rows_json(spark, [
        {"condition": c, "page_no": i // 6, "studies": [{"protocolSection": {
            "identificationModule": {"nctId": n}}} for n in lists[c][i:i + 6]]}
        for c in names for i in range(0, len(lists[c]), 6)] + [
            {"condition": "other", "page_no": 0, "studies": []}],
        f"condition STRING, page_no INT, studies ARRAY<{S.STUDY}>")
    limit = (7, 14, 40)[seed]
    want, taken = [], set()
    for no, c in enumerate(names):
        mine = [n for n in dict.fromkeys(lists[c]) if n not in taken][:min(-(-limit // 4), limit - len(want))]
        taken.update(mine)
        want += [(no, n) for n in mine]
    got = G.select_studies(pages, names, limit).orderBy("condition_no", "page_no", "pos")
    assert [(r.condition_no, r.trial_id) for r in got.collect()] == want


def test_scalar_rules(spark):
    ages = ["6 Months", "18 Months", "3 Weeks", "N/A", "18 Years", "", "30 Days"]
    df = spark.createDataFrame([(a,) for a in ages], "a STRING")
    assert [r[0] for r in df.select(P.age_years("a")).collect()] == [0, 2, 0, None, 18, None, 0]
    t = spark.createDataFrame([(
        "Adults &ge; 18 &amp; HbA1c ≤ 7– 8%\t oké",)], "t STRING")
    assert t.select(P.clean_text("t")).first()[0] == "Adults >= 18 & HbA1c <= 7- 8% ok"
    lines = ("pre line\nINCLUSION CRITERIA:\n- aaaa\n* b\n\n  cccc \nExclusion criteria (all)\n"
             "dddd\r\neeee\nInclusion criteria and exclusion criteria\nffff")
    s = spark.createDataFrame([(lines,)], "t STRING").select(
        P.section_lines("t").alias("s")).select("s.*").first()
    assert s.inclusion == ["pre line", "aaaa", "cccc", "ffff"]
    assert s.exclusion == ["dddd", "eeee"]
    n = spark.createDataFrame([
        ("no known organ transplant",), ("organ transplant was absent",),
        ("no fever. organ transplant",)], "t STRING")
    assert [r[0] for r in n.select(N.negated("t", "organ transplant")).collect()] == [
        True, True, False]
    b = spark.createDataFrame([
        ("No EGFR mutation allowed",), ("EGFR mutation",), ("KRAS wild-type",)], "t STRING")
    assert [r[0] for r in b.select(P.required_biomarkers("t")).collect()] == [
        {}, {"EGFR": "positive"}, {"KRAS": "wild type"}]


def test_criteria_rows_and_fields(spark):
    crit = C.parsed_rules(C.derive_criteria(X.trials(spark))).filter(
        "trial_id = 'NCT-SAMPLE-003'").orderBy("criterion_pos").collect()
    assert [(r.criterion_id[15:], r.field, r.operator) for r in crit] == [
        ("I-condition", "condition", "matches"), ("I-age", "age", "within_range"),
        ("I-stage", "stage", "matches"), ("I-ecog", "ecog", "<="),
        ("I-biomarker-her2", "biomarker_her2", "matches"),
        ("I-prior-trastuzumab", "prior_trastuzumab", "must_be_present"),
        ("E-uncontrolled-cardiac-disease", "flag_uncontrolled_cardiac_disease",
         "must_be_absent")]
    assert json.loads(crit[1].structured_json) == {"min_age": 18, "max_age": None}
    assert json.loads(crit[4].structured_json) == {"HER2": "positive"}
    old = C.parsed_rules(C.derive_criteria(X.trials(spark)), compat=True).filter(
        "trial_id = 'NCT-SAMPLE-003'").orderBy("criterion_pos").collect()
    # the loose rules read 'age' in 'stage' and lose the marker and the treatment
    assert [r.field for r in old] == [
        "condition", "age", "age", "ecog", "biomarker_required", "raw",
        "flag_uncontrolled_cardiac_disease"]
    fam = C.derive_criteria(X.trials(spark)).select(
        C.criterion_family("criterion_id", "criterion_type").alias("f")).distinct().collect()
    assert {r.f for r in fam} == {"condition", "age", "stage", "ecog", "biomarker",
                                  "prior_treatment", "exclusion_flag"}
    v = C.typed(C.derive_criteria(X.trials(spark))).withColumn(
        "field", C.protocol_field("criterion_id", "criterion", r"^NCT-SAMPLE-\d+-[IE]-(.+)"))
    ops = {r.field: r.op for r in v.filter("trial_id = 'NCT-SAMPLE-003'").select(
        "field", C.protocol_operator("field", "criterion_type", "structured_value").alias("op")
    ).collect()}
    assert ops["age"] == "range" and ops["stage"] == "one_of" and ops["ecog"] == "equals"
    assert ops["uncontrolled_cardiac_disease"] == "must_be_absent"


def _answers(spark, *rows):
    return spark.createDataFrame(
        [("SYN-TEST-ANSWER-001", i, q, a, None) for i, (q, a) in enumerate(rows)],
        "patient_id STRING, ans_pos INT, question_id STRING, answer STRING, source STRING")


def test_answer_turns_uncertain_into_eligible(spark):
    q1 = "SYN-TEST-ANSWER-001-Q01"
    rec = X.records(spark)
    for compat in (False, True):
        loop = L.run_loop(rec, _answers(spark, (q1, "ECOG performance status is 1."), (q1, " "),
                                        ("other", "ECOG is 4.")), compat=compat)
        e = {r.phase: r for r in loop["assessed"].collect()}
        assert (e["initial"].eligibility, e["final"].eligibility) == ("uncertain", "eligible")
        assert e["initial"].related_question_ids == [q1]
        assert [r.question for r in loop["questions"].collect()] == [
            "What is the patient's ECOG performance status?"]
        out = L.nest_records(rec, loop).first().final_output
        assert out.recommended_trials[0].trial_id == "NCTTEST001"
        assert out.recommended_trials[0].rank == 1
        assert [a.question_id for a in out.simulated_patient_answers] == [q1]
        assert out.patient_level_summary == (
            "Recommended eligible trial ids after final matching: NCTTEST001.")
        assert "counts={'not_applicable': 0, 'satisfied': 4, 'unknown': 0, 'violated': 0}" in (
            e["final"].explanation)


def test_answers_never_undo_a_violation(spark):
    loop = L.run_loop(X.records(spark), _answers(
        spark, ("SYN-TEST-ANSWER-001-Q01", "ECOG is 4. Stage III now.")))
    final = {r.criterion_id[13:]: r.status for r in
             loop["judgments"].filter("phase = 'final'").collect()}
    assert final == {"condition": "satisfied", "age": "satisfied", "stage": "violated",
                     "ecog": "violated"}


def test_later_answers_override(spark):
    a = _answers(spark, ("q", "ECOG is 1"), ("q", "ecog performance status = 3"),
                 ("q", "no organ transplant"), ("q", "organ transplant in 2020"),
                 ("q", "stage 4"), ("q", "had prior platinum"))
    r = Q.answer_facts(a).first()
    assert (r.a_ecog, r.a_stage, r.a_platinum, r.a_organ_transplant) == (3, "IV", True, True)


def test_old_and_new_field_rules_differ_where_known(spark):
    facts = N.extract_facts(X.patients(spark).withColumn("note", N.render_note("patient_pos")))
    crit = C.typed(C.derive_criteria(X.trials(spark))).join(
        X.pairs(spark), "trial_id").select("patient_id", "trial_id", "criterion_pos",
                                           "criterion_id", "criterion_type", "criterion",
                                           "structured_value")
    new = NM.judge_criteria(facts, crit).filter("patient_id = 'SYN-001'")
    old = NM.judge_criteria(facts, crit, compat=True).filter("patient_id = 'SYN-001'")
    n = {r.criterion_id[4:]: r.status for r in new.collect()}
    o = {r.criterion_id[4:]: r.status for r in old.collect()}
    assert n["SAMPLE-001-I-biomarker-egfr"] == "satisfied"
    assert o["SAMPLE-001-I-biomarker-egfr"] == "unknown"
    assert o["SAMPLE-001-I-stage"] == "satisfied" and n["SAMPLE-001-I-stage"] == "satisfied"
    assert o["SAMPLE-003-I-prior-trastuzumab"] == "unknown"
    grouped, _ = Q.follow_up_questions(new)
    lost, _ = Q.follow_up_questions(old, compat=True)
    assert "organ_transplant" in {r.field for r in grouped.collect()}
    assert "raw" in {r.field for r in lost.collect()}


def test_model_questions_find_their_criteria(spark):
    q = spark.createDataFrame([
        ("p", "q1", "What is the current ECOG?"), ("p", "q2", "Any organ transplant?"),
        ("p", "q3", "Do you have lymphoma?"), ("p", "q4", "renal biopsy kidney result?"),
        ("p", "q5", "creatinine value?"), ("p", "q6", "hello?")],
        "patient_id STRING, question_id STRING, question STRING")
    crit = spark.createDataFrame([
        ("p", "T1", "T1-I-ecog", "", "", "unknown", "x"),
        ("p", "T1", "T1-E-organ-transplant", "", "", "satisfied", "x"),
        ("p", "T2", "T2-I-lab", "", "", "unknown", "creatinine is not known")],
        "patient_id STRING, trial_id STRING, criterion_id STRING, criterion STRING, "
        "value_text STRING, status STRING, reason STRING")
    t = spark.createDataFrame([("p", "T1", "B-cell lymphoma"), ("p", "T2", "Renal biopsy study")],
                              "patient_id STRING, trial_id STRING, title_text STRING")
    got = {r.question_id: (r.trial_id, r.criterion_id, r.tier)
           for r in Q.attach_questions(q, crit, t).collect()}
    assert got == {"q1": ("T1", "T1-I-ecog", 2), "q2": ("T1", "T1-E-organ-transplant", 3),
                   "q3": ("T1", "", 4), "q4": ("T2", "", 4), "q5": ("T2", "T2-I-lab", 5)}


def test_collected_questions_and_answers(spark):
    q = spark.createDataFrame([
        ("p", 1, None, "Age?", "r1", None), ("p", 2, "p-Q09", "Stage?", None, None),
        ("p", 3, "x", " age? ", "r3", "late")],
        "patient_id STRING, pos INT, question_id STRING, question STRING, reason STRING, "
        "source STRING")
    qs = Q.collect_questions(q)
    got = [(r.pos, r.question_id, r.reason, r.source) for r in qs.orderBy("pos").collect()]
    assert got == [(1, "x", "r3", "late"), (2, "p-Q09", "", "agent_trace")]
    a = spark.createDataFrame([
        ("p", 1, "", "one", None), ("p", 2, None, "two", None), ("p", 3, "p-Q09", "TWO", None),
        ("p", 4, "", "four", None), ("p", 5, "p-Q09", "two ", None)],
        "patient_id STRING, pos INT, question_id STRING, answer STRING, source STRING")
    ans = Q.collect_answers(a, qs)
    assert [(r.question_id, r.answer) for r in ans.orderBy("pos").collect()] == [
        ("x", "one"), ("p-Q09", "two"), ("p-Q04", "four")]
    full = Q.placeholder_questions(qs, ans).orderBy("order_key", "question_id").collect()
    assert [r.question_id for r in full] == ["p-Q04", "p-Q09", "x"]
    assert full[0].source == "answer_only_repair"
