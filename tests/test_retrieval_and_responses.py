"""Retrieval against brute force, responses, labels and evaluation."""

import json
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from cohortlens import schemas as S
from cohortlens.functions import jsontext as J
from cohortlens.operators import audit as A
from cohortlens.operators import criteria as C
from cohortlens.operators import evaluation as E
from cohortlens.operators import responses as R
from cohortlens.operators import retrieval as T
from cohortlens.operators import summaries as U
from cohortlens.plans import recommend as P
from cohortlens.plans import two_phase as L
from cohortlens.session import written

from . import fixtures as X


def _brute(chunks, queries, k):
    """Chunk scores summed per trial, in input order on ties."""
    df = Counter(t for _, toks in chunks for t in set(toks))
    n = len(chunks)
    out = {}
    for q, text in queries.items():
        qc = Counter(re.findall("[a-z0-9]{2,}", text))
        total = {}
        for tid, toks in chunks:
            tc = Counter(toks)
            s = sum(c * tc[t] * round(math.log(1 + (n + 1) / (df[t] + 1)) * 1e9)
                    for t, c in qc.items() if t in tc)
            if s:
                total[tid] = total.get(tid, 0) + s
        out[q] = sorted(total.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def test_pruned_and_plain_retrieval_equal_brute_force(spark):
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    chunks, rows = [], []
    for tid in range(60):
        for c in range(tid % 3 + 1):
            # 'alpha' is in nearly every chunk, some trials repeat it very often
            toks = ["alpha"] * (1 + (tid * 7) % 11) + [words[(tid + c * 3 + i) % 8]
                                                       for i in range(tid % 5)]
            chunks.append((tid, toks))
            rows.append((tid, tid, c, "s", toks))
    queries = {1: "alpha beta", 2: "gamma gamma alpha eps", 3: "zeta", 4: "missing"}
    df = spark.createDataFrame(
        rows, "trial_id INT, trial_pos INT, chunk_pos INT, section STRING, tokens ARRAY<STRING>")
    q = spark.createDataFrame(list(queries.items()), "query_id INT, text STRING")
    postings, stats = T.build_postings(df)
    want = {(qid, i + 1): row for qid, found in _brute(chunks, queries, 5).items()
            for i, row in enumerate(found)}
    for options in ({"prune": False}, {"prune": True, "champions": 2},
                    {"prune": True, "champions": 40}, {}):
        got = {(r.query_id, r.retrieval_rank): (r.trial_id, r.fixed_score)
               for r in T.retrieve(q, postings, stats, 5, **options).collect()}
        assert got == want, options


def test_candidates_context_and_pinned_target(spark):
    p = P.with_notes(X.patients(spark)).withColumn(
        "target_trial_id", F.when(F.col("patient_id") == "SYN-001", "NCT-SAMPLE-005")
        .when(F.col("patient_id") == "SYN-002", "NO-SUCH-TRIAL"))
    rows = T.candidates(p, X.trials(spark), 3, targets=True).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.retrieval_rank):
        by.setdefault(r.patient_id, []).append((r.trial_id, r.retrieval_score))
    assert by["SYN-001"][0] == ("NCT-SAMPLE-005", 1.0) and len(by["SYN-001"]) == 3
    assert by["SYN-001"][1][0] == "NCT-SAMPLE-001" and by["SYN-002"][0][0] == "NCT-SAMPLE-002"
    sections = T.trial_sections(X.trials(spark))
    chunks = T.index_tokens(sections)
    postings, stats = T.build_postings(chunks)
    q = p.filter("patient_id = 'SYN-001'").select(F.col("patient_id").alias("query_id"),
                                                  F.col("note").alias("text"))
    found = T.retrieve(q, postings, stats, 1)
    best = T.top_chunks(found, q, chunks, stats)
    text = T.context_blocks(found, best, sections).first().context
    assert text.startswith("--- NCT-SAMPLE-001 | RAG score ")
    assert "Title: Targeted Therapy" in text and "Top retrieved sections: " in text
    assert "Required biomarkers: EGFR must be L858R_or_exon19del." in text


def test_report_is_nested_per_patient(spark):
    rep = P.nest_report(P.report(X.patients(spark), X.trials(spark), k=5), X.patients(spark))
    r = {x.patient_id: x for x in rep.collect()}["SYN-006"]
    assert r.recommended_trial_order[0] == "NCT-SAMPLE-004"
    assert [x["rank"] for x in r.recommendations] == [1, 2, 3, 4, 5]
    assert json.loads(r.extracted_profile)["diagnosis"] == "metastatic colorectal cancer"
    flat = P.report(X.patients(spark), X.trials(spark), k=5).withColumn(
        "clinical_note", F.lit("n"))
    assert A.report_errors(flat).count() == 0
    assert A.report_errors(flat.withColumn("eligibility", F.lit("maybe"))).count() == 50


def test_json_ladder(spark):
    cases = {
        '{"a":1}': (True, False), '```json\n{"a":1}\n```': (True, False),
        '{"m":[{"t":"x",}],}': (True, True), 'so: {"a":1} ok': (True, True),
        "not json": (False, False), "": (False, False), "[1]": (False, False),
        '{"a":1} x': (True, True), '{"a":1}{"b":2}': (False, False),
        '{"a":1}}]': (False, False)}
    df = spark.createDataFrame([(t,) for t in cases], "t STRING")
    got = {r.t: (r.j.ok, r.j.repaired) for r in
           df.select("t", J.parse_object("t").alias("j")).collect()}
    assert got == cases
    err = df.select("t", J.parse_object("t").alias("j")).filter("t = ''").first().j.error
    assert err == "empty content"


def test_unusable_response_still_gives_a_complete_prediction(spark):
    rec = X.records(spark)
    raw = spark.createDataFrame([("SYN-TEST-ANSWER-001", "not json")],
                                "patient_id STRING, content STRING")
    out = R.normalize_responses(raw, C.expected_trials(rec), C.expected_criteria(rec))
    assert {(r.phase, r.eligibility) for r in out["assessed"].collect()} == {
        ("initial", "uncertain"), ("final", "uncertain")}
    assert {r.status for r in out["judgments"].collect()} == {"unknown"}
    a = {r.phase: r for r in out["audit"].collect()}["final"]
    assert (a.missing_trials_filled, a.missing_criteria_filled, a.raw_json_valid) == (1, 4, False)
    q = out["questions"].collect()
    assert [(r.question_id, r.source) for r in q] == [
        ("SYN-TEST-ANSWER-001-Q01", "structural_question_fallback")]
    assert out["question_links"].count() == 4


def test_inconsistent_label_is_corrected_and_counted(spark):
    rec = X.records(spark)
    status = ["satisfied", "satisfied", "not_applicable", "satisfied"]
    ids = [c["criterion_id"] for c in X.LOOP_RECORD["candidate_trials"][0]["criteria_to_assess"]]
    body = {"final_assessment_after_answers": {"evaluated_trials": [{
        "trial_id": "NCTTEST001", "eligibility": "eligible", "criterion_results": [
            {"criterion_id": i, "status": s, "reason": "r"} for i, s in zip(ids, status)]}]},
        "follow_up_questions": [
            {"question": "Why?", "needed_for": [{"trial_id": "NCTTEST001",
                                                 "criterion_id": ids[0]}]},
            {"question": "Lost?", "needed_for": [{"trial_id": "X", "criterion_id": "Y"}]}],
        "simulated_patient_answers": [
            {"question_id": "SYN-TEST-ANSWER-001-Q01", "response": "because"},
            {"question_id": "SYN-TEST-ANSWER-001-Q01", "answer": "again"},
            {"question_id": "zz", "answer": "no"}]}
    raw = spark.createDataFrame([("SYN-TEST-ANSWER-001", json.dumps(body))],
                                "patient_id STRING, content STRING")
    out = R.normalize_responses(raw, C.expected_trials(rec), C.expected_criteria(rec))
    final = out["assessed"].filter("phase = 'final'").first()
    assert (final.eligibility, final.corrected) == ("ineligible", True)
    assert [r.question for r in out["questions"].collect()] == ["Why?"]
    assert [(r.answer, r.kept) for r in out["answers"].orderBy("ans_pos").collect()] == [
        ("because", True), ("again", False), ("no", False)]


def test_labels_compared_with_themselves_agree(spark):
    judged = P.M.judge_pairs(X.pairs(spark), X.patients(spark), X.trials(spark))
    labels = R.baseline_labels(judged, C.derive_criteria(X.trials(spark))).withColumn(
        "rationale", F.lit(""))
    pairs = labels.select("pair_id", "patient_id", "trial_id", F.lit("s").alias("scenario"))
    s = E.agreement(pairs, labels, labels)["summary"].first()
    assert (s.pair_count, s.eligibility_agreement, s.criterion_status_agreement,
            s.disagreement_count) == (50, 1.0, 1.0, 0)
    # the rule-based label agrees with the decision wherever all evidence is listed
    best = labels.filter("pair_id = 'SYN-001__NCT-SAMPLE-001'").first()
    assert best.eligibility == "eligible"
    gone = R.fallback_labels(pairs, labels.filter("eligibility = 'eligible'"),
                             C.derive_criteria(X.trials(spark)))
    assert gone.count() == 50 - labels.filter("eligibility = 'eligible'").count()


def _prediction(spark):
    rec = X.records(spark)
    answers = spark.createDataFrame(
        [("SYN-TEST-ANSWER-001", 0, "SYN-TEST-ANSWER-001-Q01", "ECOG performance status is 1.",
          None)],
        "patient_id STRING, ans_pos INT, question_id STRING, answer STRING, source STRING")
    # predictions are a stored table by the time they are scored
    return written(L.nest_records(rec, L.run_loop(rec, answers)), "predictions")


def test_evaluation_of_a_record_against_itself(spark):
    p = _prediction(spark)
    t = E.evaluate(p, p)
    assert t["eligibility"].first().accuracy == 1.0
    assert t["criterion_status"].first().total == 4
    assert t["transition"].first().accuracy == 1.0
    assert t["transition"].first().changed_total == 1
    assert t["recommendation_set"].first().f1 == 1.0
    assert t["question_links"].first().gold == 1
    assert t["missing_extra"].count() == 0
    assert {r.family for r in t["criterion_by_family"].collect()} == {
        "condition", "age", "stage", "ecog"}
    labels = {r.label: (r.support, r.f1) for r in t["eligibility_labels"].collect()}
    assert labels == {"eligible": (1, 1.0), "ineligible": (0, 0.0), "uncertain": (0, 0.0)}
    assert t["eligibility_labels"].agg(E.macro_f1(t["eligibility_labels"])).first()[0] == 1.0
    assert A.contract_errors(p, p).count() == 0
    assert A.finalized_errors(p, p).count() == 0


def test_usage_aliases(spark):
    raw = [{"input_tokens": 120, "output_tokens": 30, "prompt_tokens_details": {
        "cached_tokens": 20}, "completion_tokens_details": {"reasoning_tokens": 5}},
        {"prompt_tokens": -1, "completion_tokens": "x"}, {"prompt_tokens": 1.5}]
    df = spark.createDataFrame([(json.dumps(r),) for r in raw], "t STRING")
    got = [r[0] for r in df.select(U.usage_of(F.parse_json("t"))).collect()]
    assert got == [{"prompt_tokens": 120, "completion_tokens": 30, "total_tokens": 150,
                    "cached_tokens": 20, "reasoning_tokens": 5}, {}, {}]


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(20).select("id", F.lit("x").alias("v"))
    a = U.fingerprint(df).first()
    assert a == U.fingerprint(df.orderBy(F.desc("id")).repartition(3)).first()
    assert a != U.fingerprint(df.withColumn("v", F.when(F.col("id") == 3, "y").otherwise("x"))
                              ).first()
    twice = U.fingerprint(df.unionByName(df.filter("id < 2")).unionByName(
        df.filter("id < 2"))).first()
    assert twice["rows"] == a["rows"] + 4 and twice["sum_low"] != a["sum_low"]


def test_gaps_are_filled_and_overlays_take_the_right_side(spark):
    i = spark.createDataFrame([("p", "T", "a", "unknown", "i"), ("p", "T", "b", "satisfied", "i")],
                              "patient_id STRING, trial_id STRING, criterion_id STRING, "
                              "status STRING, reason STRING")
    f = i.filter("criterion_id = 'a'").withColumn("status", F.lit("violated"))
    got = {r.criterion_id: (r.status, r.source) for r in R.overlay_criteria(i, f).collect()}
    assert got == {"a": ("violated", "final"), "b": ("satisfied", "initial")}
    t = spark.createDataFrame([("p", "T"), ("p", "U")], "patient_id STRING, trial_id STRING")
    row = t.filter("trial_id = 'T'").select("*", F.lit("eligible").alias("eligibility"),
                                            F.lit("").alias("explanation"))
    both = {r.trial_id: (r.eligibility, r.source) for r in
            R.initial_or_final(row.limit(0), row, t).collect()}
    assert both == {"T": ("eligible", "final_draft_fallback"),
                    "U": ("uncertain", "final_draft_fallback")}
    e = spark.createDataFrame([("p", "T", " new ")], "patient_id STRING, trial_id STRING, "
                              "explanation STRING")
    assert R.overlay_explanations(row, e).first().explanation == "new"


def test_blinded_records(spark):
    ok = {k: X.LOOP_RECORD[k] for k in ("patient_id", "patient_information_string",
                                        "candidate_trials")}
    bad = json.loads(json.dumps(ok))
    bad["candidate_trials"][0]["known_structured_fields"] = {"min_age": 1, "teacher_label": "x"}
    bad["candidate_trials"][0]["criteria_to_assess"][0]["criterion"] = "see final_output"
    df = spark.createDataFrame([(json.dumps(ok), "ok"), (json.dumps(bad), "bad")],
                               "record STRING, patient_id STRING")
    got = {r.error for r in A.blinded_errors(df).collect() if r.patient_id == "bad"}
    assert got == {
        "candidate_trials[0].known_structured_fields has unexpected keys: ['teacher_label']",
        "$.candidate_trials[0].known_structured_fields.teacher_label is forbidden in blinded "
        "input",
        "$.candidate_trials[0].criteria_to_assess[0].criterion contains evaluator-only field "
        "text"}
    assert A.blinded_errors(df.filter("patient_id = 'ok'")).count() == 0


def test_schemas_parse(spark):
    for name in ("PATIENTS", "RAW_PATIENTS", "TRIALS", "RAW_TRIALS", "TOPICS", "STUDY_PAGES",
                 "RECORDS", "ANSWERS", "PREDICTIONS", "PAIR_LABELS", "MODEL_CALLS"):
        spark.createDataFrame([], getattr(S, name))
