"""Readers and sinks, cohorts, streams and the query registry."""

import json

from pyspark.sql import functions as F

from cohortlens import schemas as S
from cohortlens.operators import audit as A
from cohortlens.operators import cohort as H
from cohortlens.operators import matching as M
from cohortlens.operators import questions as Q
from cohortlens.plans.catalog import QUERIES
from cohortlens.sources import readers, sinks
from cohortlens.streaming import answers as SA
from cohortlens.streaming import scores as SS

from . import fixtures as X


def test_readers(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps(X.PATIENTS))
    (tmp_path / "p.jsonl").write_text(
        "\n\n".join(json.dumps({**p, "id": p["patient_id"], "patient_id": ""})
                    for p in X.PATIENTS[:2]) + "\n")
    (tmp_path / "t.json").write_text(json.dumps(X.TRIALS))
    (tmp_path / "w.json").write_text(json.dumps({"records": X.TRIALS[:2]}))
    a = readers.read_patients(spark, str(tmp_path / "p.json"))
    assert [r.patient_id for r in a.orderBy("patient_pos").collect()] == [
        p["patient_id"] for p in X.PATIENTS]
    assert a.filter("patient_id = 'SYN-010'").first().flags == {"active_autoimmune_disease": True}
    b = readers.read_patients(spark, str(tmp_path / "p.jsonl"))
    assert [r.patient_id for r in b.orderBy("patient_pos").collect()] == ["SYN-001", "SYN-002"]
    t = readers.read_trials(spark, str(tmp_path / "t.json"))
    assert [r.trial_id[-1] for r in t.orderBy("trial_pos").collect()] == list("12345")
    w = readers.read_wrapped(spark, str(tmp_path / "w.json"), S.RAW_TRIALS)
    assert [r.trial_id[-1] for r in w.orderBy("pos").collect()] == ["1", "2"]
    pages = tmp_path / "pages"
    pages.mkdir()
    for i, study in enumerate((X.STUDY, X.PLAIN_STUDY)):
        (pages / f"lung-cancer-{i:04d}.json").write_text(json.dumps({"studies": [study]}))
    got = readers.read_study_pages(spark, str(pages), ["Lung Cancer"], 5)
    assert [r.trial_id for r in got.orderBy("trial_pos").collect()] == ["NCT123", "NCT456"]
    (tmp_path / "r1.txt").write_bytes("﻿{\"answerText\": \"hi\"}".encode("utf-8"))
    (tmp_path / "r2.txt").write_bytes("plain é".encode("utf-16"))
    out = {r.path[-6:]: r.text for r in
           readers.read_responses(spark, str(tmp_path / "r*.txt")).collect()}
    assert out == {"r1.txt": "hi", "r2.txt": "plain é"}
    rows = [{"patient_id": "p", "simulated_patient_answers": [{"question_id": "q", "answer": v}]}
            for v in ("old", "new")]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert [r.answer for r in readers.read_answers(spark, str(tmp_path / "a.jsonl")).collect()
            ] == ["new"]
    for n in (2, 10):
        (tmp_path / f"x_batch_{n:02d}.jsonl").write_text('{"patient_id": "p%d"}\n' % n)
    got = readers.read_batches(spark, str(tmp_path / "x_batch_*.jsonl"), "patient_id STRING")
    assert sorted((r.batch_no, r.patient_id) for r in got.collect()) == [(2, "p2"), (10, "p10")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, None, "é") for i in range(7)], "pos INT, b STRING, a STRING")
    sinks.write_lines(df, str(tmp_path / "lines"))
    line = sorted(x for f in (tmp_path / "lines").glob("part*") for x in
                  f.read_text().splitlines())[0]
    assert line == '{"a":"é","b":null,"pos":0}'
    sinks.write_batches(df, "pos", 3, str(tmp_path / "batches"))
    got = spark.read.json(str(tmp_path / "batches"))
    assert sorted((r["count"], r.batch) for r in got.groupBy("batch").count().collect()) == [
        (1, 3), (3, 1), (3, 2)]
    sinks.write_report(df.limit(1), df, str(tmp_path / "report"))
    sinks.write_fan_out(df, df, df, str(tmp_path / "run"))
    assert spark.read.json(str(tmp_path / "run" / "audit")).count() == 7
    labels = spark.createDataFrame(
        [("p", "T", "recommend", "matcher", True, False)],
        "patient_id STRING, trial_id STRING, decision STRING, source STRING, agrees BOOLEAN, "
        "human_review_required BOOLEAN")
    sinks.write_tsv(sinks.review_label_rows(labels), str(tmp_path / "tsv"))
    text = {x for f in (tmp_path / "tsv").glob("part*") for x in f.read_text().splitlines()}
    assert text == {"PATIENT_ID\tTRIAL_ID\tLABEL\tSOURCE\tAGREES\tHUMAN_REVIEW_REQUIRED",
                    "p\tT\trecommend\tmatcher\t1\t0"}
    back = spark.read.csv(str(tmp_path / "tsv"), sep="\t", header=True).collect()
    assert [tuple(r) for r in back] == [("p", "T", "recommend", "matcher", "1", "0")]


def test_cohort_scenarios_have_their_effect(spark):
    trials = X.trials(spark)
    cohort = H.make_cohort(trials, 60).cache()
    pairs = cohort.select("patient_id", F.col("target_trial_id").alias("trial_id"))
    decided = M.decide(M.judge_pairs(pairs, cohort, trials)).join(
        cohort.select("patient_id", "scenario"), "patient_id").collect()
    conflict = {"age_conflict": "age", "stage_conflict": "stage", "ecog_conflict": "ecog",
                "exclusion_conflict": "flag:", "wrong_condition": "biomarker:"}
    seen = set()
    for r in decided:
        status = {e.criterion: e.status for e in r.evidence}
        seen.add(r.scenario)
        if r.scenario == "clear_candidate":
            # a marker with alternatives is copied as written and so fits none of them
            assert all(v == "matched" or k.startswith("biomarker:") for k, v in status.items()), r
            if r.trial_id not in ("NCT-SAMPLE-001", "NCT-SAMPLE-005"):
                assert r.decision == "recommend", r
        elif r.scenario in conflict:
            assert any(v == "conflict" and k.startswith(conflict[r.scenario])
                       for k, v in status.items()), r
        elif r.scenario.startswith("missing_"):
            assert r.missing > 0
        elif r.scenario == "prior_treatment_gap":
            assert status["field:prior_treatments"] == "missing"
    assert {"clear_candidate", "wrong_condition", "age_conflict", "ecog_conflict",
            "missing_biomarker"} <= seen
    again = H.make_cohort(trials, 60)
    assert [r.age for r in again.orderBy("patient_pos").collect()] == [
        r.age for r in cohort.orderBy("patient_pos").collect()]


def test_plain_trial_has_no_oncology_values(spark):
    one = {**X.TRIALS[0], "conditions": ["Migraine"], "max_age": None, "allowed_stages": [],
           "max_ecog": None, "required_biomarkers": {}, "excluded_flags": [],
           "required_patient_fields": ["diagnosis"]}
    rows = H.make_cohort(X.trials(spark, [one]), 8).orderBy("patient_pos").collect()
    assert {r.scenario for r in rows} == {"clear_candidate", "wrong_condition", "missing_age",
                                          "age_conflict"}
    assert all(r.stage is None and r.ecog is None for r in rows)
    assert {r.age for r in rows if r.scenario == "age_conflict"} == {17}
    assert rows[0].patient_id == "SYN-GEN-00001"


def test_score_stream_resumes_and_skips_done_keys(spark, tmp_path):
    src, sink, log = (str(tmp_path / n) for n in ("src", "sink", "log"))
    schema = "patient_id STRING, trial_id STRING"

    def score(batch):
        return batch.distinct().withColumn("n", F.length("patient_id"))

    def run():
        stream = spark.readStream.schema(schema).parquet(src)
        SS.score_stream(stream, score, ["patient_id", "trial_id"], sink, log).awaitTermination()
        return sorted((r.patient_id, r.trial_id) for r in SS.results(spark, sink).collect())
    spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1")], schema).write.parquet(src)
    assert run() == [("a", "1"), ("b", "1")]
    spark.createDataFrame([("a", "1"), ("c", "1")], schema).write.mode("append").parquet(src)
    assert run() == [("a", "1"), ("b", "1"), ("c", "1")]


def test_answer_stream_equals_batch(spark, tmp_path):
    src, sink, log = (str(tmp_path / n) for n in ("src", "sink", "log"))
    schema = "patient_id STRING, answer STRING, ans_pos INT"
    first = [("p", "ECOG is 1", 1), ("q", "stage iv", 1)]
    second = [("p", "ECOG is 3", 2), ("p", "no organ transplant", 3)]
    for rows in (first, second):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        SA.answer_stream(stream, F.col("ans_pos"), sink, log).awaitTermination()
    got = SA.current_facts(spark, sink)
    want = Q.answer_facts(spark.createDataFrame(first + second, schema))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(
        map(tuple, want.collect()))


def test_workspace_listing(spark):
    rows = [("data/a.jsonl", b'{"x": 1}\n[1]\n{"final_output": 1}'), ("gold_label/b.json", b"{"),
            ("c.txt", b"key sk-abcdefghijklmnopqrstuvwx"), ("outputs/gold_label.txt", b"")]
    df = spark.createDataFrame(rows, "path STRING, content BINARY")
    got = {(r.path, r.error) for r in A.workspace_errors(df).collect()}
    assert got == {
        ("data/a.jsonl", "row is not an object"),
        ("data/a.jsonl", "$.final_output: forbidden evaluator-only key"),
        ("gold_label/b.json", "forbidden evaluator-only path term 'gold_label'"),
        ("gold_label/b.json", "invalid JSON"), ("c.txt", "possible secret or bearer token")}


def test_registry_is_complete():
    assert len(QUERIES) >= 60
    assert all(q.operators for q in QUERIES.values())
    assert sum(q.sql is None for q in QUERIES.values()) <= 1
