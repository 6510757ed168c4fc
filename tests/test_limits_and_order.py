"""Nothing is cut by default, ids stay distinct, and positions follow the input."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from cohortlens import schemas as S
from cohortlens import session
from cohortlens.functions import exprs as X
from cohortlens.functions import jsontext as J
from cohortlens.functions import protocol as P
from cohortlens.operators import audit, normalize, questions, responses, retrieval, rollup, summaries
from cohortlens.sources import readers, sinks

from . import fixtures


def test_summary_names_every_trial(spark):
    ranked = spark.range(1500).select(
        F.lit("p").alias("patient_id"), F.concat(F.lit("T"), "id").alias("trial_id"),
        F.lit("eligible").alias("eligibility"), (F.col("id") + 1).cast("int").alias("bucket_rank"))
    lines = rollup.patient_summary(ranked).orderBy("line_no").collect()
    assert [r.line_no for r in lines] == [1, 2]
    text = " ".join(r.patient_level_summary for r in lines)
    assert text.startswith("Recommended eligible trial ids after final matching: T0, T1, ")
    assert text.endswith("T1499.") and text.count("T") == 1500
    few = rollup.patient_summary(ranked.limit(3)).first()
    assert few.patient_level_summary == "Recommended eligible trial ids after final matching: T0, T1, T2."


def test_section_lines_are_all_kept(spark):
    text = "Inclusion Criteria:\n" + "\n".join(f"line {k:03d}" for k in range(200))
    row = spark.createDataFrame([(text,)], "t STRING").select(
        P.section_lines("t").alias("all"), P.section_lines("t", cap=80).alias("some")).first()
    assert len(row["all"].inclusion) == 200 and len(row["some"].inclusion) == 80


def test_trial_texts_keep_all_lines(spark):
    trial = {**fixtures.TRIALS[0], "inclusion_criteria": [f"inc{k}." for k in range(30)],
             "interventions": [f"drug{k}" for k in range(20)], "eligibility_criteria": "word " * 1000}
    trials = fixtures.trials(spark, [trial])
    raw = retrieval.trial_sections(trials).filter("section = 'raw_criteria'").first().text
    assert all(f"inc{k}." in raw for k in range(30))
    view = normalize.judging_view(trials).first()
    assert len(view.interventions) == 20 and len(view.inclusion_criteria) == 30
    assert len(view.eligibility_criteria_excerpt) >= 4999
    assert len(normalize.judging_view(trials, items=8, lines=12).first().inclusion_criteria) == 12
    assert len(normalize.candidate_view(trials).first().raw_criteria_excerpt.inclusion) == 30


def test_label_texts_are_not_cut(spark):
    label = {"pair_id": "x", "patient_id": "p", "trial_id": "t", "eligibility": "eligible",
             "criterion_results": [{"criterion_id": "c", "status": "satisfied", "reason": "r" * 900}],
             "follow_up_questions": ["q" * 700], "rationale": "s" * 2500}
    items = spark.createDataFrame([(json.dumps(label),)], "t STRING").select(F.parse_json("t").alias("item"))
    whole = responses.clean_label(items).first()
    assert (len(whole.criterion_results[0].reason), len(whole.follow_up_questions[0]),
            len(whole.rationale)) == (900, 700, 2500)
    cut = responses.clean_label(items, limits=responses.K.LABEL_TEXT_LIMITS).first()
    assert (len(cut.criterion_results[0].reason), len(cut.follow_up_questions[0]),
            len(cut.rationale)) == (500, 300, 1000)


def test_decision_far_behind_its_trial_id(spark):
    text = ('{"trial_id": "A", "x": "' + "y" * 2000 + '", "decision": "recommend"},'
            '{"trial_id": "B"},{"trial_id": "C", "decision": "not_recommended"')
    row = spark.createDataFrame([(text,)], "t STRING").select(J.loose_decisions("t").alias("d")).first()
    assert [(d.trial_id, d.decision) for d in row.d] == [("A", "recommend"), ("C", "not_recommended")]


def test_numbers_are_padded_and_never_cut(spark):
    rows = spark.range(1, 1200).select(X.padded(F.col("id"), 3).alias("t")).collect()
    assert len({r.t for r in rows}) == 1199 and rows[0].t == "001" and rows[-1].t == "1199"
    asked = spark.range(1, 201).select(
        F.lit("P").alias("patient_id"), F.col("id").cast("int").alias("pos"),
        F.lit(None).cast("string").alias("question_id"), F.concat(F.lit("text "), "id").alias("question"),
        F.lit("").alias("reason"), F.lit("").alias("source"))
    ids = [r.question_id for r in questions.collect_questions(asked).orderBy("pos").collect()]
    assert len(set(ids)) == 200 and ids[0] == "P-Q01" and ids[-1] == "P-Q200"


def test_rows_follow_the_names_of_their_files(spark, tmp_path):
    old, new = ({"patient_id": "p", "simulated_patient_answers": [
        {"question_id": "q", "answer": text}]} for text in ("old", "new"))
    filler = [{"patient_id": f"x{k}", "simulated_patient_answers": []} for k in range(3000)]
    for first, second in (([old], [*filler, new]), ([*filler, old], [new]), ([old], [new])):
        folder = tmp_path / str(len(list(tmp_path.iterdir())))
        folder.mkdir()
        for n, rows in ((1, first), (2, second)):
            (folder / f"part-{n}.jsonl").write_text("\n".join(map(json.dumps, rows)))
        got = readers.read_answers(spark, str(folder)).filter("patient_id = 'p'").collect()
        assert [r.answer for r in got] == ["new"]
        lines = readers.read_lines(spark, str(folder), "patient_id STRING", "pos").orderBy("pos").collect()
        assert [r.patient_id for r in lines] == [r["patient_id"] for r in (*first, *second)]


def test_batches_follow_their_numbers(spark, tmp_path):
    for n in (2, 10, 9):
        (tmp_path / f"x_batch_{n}.jsonl").write_text(
            "\n".join(json.dumps({"patient_id": f"p{n}-{k}"}) for k in range(4 * (11 - n))))
    got = readers.read_batches(spark, str(tmp_path / "x_batch_*.jsonl"), "patient_id STRING")
    assert [r.patient_id for r in got.orderBy("line_pos").collect()] == [
        f"p{n}-{k}" for n in (2, 9, 10) for k in range(4 * (11 - n))]


def test_gated_run_fails_on_one_broken_prediction(spark, monkeypatch):
    from cohortlens.plans import queries_quality, queries_responses

    sf_dir, whole = "/root/testdata/sf0.001", queries_responses.predictions
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    out = queries_quality.gated_run(spark, sf_dir).collect()
    assert [(r.errors, r.checked) for r in out] == [(0, orders.select("o_orderkey").distinct().count())]

    def broken(*args, **options):
        p = whole(*args, **options)
        return p.withColumn("final_output", F.when(
            F.col("patient_id") == "O1", F.col("final_output").withField("medical_disclaimer", F.lit(" "))
        ).otherwise(F.col("final_output")))

    monkeypatch.setattr(queries_responses, "predictions", broken)
    with pytest.raises(Exception, match="contract errors: 1"):
        queries_quality.gated_run(spark, sf_dir).collect()


@pytest.mark.parametrize("damage, errors", [
    (lambda p: p.where("patient_id <> 'O1'"), 1),  # a prediction is missing
    (lambda p: p.union(p.where("patient_id = 'O1'").withColumn("patient_id", F.lit("O-5"))), 1),
])
def test_gate_knows_which_orders_are_expected(spark, monkeypatch, damage, errors):
    from cohortlens.plans import queries_quality, queries_responses

    whole = queries_responses.predictions
    monkeypatch.setattr(queries_responses, "predictions", lambda *a, **k: damage(whole(*a, **k)))
    with pytest.raises(Exception, match=f"contract errors: {errors}"):
        queries_quality.gated_run(spark, "/root/testdata/sf0.001").collect()


def test_gate_stops_on_errors(spark):
    errors = spark.createDataFrame([("a", "bad")], "patient_id STRING, error STRING")
    assert audit.gate(errors.limit(0), errors).first().asDict() == {"errors": 0, "checked": 1}
    with pytest.raises(Exception, match="contract errors: 1"):
        audit.gate(errors).collect()


def test_manifest_tells_times_and_contents(spark):
    df = spark.createDataFrame([(1, 0.5, None), (2, None, "x")], "a INT, b DOUBLE, c STRING")
    times = summaries.run_times(datetime(2026, 1, 1, tzinfo=timezone.utc))
    rows = {r.name: r.value for r in summaries.manifest({"t": df}, times).collect()}
    assert rows["started_at"] == "2026-01-01T00:00:00+00:00" and float(rows["elapsed_seconds"]) > 0
    again = summaries.manifest({"t": df.orderBy(F.desc("a"))}, {}).first().value
    other = summaries.manifest({"t": df.withColumn("a", F.col("a") + 1)}, {}).first().value
    assert rows["t"] == again and rows["t"].split(":")[0] == "2" and rows["t"] != other


def test_batches_are_written_whole(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("pos"), F.lit("x").alias("t"))
    sinks.write_batches(df, "pos", 7, str(tmp_path / "b"))
    assert len(list((tmp_path / "b").glob("part*"))) < 50
    got = spark.read.json(str(tmp_path / "b"))
    assert sorted((r.pos, r.batch) for r in got.collect()) == [(k, k // 7 + 1) for k in range(1000)]


def test_no_machine_local_folder_on_a_cluster(spark):
    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "spark://host:7077"}.get(name, default)

    class Session:
        conf = Conf()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_schemas_name_answers():
    assert "simulated_patient_answers" in S.ANSWERS


def test_references_cut_off_stay_text(spark):
    t = spark.createDataFrame([("a&amp;&amp;&amp</h1> &quot b&am &amp;quot; &#65; &#x42; &nope; &quot;c&copy;",)], "t STRING")
    closed, lenient = t.select(P.clean_text("t", closed=True), P.clean_text("t")).first()
    assert closed == 'a&&&amp</h1> &quot b&am &quot; A B &nope; "c'
    assert lenient == 'a&&&</h1> " b&am &quot; A B &nope; "c'
