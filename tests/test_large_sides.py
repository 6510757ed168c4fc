"""Sides that grow with the tables are not broadcast, however small the optimizer takes them to be."""

from pyspark.sql import functions as F

from cohortlens import session
from cohortlens.operators import audit, matching, note_matching, responses, rollup
from cohortlens.plans import queries_loop, queries_responses, roles


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def many_parts(spark, folder, n):
    spark.range(n).select(
        F.col("id").alias("p_partkey"), F.lit("name").alias("p_name"), F.lit("Brand#11").alias("p_brand"),
        F.lit("MEDIUM").alias("p_type"), (F.col("id") % 50 + 1).cast("int").alias("p_size"),
        F.lit(1.0).alias("p_retailprice")).write.parquet(f"{folder}/part.parquet")
    return roles.trials(spark, folder)


def test_trials_are_broadcast_by_rows_not_by_estimate(spark, tmp_path):
    trials = many_parts(spark, str(tmp_path), session.BROADCAST_ROWS + 1)
    patients = roles.patients(spark, "/root/testdata/sf0.001")
    pairs = patients.select("patient_id", roles._tid("patient_pos").alias("trial_id"))
    judged = matching.judge_pairs(pairs, patients, trials, detail=False)
    assert "SortMergeJoin [trial_id" in plan_of(judged)
    few = matching.judge_pairs(pairs, patients, trials.filter("trial_pos < 500"), detail=False)
    assert "SortMergeJoin" not in plan_of(few) and few.count() == judged.count() == patients.count()
    full = matching.judge_pairs(pairs, patients, trials)
    report = rollup.report_criteria(matching.decide(full), trials)
    assert plan_of(report).count("SortMergeJoin [trial_id") == 2


def test_criteria_meet_the_pairs_last(spark, tmp_path):
    many_parts(spark, str(tmp_path), 20)
    crit = session.shuffled(queries_loop.trial_criteria(spark, str(tmp_path)))
    phases = session.shuffled(queries_loop.patient_phases(spark, "/root/testdata/sf0.001", ("initial",)))
    pairs = roles.pair_columns(spark, "/root/testdata/sf0.001")
    rolled = rollup.roll_up(note_matching.judge_trials(pairs, phases, crit))
    plan = plan_of(rolled)
    # the later join stands above; nothing is exchanged between it and the aggregation by pair
    last = plan.index("SortMergeJoin [trial_id")
    assert "Exchange" not in plan[:last] and last < plan.index("SortMergeJoin [patient_id")


def test_responses_are_not_broadcast(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries_responses.lines(spark, sf)
    out = responses.normalize_responses(queries_responses.raw_responses(spark, sf), queries_responses.trials_of(rows),
                                        queries_responses.criteria_of(rows))
    for name in ("audit", "assessed", "question_links"):
        assert "Broadcast" not in plan_of(out[name]), name
    p = session.written(queries_responses.predictions(spark, sf, breaches=False), "p")
    assert "Broadcast" not in plan_of(audit.contract_errors(p, p))
