"""Judging, rolling up and ranking pairs against known decisions."""

from pyspark.sql import functions as F

from cohortlens.operators import matching as M
from cohortlens.operators import ranking as R
from cohortlens.operators import rollup as U
from cohortlens.operators.questions import with_questions
from cohortlens.plans import recommend as P

from . import fixtures as X



def _decided(spark):
    return M.decide(M.judge_pairs(X.pairs(spark), X.patients(spark), X.trials(spark)))


def test_decision_matrix_and_top_three(spark):
    rows = _decided(spark).collect()
    assert sorted((r.patient_id, r.trial_id, r.score, r.decision) for r in rows) == sorted(X.DECISIONS)
    top = R.recommend_top(_decided(spark), 3).orderBy("patient_id", "rank").collect()
    best = {}
    for r in top:
        best.setdefault(r.patient_id, []).append(int(r.trial_id[-3:]))
    assert best == X.BEST_THREE


def test_missing_information_evidence_and_questions(spark):
    row = with_questions(_decided(spark)).filter(
        "patient_id = 'SYN-009' AND trial_id = 'NCT-SAMPLE-001'").first()
    missing = [e.criterion for e in row.evidence if e.status == "missing"]
    assert missing == ["field:ecog", "field:biomarkers", "field:ecog", "biomarker:EGFR",
                       "flag:active_interstitial_lung_disease"]
    assert (row.matched, row.missing, row.conflicts, row.score) == (4, 5, 0, 0.639)
    assert row.questions == [
        "What is the current ECOG performance status?",
        "What is the patient's biomarkers?",
        "What is the patient's EGFR biomarker result?",
        "Does the patient have active interstitial lung disease?"]


def test_retrieved_pairs_give_the_same_top_three(spark):
    top = P.recommend(X.patients(spark), X.trials(spark), k=5, n=3)
    best = {}
    for r in top.orderBy("patient_id", "rank").collect():
        best.setdefault(r.patient_id, []).append(int(r.trial_id[-3:]))
    assert best == X.BEST_THREE


def test_order_of_input_does_not_matter(spark):
    shuffled = X.pairs(spark).orderBy(F.rand(7)).repartition(3)
    again = M.decide(M.judge_pairs(shuffled, X.patients(spark), X.trials(spark)))
    a = _decided(spark).select("patient_id", "trial_id", "score", "rationale")
    b = again.select("patient_id", "trial_id", "score", "rationale")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_condition_links_equal_brute_force(spark):
    p, t = X.patients(spark), X.trials(spark)
    got = {(r.dx, r.cond) for r in M.condition_links(p, t).collect()}
    tok = set("adult adults cancer chronic children disease diseases disorder disorders headache "
              "headaches idiopathic pediatric primary pulmonary syndrome with without".split())

    def tokens(s):
        return {w for w in s.split() if len(w) > 3 and w not in tok}
    norm = lambda s: s.strip().lower().replace("-", " ")
    dxs = {norm(x["diagnosis"]) for x in X.PATIENTS}
    conds = {norm(c) for x in X.TRIALS for c in x["conditions"]}
    want = {(d, c) for d in dxs for c in conds
            if c in d or d in c or tokens(d) & tokens(c)}
    assert got == want
    assert ("advanced renal cell carcinoma", "non small cell lung cancer") in got


def test_three_roll_up_policies(spark):
    def rows(*statuses):
        return F.array(*[F.struct(F.lit(s).alias("status")) for s in statuses])
    df = spark.range(1).select(*[
        U.roll_up_array(rows("satisfied", "not_applicable"), **p).alias("sat_na_" + n)
        for n, p in (("ignore", {"na_policy": "ignore"}), ("accept", {"na_policy": "accept"}),
                     ("reject", {"na_policy": "reject", "empty": "eligible"}))
    ], U.roll_up_array(rows("not_applicable"), na_policy="ignore").alias("na_ignore"),
        U.roll_up_array(rows("not_applicable"), na_policy="accept").alias("na_accept"),
        U.roll_up_array(rows("unknown", "violated")).alias("viol"),
        U.roll_up_array(F.filter(rows("x"), lambda r: F.lit(False)), na_policy="reject",
                        empty="eligible").alias("empty_reject"))
    r = df.first().asDict()
    assert r == {"sat_na_ignore": "eligible", "sat_na_accept": "eligible",
                 "sat_na_reject": "ineligible", "na_ignore": "uncertain",
                 "na_accept": "eligible", "viol": "ineligible", "empty_reject": "eligible"}


def test_report_rows(spark):
    decided = _decided(spark).withColumn("retrieval_score", F.lit(1.0)).withColumn(
        "retrieval_pos", F.col("trial_pos"))
    rows = R.rank_report(U.report_recommendations(decided, X.trials(spark)), ranges=2)
    one = rows.filter("patient_id = 'SYN-001'").orderBy("rank").collect()
    assert [r["rank"] for r in one] == [1, 2, 3, 4, 5]
    best = one[0]
    assert (best.trial_id, best.eligibility, best.recommendation_score) == (
        "NCT-SAMPLE-001", "eligible", 1.0)
    ids = [c.criterion_id for c in best.criterion_results]
    assert ids[0] == "NCT-SAMPLE-001-I-001" and ids[-1] == "NCT-SAMPLE-001-N-008"
    assert best.criterion_results[-1].reason == "Trial is open to all recorded sexes."
    assert best.explanation.startswith("Ranked as eligible because 7 applicable criteria")


def test_full_rank_survives_blocks_and_ties(spark):
    rows = [(k, i % 3, i) for k in ("a", "b") for i in range(50)]
    df = spark.createDataFrame(rows, "k STRING, lv INT, pos INT")
    got = R.full_rank(df, ["k"], [("lv", False)], "pos", ranges=7).collect()
    for k in ("a", "b"):
        mine = sorted((r for r in got if r.k == k), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 51))
        assert [(r.lv, r.pos) for r in mine] == sorted(
            ((lv, p) for kk, lv, p in rows if kk == k), key=lambda x: (-x[0], x[1]))


def test_full_rank_of_a_hot_key_with_distinct_scores(spark):
    n = 1_000_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 50 == 0, F.lit(None).cast("string")).otherwise("hot").alias("k"),
        ((F.col("id") * 7919) % n).alias("score"), F.col("id").alias("pos"))
    ranked = R.full_rank(rows, ["k"], [("score", False)], "pos", ranges=16)
    hot = ranked.filter("k = 'hot'")
    # ranks are 1 to the number of rows, and fall with the score
    assert hot.agg(F.min("rank"), F.max("rank"), F.count_distinct("rank"), F.count("*")).first() == (
        1, n * 49 // 50, n * 49 // 50, n * 49 // 50)
    assert hot.filter("rank <= 3").orderBy("rank").select("score").collect() == [
        (s,) for s in sorted((i * 7919 % n for i in range(n) if i % 50), reverse=True)[:3]]
    assert hot.agg(F.corr("rank", "score")).first()[0] < -0.999
    assert ranked.filter("k IS NULL").agg(F.max("rank"), F.count("*")).first() == (n // 50, n // 50)
    assert R.full_rank(rows.limit(0), ["k"], [("score", False)], "pos").count() == 0


def test_carry_forward_in_blocks(spark):
    values = [None, "a", None, None, "b", None, None, None, None, "c", None]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)],
                               "g INT, pos INT, v STRING")
    out = R.carry_forward(df, ["g"], "pos", F.col("v"), "seen", block=3).orderBy("pos")
    last, want = None, []
    for v in values:
        last = v or last
        want.append(last)
    assert [r.seen for r in out.collect()] == want


def test_lower_percentile_is_the_lower_index(spark):
    df = spark.createDataFrame([("x", v) for v in range(1, 11)] + [("y", 5)], "g STRING, v INT")
    got = {(r.g, r.p): r.percentile for r in
           R.lower_percentile(df, ["g"], "v", [0.5, 0.95], block=3).collect()}
    assert got == {("x", 0.5): 5, ("x", 0.95): 9, ("y", 0.5): 5, ("y", 0.95): 5}
    alone = R.lower_percentile(df.filter("g = 'x'"), [], "v", [0.95], block=4).collect()
    assert [r.percentile for r in alone] == [9]


def test_batches_number_rows_in_order(spark):
    df = spark.range(0, 23).select((F.col("id") * 3).alias("pos"))
    rows = R.batches(df, "pos", 5, ranges=3).orderBy("pos").collect()
    assert [r.row_no for r in rows] == list(range(1, 24))
    assert [r.batch for r in rows] == [(i // 5) + 1 for i in range(23)]


def test_round_exact_follows_the_binary_value(spark):
    from cohortlens.functions.exprs import round_exact
    values = [0.4625, 0.0625, 2.675, 0.5625, 1 / 3, 2 / 3, 0.9995, 0.0005, 1.0, 0.0, 0.1245]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    got = [tuple(r) for r in df.select("v", round_exact("v", 3), round_exact("v", 2),
                                       round_exact(F.col("v") * 1.0, 3)).collect()]
    assert got == [(v, round(v, 3), round(v, 2), round(v, 3)) for v in values]
