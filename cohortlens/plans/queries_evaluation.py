"""The whole evaluation over nested records: an order is a patient, its lines are assessed trials.

Gold and predicted records are nested rows made from the lines.  An order's sixth and seventh line
repeat the trials of its first two.  Every eleventh order has no prediction and every
thirteenth is predicted a second time as a patient that gold doesn't know.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as X
from ..operators import scorecard as SC
from ..session import written
from . import queries_responses as QR
from . import roles_sql as Q
from .registry import Registry

QUERIES = Registry()
PARTS = ["-I-age", "-I-stage", "-E-organ-transplant"]


def _at(words, number):
    return F.element_at(X.words(words), (number + 1).cast("int"))


def records(spark, sf_dir):
    """Nested records of both sides: ``(gold, pred)``."""
    per = QR.lines(spark, sf_dir).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "q"))).alias("ls"))

    def status(x, c, side, phase):
        n, q = x["n"], x["q"]
        if side == "gold":
            final, open_ = _at(K.CRITERION_STATUS, (q + c) % 3), q % 4 == 0
        else:
            moved = F.when((F.col("k") + n + c) % 7 == 0, 2).otherwise(0)
            final, open_ = _at(K.CRITERION_STATUS, (q + c + moved) % 4), n % 2 == 0
        return final if phase == "final" else F.when(open_, "unknown").otherwise(final)

    def eligibility(x, side, phase):
        n, q = x["n"], x["q"]
        moved = F.when((F.col("k") + n) % 5 == 0, 1).otherwise(0) if side == "pred" else F.lit(0)
        final, open_ = _at(K.ELIGIBILITY, (q + moved) % 3), (q % 4 if side == "gold" else n % 2) == 0
        return final if phase == "final" else F.when(open_, "uncertain").otherwise(final)

    trial = lambda x: F.concat(F.lit("L"), x["n"] % 5)

    def side_of(side):
        def assessed(phase):
            return F.struct(F.transform("ls", lambda x: F.struct(
                trial(x).alias("trial_id"), eligibility(x, side, phase).alias("eligibility"),
                F.array(*[F.struct(F.concat(trial(x), F.lit(p)).alias("criterion_id"),
                                   status(x, c, side, phase).alias("status"))
                          for c, p in enumerate(PARTS)]).alias("criterion_results"))).alias("evaluated_trials"))

        needed = F.flatten(F.transform("ls", lambda x: F.filter(F.array(*[
            F.when(status(x, c, side, "initial") == "unknown", F.struct(
                trial(x).alias("trial_id"), F.concat(trial(x), F.lit(p)).alias("criterion_id")))
            for c, p in enumerate(PARTS)]), lambda y: y.isNotNull())))
        return per.select(
            "k", F.concat(F.lit("O"), "k").alias("patient_id"),
            F.transform("ls", lambda x: F.struct(trial(x).alias("trial_id"), F.array(*[
                F.struct(F.concat(trial(x), F.lit(p)).alias("criterion_id"),
                         F.lit("exclusion" if p.startswith("-E") else "inclusion").alias("criterion_type"))
                for p in PARTS]).alias("criteria_to_assess"))).alias("candidate_trials"),
            F.struct(
                assessed("initial").alias("initial_assessment"),
                assessed("final").alias("final_assessment_after_answers"),
                F.transform(F.filter("ls", lambda x: eligibility(x, side, "final") == "eligible"),
                            lambda x: F.struct(trial(x).alias("trial_id"))).alias("recommended_trials"),
                F.array(F.struct(needed.alias("needed_for"))).alias("follow_up_questions")).alias("final_output"))

    pred = side_of("pred")
    again = pred.where("k % 13 = 0").withColumn("patient_id", F.concat(F.lit("X"), "k"))
    return side_of("gold").drop("k"), pred.where("k % 11 <> 0").unionByName(again).drop("k")


def _items(spark, sf_dir):
    return written(SC.items(*records(spark, sf_dir)), "items")


_E, _S = (f"({w})" for w in (K.ELIGIBILITY, K.CRITERION_STATUS))
_SQL = f"""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, sum(l_quantity)::BIGINT AS q,
    'O' || l_orderkey AS patient_id, 'L' || (l_linenumber % 5) AS trial_id FROM lineitem
  GROUP BY ALL),
el AS (SELECT *, {_E}[q % 3 + 1] AS gf, {_E}[(q + CASE WHEN (k + n) % 5 = 0 THEN 1 ELSE 0 END) % 3 + 1] AS pf
  FROM l),
cl AS (SELECT l.*, part, c, {_S}[(q + c) % 3 + 1] AS gf,
    {_S}[(q + c + CASE WHEN (k + n + c) % 7 = 0 THEN 2 ELSE 0 END) % 4 + 1] AS pf
  FROM l, (VALUES ('age', 0), ('stage', 1), ('exclusion_flag', 2)) AS v(part, c)),
el2 AS (SELECT *, CASE WHEN q % 4 = 0 THEN 'uncertain' ELSE gf END AS gi,
    CASE WHEN n % 2 = 0 THEN 'uncertain' ELSE pf END AS pi FROM el),
cl2 AS (SELECT *, CASE WHEN q % 4 = 0 THEN 'unknown' ELSE gf END AS gi,
    CASE WHEN n % 2 = 0 THEN 'unknown' ELSE pf END AS pi FROM cl),
et AS (SELECT * FROM el2 QUALIFY n = max(n) OVER (PARTITION BY k, trial_id)),
ct AS (SELECT * FROM cl2 QUALIFY n = max(n) OVER (PARTITION BY k, trial_id)),
e AS (SELECT * FROM et WHERE k % 11 <> 0),
c AS (SELECT * FROM ct WHERE k % 11 <> 0),
rec AS (SELECT k, trial_id, bool_or(gf = 'eligible') AS g, bool_or(pf = 'eligible') AS p FROM el2
  GROUP BY ALL),
link AS (SELECT k, trial_id, part, bool_or(gi = 'unknown') AS g, bool_or(pi = 'unknown') AS p FROM cl2
  GROUP BY ALL)
"""
_COUNTED = """,
rs AS (SELECT k, count(*) FILTER (g) AS g, count(*) FILTER (p) AS p, count(*) FILTER (g AND p) AS h
  FROM rec WHERE k % 11 <> 0 GROUP BY k),
ls AS (SELECT k, count(*) FILTER (g) AS g, count(*) FILTER (p) AS p, count(*) FILTER (g AND p) AS h
  FROM link WHERE k % 11 <> 0 GROUP BY k),
labelled AS (SELECT 'eligibility' AS kind, gf AS g, pf AS p FROM e UNION ALL
  SELECT 'criterion_status', gf, pf FROM c),
listed AS (SELECT 'eligibility' AS kind, unnest(""" + _E + """) AS x UNION ALL
  SELECT 'criterion_status', unnest(""" + _S + """)),
prf AS (SELECT listed.kind || '_label' AS section, x AS item, count(*) FILTER (g = x) AS gold,
    count(*) FILTER (p = x) AS pred, count(*) FILTER (g = x AND p = x) AS hit
  FROM listed LEFT JOIN labelled ON listed.kind = labelled.kind GROUP BY ALL),
base AS (
  SELECT 'accuracy' AS section, 'eligibility' AS item, '' AS item2, count(*) FILTER (gf = pf) AS agree,
    count(*) AS total, 0 AS gold, 0 AS pred, 0 AS hit FROM e
  UNION ALL SELECT 'accuracy', 'initial_eligibility', '', count(*) FILTER (gi = pi), count(*), 0, 0, 0 FROM e
  UNION ALL SELECT 'accuracy', 'criterion_status', '', count(*) FILTER (gf = pf), count(*), 0, 0, 0 FROM c
  UNION ALL SELECT 'accuracy', 'initial_criterion_status', '', count(*) FILTER (gi = pi), count(*), 0, 0, 0
    FROM c
  UNION ALL SELECT 'eligibility_confusion', gf, pf, 0, count(*), 0, 0, 0 FROM e GROUP BY gf, pf
  UNION ALL SELECT 'initial_eligibility_confusion', gi, pi, 0, count(*), 0, 0, 0 FROM e GROUP BY gi, pi
  UNION ALL SELECT 'criterion_status_confusion', gf, pf, 0, count(*), 0, 0, 0 FROM c GROUP BY gf, pf
  UNION ALL SELECT 'initial_criterion_status_confusion', gi, pi, 0, count(*), 0, 0, 0 FROM c GROUP BY gi, pi
  UNION ALL SELECT section, item, '', 0, 0, gold, pred, hit FROM prf
  UNION ALL SELECT 'family', part, '', count(*) FILTER (gf = pf), count(*), 0, 0, 0 FROM c GROUP BY part
  UNION ALL SELECT 'transition', 'all', '', count(*) FILTER (gi = pi AND gf = pf), count(*), 0, 0, 0 FROM c
  UNION ALL SELECT 'transition', 'changed', '', count(*) FILTER (gi = pi AND gf = pf), count(*), 0, 0, 0
    FROM c WHERE gi <> gf
  UNION ALL SELECT 'patients', 'common', '', 0, count(DISTINCT k), 0, 0, 0 FROM l WHERE k % 11 <> 0
  UNION ALL SELECT 'patients', 'missing', '', 0, count(DISTINCT k), 0, 0, 0 FROM l WHERE k % 11 = 0
  UNION ALL SELECT 'patients', 'extra', '', 0, count(DISTINCT k), 0, 0, 0 FROM l WHERE k % 13 = 0
  UNION ALL SELECT 'recommendation_set', '', '', count(*) FILTER (h = g AND h = p), count(*),
    coalesce(sum(g), 0), coalesce(sum(p), 0), coalesce(sum(h), 0) FROM rs
  UNION ALL SELECT 'question_links', '', '', count(*) FILTER (h = g AND h = p), count(*),
    coalesce(sum(g), 0), coalesce(sum(p), 0), coalesce(sum(h), 0) FROM ls)
"""


def _ratio(a: str, b: str, factor: str = "") -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE {Q.round_exact(f'({factor}{a})::DOUBLE / ({b})', 4)} END"


@QUERIES.add("evaluation_report", "EVL-01 EVL-02 EVL-03 EVL-04 EVL-05 EVL-06 EVL-07 JON-05 JON-06", _SQL + _COUNTED + f""",
scored AS (SELECT section, item, item2, agree::BIGINT AS agree, total::BIGINT AS total, gold::BIGINT AS gold,
  pred::BIGINT AS pred, hit::BIGINT AS hit,
  CASE WHEN section IN ('accuracy', 'family', 'transition', 'recommendation_set', 'question_links')
    THEN {_ratio('agree', 'total')} END AS accuracy,
  CASE WHEN section LIKE '%_label' OR section IN ('recommendation_set', 'question_links')
    THEN {_ratio('hit', 'pred')} END AS precision,
  CASE WHEN section LIKE '%_label' OR section IN ('recommendation_set', 'question_links')
    THEN {_ratio('hit', 'gold')} END AS recall,
  CASE WHEN section LIKE '%_label' OR section IN ('recommendation_set', 'question_links')
    THEN {_ratio('hit', '(gold + pred)', '2 * ')} END AS f1 FROM base),
mean AS (SELECT replace(section, '_label', '') AS item,
    list_reduce(list_prepend(0.0::DOUBLE, list(f1 ORDER BY item)), lambda a, b: a + b) AS s, count(*) AS n
  FROM scored WHERE section LIKE '%_label' AND gold > 0 GROUP BY 1)
SELECT * FROM scored
UNION ALL SELECT 'macro_f1', item, '', 0, 0, 0, 0, 0, NULL, NULL, NULL, {Q.round_exact('s / n', 4)} FROM mean""")
def evaluation_report(spark, sf_dir):
    """All sections of the evaluation of all orders' records."""
    return SC.report(_items(spark, sf_dir))


@QUERIES.add("evaluation_patients", "EVL-09 JON-07", _SQL + f""",
ep AS (SELECT k, count(*) FILTER (gf = pf) AS ec, count(*) AS et FROM e GROUP BY k),
cp AS (SELECT k, count(*) FILTER (gf = pf) AS cc, count(*) AS ctotal FROM c GROUP BY k),
rp AS (SELECT k, count(*) FILTER (g) AS rg, count(*) FILTER (p) AS rp, count(*) FILTER (g AND p) AS rh
  FROM rec GROUP BY k),
lp AS (SELECT k, count(*) FILTER (g) AS lg, count(*) FILTER (p) AS lp, count(*) FILTER (g AND p) AS lh
  FROM link GROUP BY k),
known AS (SELECT 'O' || k AS patient_id, true AS in_gold, k % 11 <> 0 AS in_pred, coalesce(ec, 0) AS ec,
    coalesce(et, 0) AS et, coalesce(cc, 0) AS cc, coalesce(ctotal, 0) AS ctotal, rg,
    CASE WHEN k % 11 = 0 THEN 0 ELSE rp END AS rp, CASE WHEN k % 11 = 0 THEN 0 ELSE rh END AS rh, lg,
    CASE WHEN k % 11 = 0 THEN 0 ELSE lp END AS lp, CASE WHEN k % 11 = 0 THEN 0 ELSE lh END AS lh
  FROM rp JOIN lp USING (k) LEFT JOIN ep USING (k) LEFT JOIN cp USING (k)
  UNION ALL SELECT 'X' || k, false, true, 0, 0, 0, 0, 0, rp, 0, 0, lp, 0
  FROM rp JOIN lp USING (k) WHERE k % 13 = 0)
SELECT patient_id, in_gold, in_pred, ec AS eligibility_correct, et AS eligibility_total,
  cc AS criterion_status_correct, ctotal AS criterion_status_total, rg AS recommended_gold,
  rp AS recommended_pred, rh AS recommended_hit, lg AS linked_gold, lp AS linked_pred, lh AS linked_hit,
  {_ratio('ec', 'et')} AS eligibility_accuracy, {_ratio('cc', 'ctotal')} AS criterion_status_accuracy
FROM known""")
def evaluation_patients(spark, sf_dir):
    """Counts and accuracies of every patient of either side."""
    return SC.by_patient(_items(spark, sf_dir))


@QUERIES.add("evaluation_samples", "RNK-09 EVL-01", _SQL + """,
wrong AS (SELECT patient_id, trial_id, '' AS criterion_id, gf AS gold, pf AS pred FROM e WHERE gf <> pf)
SELECT *, (SELECT count(*) FROM wrong) AS found FROM wrong ORDER BY patient_id, trial_id LIMIT 100""")
def evaluation_samples(spark, sf_dir):
    """The first hundred wrong labels, and how many there are."""
    return SC.disagreements(_items(spark, sf_dir), SC.TRIAL, 100)
