"""Model responses in all their layouts, written from orders and their lines.

An order stands for a patient and its numbered lines (at most seven) for its candidate trials.
The response texts are derived from the whole tables, with defects placed by expression.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import jsontext as J
from ..operators import audit as A
from ..operators import responses as R
from ..session import shuffled
from . import roles
from .registry import Registry

QUERIES = Registry()
PAIR = ["patient_id", "trial_id"]

_LINES = """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_returnflag) AS flag,
    sum(l_quantity)::BIGINT AS q, 'O' || l_orderkey AS patient_id, 'L' || l_linenumber AS trial_id
  FROM lineitem GROUP BY ALL)
"""


def lines(spark, sf_dir):
    """One row per order and line number."""
    return roles.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_returnflag").alias("flag"), F.sum("l_quantity").cast("bigint").alias("q")
    ).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "flag", "q",
             F.concat(F.lit("O"), F.col("l_orderkey")).alias("patient_id"),
             F.concat(F.lit("L"), F.col("l_linenumber")).alias("trial_id"))


def _text(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _when(cond, text):
    return F.when(cond, F.lit(text) if isinstance(text, str) else text).otherwise(F.lit(""))


def joined(rows, item, cond=None, sep=","):
    """Texts of an order's lines in line order (seven at most)."""
    item = item if cond is None else F.when(cond, item)
    packed = F.array_sort(F.collect_list(F.when(item.isNotNull(), F.struct("n", item.alias("x")))))
    return F.array_join(F.transform(packed, lambda r: r["x"]), sep)


def trials_of(rows):
    return rows.select(*PAIR, F.col("n").alias("candidate_pos"))


def criteria_of(rows):
    parts = F.posexplode(F.array(F.lit("-I-age"), F.lit("-E-x"))).alias("criterion_pos", "p")
    return rows.select(*PAIR, parts).select(
        *PAIR, "criterion_pos", F.concat("trial_id", "p").alias("criterion_id"))


# --- complete predictions from defective responses --------------------------------------------

def raw_responses(spark, sf_dir):
    rows = lines(spark, sf_dir)
    n, q, t = F.col("n"), F.col("q"), F.col("trial_id")
    label = F.when(F.col("flag") == "A", "eligible").when(
        F.col("flag") == "N", "Uncertain ").otherwise("bogus")
    first = _text('{"criterion_id":"', t, '-I-age","status":"',
                  F.when(q % 2 == 0, "satisfied").otherwise("violated"), '","reason":"r"}')
    second = _when(n % 3 != 0, _text(',{"criterion_id":"', t, '-E-x","status":"', F.when(
        q % 5 == 0, "n/a?").otherwise("satisfied"), '"}'))
    stray = _when(n == 2, ',{"criterion_id":"zzz","status":"violated"}')
    row = _text('{"trial_id":"', t, '","eligibility":"', label, '","criterion_results":[', first,
                second, stray, "]}")
    per = rows.groupBy("k", "patient_id").agg(joined(rows, row, n != 7).alias("body"))
    body = F.concat_ws(",", F.nullif("body", F.lit("")), F.when(
        F.col("k") % 4 == 0, F.lit('{"trial_id":"EXTRA","eligibility":"eligible"}')))
    assessed = _text('{"evaluated_trials":[', body, "]}")
    doc = _text("{", _when(F.col("k") % 3 != 0, _text('"initial_assessment":', assessed, ",")),
                '"final_assessment_after_answers":', assessed, "}")
    k = F.col("k") % 5
    content = (F.when(k == 0, _text("```json\n", doc, "\n```"))
               .when(k == 1, _text(F.regexp_replace(doc, "}$", ""), ", }"))
               .when(k == 2, _text("Here: ", doc, " done")).when(k == 3, "not json")
               .otherwise(doc))
    return per.select("patient_id", content.alias("content"))


@QUERIES.add("response_audit", "LBL-01 LBL-09 JON-09", _LINES + """,
p AS (SELECT *, k % 5 <> 3 AND n <> 7 AND (phase = 'final' OR k % 3 <> 0) AS here,
    k % 5 <> 3 AND (phase = 'final' OR k % 3 <> 0) AS valid
  FROM l, (VALUES ('initial'), ('final')) AS x(phase)),
s AS (SELECT *, CASE WHEN NOT here THEN 'uncertain' WHEN q % 2 <> 0 THEN 'ineligible'
    WHEN n % 3 = 0 OR q % 5 = 0 THEN 'uncertain' ELSE 'eligible' END AS rolled,
  CASE WHEN NOT here OR flag = 'R' THEN '' WHEN flag = 'A' THEN 'eligible' ELSE 'uncertain' END
    AS given FROM p)
SELECT patient_id, phase, count(*) FILTER (NOT here) AS missing_trials_filled,
  sum(CASE WHEN NOT here THEN 2 WHEN n % 3 = 0 THEN 1 ELSE 0 END)::BIGINT
    AS missing_criteria_filled,
  count(*) FILTER (given = '') AS fallback_eligibility_count,
  count(*) FILTER (given <> '' AND given <> rolled) AS inconsistent_eligibility_corrected,
  sum(CASE WHEN NOT here THEN 2 WHEN n % 3 = 0 OR q % 5 = 0 THEN 1 ELSE 0 END)::BIGINT
    AS fallback_criterion_status_count,
  bool_or(valid AND k % 4 = 0)::BIGINT AS extra_trial_ids_dropped,
  count(*) FILTER (here AND n = 2) AS extra_criterion_ids_dropped,
  any_value(k % 5 <> 3) AS raw_json_valid, any_value(k % 5 IN (1, 2)) AS parse_repaired
FROM s GROUP BY patient_id, phase""")
def response_audit(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return R.normalize_responses(raw_responses(spark, sf_dir), trials_of(rows),
                                 criteria_of(rows))["audit"]


@QUERIES.add("response_labels", "LBL-09 JON-09 PRD-13", _LINES + """,
p AS (SELECT *, k % 5 <> 3 AND n <> 7 AS here FROM l)
SELECT patient_id, trial_id, CASE WHEN NOT here THEN 'uncertain' WHEN q % 2 <> 0 THEN 'ineligible'
    WHEN n % 3 = 0 OR q % 5 = 0 THEN 'uncertain' ELSE 'eligible' END AS eligibility,
  NOT here AS filled FROM p""")
def response_labels(spark, sf_dir):
    rows = lines(spark, sf_dir)
    out = R.normalize_responses(raw_responses(spark, sf_dir), trials_of(rows), criteria_of(rows))
    return out["assessed"].filter("phase = 'final'").select(*PAIR, "eligibility", "filled")


@QUERIES.add("catch_all_questions", "QST-04", _LINES + """,
p AS (SELECT *, k % 5 <> 3 AND n <> 7 AND k % 3 <> 0 AS here FROM l),
u AS (SELECT patient_id, sum(CASE WHEN NOT here THEN 2 WHEN n % 3 = 0 OR q % 5 = 0 THEN 1
    ELSE 0 END)::BIGINT AS links FROM p GROUP BY patient_id)
SELECT patient_id || '-Q01' AS question_id, links FROM u WHERE links > 0""")
def catch_all_questions(spark, sf_dir):
    rows = lines(spark, sf_dir)
    out = R.normalize_responses(raw_responses(spark, sf_dir), trials_of(rows), criteria_of(rows))
    return out["question_links"].groupBy("question_id").agg(F.count(F.lit(1)).alias("links"))


# --- pair labels in several envelopes -----------------------------------------------------------

def label_texts(spark, sf_dir):
    rows = lines(spark, sf_dir)
    n, q = F.col("n"), F.col("q")
    pid = F.when(n == 6, "nobody").otherwise(_text(F.col("patient_id"), "__", F.col("trial_id")))
    item = _text('{"pair_id":"', pid, '","patient_id":"', F.col("patient_id"), '","trial_id":"',
                 F.col("trial_id"), '","eligibility":"',
                 F.when(q % 3 == 0, " Eligible").when(q % 3 == 1, "maybe").otherwise("ineligible"),
                 '","criterion_results":[{"criterion_id":"c1","status":"',
                 F.when(q % 2 == 0, "SATISFIED").otherwise("dunno"), '"},7],',
                 '"follow_up_questions":["", "Why ', F.col("trial_id"), '?"],"rationale":"because ',
                 q.cast("string"), '"}')
    sep = F.when(F.col("k") % 4 == 2, "\n").otherwise(",")
    per = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", item.alias("x"))))
                                .alias("xs"))
    body = F.array_join(F.transform("xs", lambda r: r["x"]), "\u0001")
    body = F.regexp_replace(body, "\u0001", F.when(sep == "\n", F.lit(",\n")).otherwise(","))
    k = F.col("k") % 4
    text = (F.when(k == 0, _text("[", body, "]")).when(k == 1, _text('{"labels":[', body, "]}"))
            .when(k == 2, body).otherwise(_text("```json\n[", body, "]\n```")))
    return per.select(F.col("k").alias("response_pos"), text.alias("content"))


@QUERIES.add("parsed_labels", "LBL-03 LBL-05 LBL-10 JON-17 SET-03", _LINES + """
SELECT patient_id || '__' || trial_id AS pair_id, CASE WHEN n = 6 THEN 'uncertain'
    WHEN q % 3 = 0 THEN 'eligible' WHEN q % 3 = 1 THEN 'uncertain' ELSE 'ineligible' END
    AS eligibility,
  CASE WHEN n = 6 THEN 'unknown|unknown' WHEN q % 2 = 0 THEN 'satisfied' ELSE 'unknown' END
    AS statuses,
  CASE WHEN n = 6 THEN 'Repeat the eligibility review with a valid structured output.'
    ELSE 'Why ' || trial_id || '?' END AS questions,
  CASE WHEN n = 6 THEN 'Fallback label caused by missing model output.'
    ELSE 'because ' || q END AS rationale,
  CASE WHEN n = 6 THEN 'fallback' ELSE 'llm' END AS source FROM l""")
def parsed_labels(spark, sf_dir):
    rows = lines(spark, sf_dir)
    pairs = rows.select(*PAIR, F.concat("patient_id", F.lit("__"), "trial_id").alias("pair_id"))
    labels = R.parse_labels(label_texts(spark, sf_dir), pairs)
    crit = criteria_of(rows).select("trial_id", "criterion_pos", "criterion_id").distinct()
    both = labels.unionByName(R.fallback_labels(pairs, labels, crit))
    return both.select(
        "pair_id", "eligibility", F.array_join(F.transform(
            "criterion_results", lambda c: c["status"]), "|").alias("statuses"),
        F.array_join("follow_up_questions", "|").alias("questions"), "rationale", "source")


# --- decisions out of text that does not parse ----------------------------------------------------

@QUERIES.add("loose_decisions", "LBL-02 JON-13 PRD-13", _LINES + """,
d AS (SELECT *, CASE WHEN q % 4 = 3 THEN NULL WHEN q % 4 = 0 THEN 'recommend'
    WHEN q % 4 = 1 THEN 'needs_more_info' ELSE 'not_recommended' END AS loose,
  CASE WHEN n % 2 = 0 THEN CASE WHEN q % 7 = 0 THEN '??' ELSE 'recommend' END END AS top,
  CASE flag WHEN 'A' THEN 'recommend' ELSE 'not_recommended' END AS expected FROM l),
f AS (SELECT *, coalesce(top, loose, '') AS raw FROM d)
SELECT patient_id, trial_id, CASE WHEN raw IN ('', '??') THEN expected ELSE raw END AS decision,
  CASE WHEN raw IN ('', '??') THEN 'deterministic_fallback' WHEN top IS NOT NULL
    THEN 'orchestrator' ELSE 'matcher' END AS source,
  raw IN ('', '??') AS fallback,
  CASE WHEN raw IN ('', '??') THEN expected ELSE raw END = expected AS agrees FROM f""")
def loose_decisions(spark, sf_dir):
    rows = lines(spark, sf_dir)
    q, n = F.col("q"), F.col("n")
    word = F.element_at(F.array(*[F.lit(x) for x in (
        "Recommend", "needs more info", "not-recommended", "perhaps")]), (q % 4 + 1).cast("int"))
    item = _text('{"trial_id" : "', F.col("trial_id"), '", "note": oops, "decision": "', word,
                 '"')
    broken = rows.groupBy("patient_id").agg(_text('{"matches": [', joined(rows, item))
                                            .alias("content"))
    matcher = broken.select("patient_id", F.posexplode(J.loose_decisions("content"))
                            .alias("pos", "d")).select(
        "patient_id", "pos", "d.trial_id", "d.decision",
        F.lit(False).alias("human_review_required"))
    top = rows.filter(n % 2 == 0).select(
        "patient_id", F.col("n").alias("pos"), "trial_id",
        F.when(q % 7 == 0, "??").otherwise("recommend").alias("decision"),
        F.lit(None).cast("boolean").alias("human_review_required"))
    expected = rows.select(*PAIR, F.when(F.col("flag") == "A", "recommend").otherwise(
        "not_recommended").alias("decision"))
    return R.final_decisions(top, matcher, rows, expected).select(
        *PAIR, "decision", "source", "fallback", "agrees")


# --- historic record layouts ------------------------------------------------------------------------

@QUERIES.add("unified_labels", "LBL-06 LBL-07 LBL-08", _LINES + """
SELECT patient_id, trial_id, CASE WHEN k % 4 < 2 THEN n * 10
    ELSE row_number() OVER (PARTITION BY k ORDER BY n) END::INT AS rank,
  CASE flag WHEN 'A' THEN 'eligible' ELSE 'uncertain' END AS eligibility,
  trial_id || '-c:' || CASE WHEN q % 2 = 0 THEN 'satisfied' ELSE 'violated' END || ':why ' || q
    AS criteria, CASE WHEN k % 4 = 3 THEN 'x' ELSE 'e' || n END AS explanation FROM l""")
def unified_labels(spark, sf_dir):
    rows = lines(spark, sf_dir)
    n, q, t = F.col("n"), F.col("q").cast("string"), F.col("trial_id")
    status = F.when(F.col("q") % 2 == 0, "satisfied").otherwise("violated")
    label = F.when(F.col("flag") == "A", "eligible").otherwise("uncertain")
    num = n.cast("string")
    rich = _text('{"rank":', num, '0,"trial_id":"', t, '","eligibility":"', label,
                 '","criterion_results":{"', t, '-c":{"judgment":"', status,
                 '","rationale":"why ', q, '"}},"explanation":"e', num, '"}')
    agent = _text('{"recommendation_rank":"', num, '0","trial_id":"', t, '","final_label":"',
                  label, '","criteria":[["', t, '-c","', status, '","why ', q,
                  '"],["short"]],"summary_reason":"e', num, '"}')
    compact = _text('["', t, '","', label, '",[["', t, '-c","', status, '","why ', q, '"]],"e',
                    num, '"]')
    bare = _text('{"trial_id":"', t, '","label":"', label, '","explanation":"x"}')
    per = rows.groupBy("k", "patient_id").agg(
        *[joined(rows, x).alias(c) for c, x in (("a", rich), ("b", agent), ("c", compact),
                                                ("d", bare))])
    trace = _text('"inference_matching_agent":{"final_output":[', F.col("c"), "]}")
    k = F.col("k") % 4
    body = (F.when(k == 0, _text('"final_output":{"recommendations":[', F.col("a"), "]}"))
            .when(k == 1, _text('"recommendation_agent":{"ranking":[', F.col("b"), "]}"))
            .when(k == 2, trace)
            .otherwise(_text('"final_output":{"recommendations":[', F.col("d"), "]},", trace)))
    items = per.select(F.try_parse_json(_text('{"patient_id":"', F.col("patient_id"), '",', body,
                                              "}")).alias("item"))
    out = R.unify_label_records(items)
    crit = F.transform("criterion_results", lambda c: F.concat_ws(
        ":", c["criterion_id"], c["status"], c["reason"]))
    return out.select("patient_id", "trial_id", "rank", "eligibility",
                      F.array_join(crit, "|").alias("criteria"), "explanation")


@QUERIES.add("embedded_objects", "LBL-04", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS objects,
  'O' || o_orderkey AS first_id FROM orders""")
def embedded_objects(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    text = _text("Reply {broken ", '{"patient_id":"O', k, '","deep":{"a":[1,{"b":"}"}]}} and {"x":1}',
                 _when(F.col("o_orderkey") % 3 != 0, _text('\n{"patient_id":"P', k, '"}')), " {")
    rows = roles.table(spark, sf_dir, "orders").select(
        "o_orderkey", J.embedded_objects(text).alias("found"))
    first = F.get_json_object(F.get("found", F.lit(0)), "$.patient_id")
    return rows.select("o_orderkey", F.size("found").alias("objects"), first.alias("first_id"))


# --- contracts ----------------------------------------------------------------------------------------

def predictions(spark, sf_dir, breaches=True, orders=None):
    """Nested predictions per order, with breaches placed by line number.

    Without ``breaches`` all keep the contract.  ``orders`` (``k``, distinct) names the orders to have a
    prediction, which has no candidates where an order has no lines.
    """
    rows = lines(spark, sf_dir)
    n, q, t = F.col("n"), F.col("q"), F.col("trial_id")

    def breach(cond):
        return cond & F.lit(breaches)
    cand = _text('{"trial_id":"', t, '","trial_title":"T","criteria_to_assess":[{"criterion_id":"',
                 t, '-I-age","criterion_type":"inclusion"}]}')
    label = F.when(breach((n == 1) & (q % 3 == 0)), "perhaps").when(q % 2 == 0, "eligible").otherwise(
        "ineligible")
    crit = _text('{"criterion_id":"', t, F.when(breach(n == 3), "-zzz").otherwise("-I-age"),
                 '","status":"', F.when(breach(n == 4), "fine").otherwise("satisfied"), '"',
                 _when(~breach(n == 5), ',"reason":"r"'), "}")
    row = _text('{"trial_id":"', t, '","eligibility":"', label, '","explanation":"',
                _when(~breach((n == 2) & (q % 2 != 0)), "why"), '","criterion_results":[', crit, "]}")
    good = _text('{"trial_id":"', t, '","eligibility":"eligible","recommendation_reason":"x"}')
    bad = _text('{"trial_id":"', t, '","eligibility":"ineligible","exclusion_reason":"',
                _when(~breach(n == 6), "x"), '"}')
    per = rows.groupBy("k", "patient_id").agg(
        joined(rows, cand).alias("cand"), joined(rows, row, ~breach(n == 7)).alias("final"),
        joined(rows, row).alias("initial"), joined(rows, good, q % 2 == 0).alias("good"),
        joined(rows, bad, q % 2 != 0).alias("bad"))
    if orders is not None:
        texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("cand", "final", "initial", "good", "bad")]
        per = orders.join(shuffled(per), "k", "left").select(
            "k", F.concat(F.lit("O"), F.col("k")).alias("patient_id"), *texts)
    doc = _text(
        '{"patient_id":"', F.col("patient_id"), '","candidate_trials":[', F.col("cand"),
        '],"final_output":{"initial_assessment":{"evaluated_trials":[', F.col("initial"),
        ']},"final_assessment_after_answers":{"evaluated_trials":[', F.col("final"),
        ']},"recommended_trials":[', F.col("good"),
        '],"uncertain_but_actionable_trials":[],"excluded_trials":[', F.col("bad"),
        '],"follow_up_questions":[{"question_id":"Q1"}],"simulated_patient_answers":[',
        '{"question_id":"', F.when(breach(F.col("k") % 6 == 0), "Q2").otherwise("Q1"),
        '","answer":"a"}],"patient_level_summary":"s"',
        _when(~breach(F.col("k") % 5 == 0), ',"medical_disclaimer":"d"'), "}}")
    return per.select(F.from_json(doc, S.PREDICTIONS).alias("r")).select("r.*")


_CONTRACT = _LINES + """,
f AS (SELECT *, CASE WHEN n = 1 AND q % 3 = 0 THEN 'perhaps' WHEN q % 2 = 0 THEN 'eligible'
    ELSE 'ineligible' END AS label FROM l),
o AS (SELECT DISTINCT k FROM l),
e AS (
  SELECT 'missing final_output.medical_disclaimer' AS error, count(*) AS n FROM o WHERE k % 5 = 0
  UNION ALL SELECT 'missing medical disclaimer', count(*) FROM o WHERE k % 5 = 0
  UNION ALL SELECT 'final evaluated trials do not match candidate trials', count(*) FROM l
    WHERE n = 7
  UNION ALL SELECT 'invalid eligibility', count(*) FROM f WHERE label = 'perhaps'
  UNION ALL SELECT 'missing explanation', count(*) FROM f WHERE n = 2 AND q % 2 <> 0
  UNION ALL SELECT 'criterion id set mismatch', count(*) FROM f WHERE n = 3
  UNION ALL SELECT 'invalid criterion status', count(*) FROM f WHERE n = 4
  UNION ALL SELECT 'missing reason', count(*) FROM f WHERE n = 5
  UNION ALL SELECT 'non-eligible final row in recommended_trials', count(*) FROM f
    WHERE q % 2 = 0 AND (n = 7 OR label <> 'eligible')
  UNION ALL SELECT 'answer references missing question', count(*) FROM o WHERE k % 6 = 0
"""


@QUERIES.add("contract_errors", "VAL-01 SET-05 JON-07", _CONTRACT + """)
SELECT error, n FROM e WHERE n > 0""")
def contract_errors(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return A.contract_errors(p, p).select(
        F.regexp_replace("error", "^[^:]*: ", "").alias("error")).groupBy("error").agg(
        F.count(F.lit(1)).alias("n"))


@QUERIES.add("finalized_errors", "VAL-03", _CONTRACT + """
  UNION ALL SELECT 'missing exclusion reason', count(*) FROM f WHERE n = 6 AND q % 2 <> 0)
SELECT error, n FROM e WHERE n > 0""")
def finalized_errors(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return A.finalized_errors(p, p).select(
        F.regexp_replace("error", "^[^:]*: ", "").alias("error")).groupBy("error").agg(
        F.count(F.lit(1)).alias("n"))


@QUERIES.add("batch_label_errors", "VAL-02", _LINES + """,
o AS (SELECT k, count(*) AS c, count(*) FILTER (n <> 7) AS kept FROM l GROUP BY k),
here AS (SELECT * FROM l WHERE n <> 7 AND k % 9 <> 0),
e AS (SELECT 'missing output record' AS error, count(*) AS n FROM o
    WHERE k % 9 = 0 OR kept = 0
  UNION ALL SELECT 'duplicate output record', count(*) FROM o
    WHERE k % 9 <> 0 AND k % 10 = 0 AND kept > 0
  UNION ALL SELECT 'final recommendations do not match candidate trials', count(*) FROM o
    WHERE k % 9 <> 0 AND kept > 0 AND kept < c
  UNION ALL SELECT 'final criterion ids mismatch', count(*) FROM here WHERE n = 3)
SELECT error, n FROM e WHERE n > 0""")
def batch_label_errors(spark, sf_dir):
    rows = lines(spark, sf_dir)
    copies = F.explode(F.when(F.col("k") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1)))).alias("rec_no")
    results = F.transform(F.array(F.lit("-I-age"), F.lit("-E-x")), lambda p: F.struct(
        F.concat("trial_id", F.when(F.col("n") == 3, F.lit("-q")).otherwise(p))
        .alias("criterion_id")))
    labels = rows.filter("n <> 7 AND k % 9 <> 0").select(
        *PAIR, copies, results.alias("criterion_results"))
    e = A.batch_label_errors(labels, rows.select(*PAIR), criteria_of(rows))
    return e.select(F.regexp_replace("error", "^[^:]*: ", "").alias("error")).groupBy("error").agg(
        F.count(F.lit(1)).alias("n"))
