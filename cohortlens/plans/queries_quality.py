"""Audits, summaries, resume logic, cohorts and streams over events, orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import audit as A
from ..operators import evaluation as E
from ..operators import matching as M
from ..operators import ranking as R
from ..operators import responses as RS
from ..operators import rollup as U
from ..operators import summaries as S
from ..session import scratch_path, shuffled, written
from ..sources import readers as RD
from ..sources import sinks as SK
from ..streaming import answers as SA
from ..streaming import scores as SS
from . import queries_loop as QL
from . import queries_responses as QR
from . import roles
from . import roles_sql as Q
from .registry import Registry

QUERIES = Registry()
PAIR = ["patient_id", "trial_id"]


def props_k(c="props"):
    return F.get_json_object(c, "$.k").cast("int")


# --- keys: pending, missing, last, numbered ------------------------------------------------------

@QUERIES.add("pending_keys", "JON-08 STR-01", """
SELECT o_orderkey, o_orderstatus FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def pending_keys(spark, sf_dir):
    done = roles.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return SS.pending(roles.table(spark, sf_dir, "orders"), done, ["o_orderkey"]).select(
        "o_orderkey", "o_orderstatus")


@QUERIES.add("missing_extra", "JON-07 SET-02 SET-03", """
SELECT k, 'missing' AS side FROM (SELECT c_custkey AS k FROM customer
  EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT k, 'extra' FROM (SELECT user_id AS k FROM events EXCEPT
  SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""")
def missing_extra(spark, sf_dir):
    customers = roles.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), "c_acctbal")
    ordered = roles.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    users = roles.table(spark, sf_dir, "events").select(F.col("user_id").alias("k"))
    missing = E.missing_and_extra(customers, ordered, ["k"]).filter("side = 'missing'")
    extra = E.missing_and_extra(customers.filter("c_acctbal >= 0"), users, ["k"])
    return missing.unionByName(extra.filter("side = 'extra'"))


@QUERIES.add("dedupe_last", "RNK-07", """
SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id,
  arg_max(props, (ts, event_id)) AS props FROM events GROUP BY ALL""")
def dedupe_last(spark, sf_dir):
    rows = roles.table(spark, sf_dir, "events")
    last = R.keep_last(rows, ["user_id", "event_type"], F.struct("ts", "event_id"))
    return last.select("user_id", "event_type", "event_id", "props")


@QUERIES.add("id_batches", "SNK-04", """
SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS row_no,
  (floor((row_number() OVER (ORDER BY doc_id) - 1) / 64) + 1)::INT AS batch FROM documents""")
def id_batches(spark, sf_dir):
    docs = roles.table(spark, sf_dir, "documents").select("doc_id")
    return R.batches(docs, "doc_id", 64).select(
        "doc_id", F.col("row_no").cast("bigint").alias("row_no"), "batch")


@QUERIES.add("question_order", "RNK-08", """
SELECT question_id, CASE WHEN event_id % 3 = 0 THEN 9223372036854775807 ELSE event_id % 50 END::BIGINT AS order_key
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'x-Q' || event_id % 50
  ELSE 'U' || user_id || '-Q' || event_id % 50 END AS question_id FROM events)""")
def question_order(spark, sf_dir):
    e = F.col("event_id")
    number = (e % 50).cast("string")
    patient = F.concat(F.lit("U"), F.col("user_id").cast("string"))
    qid = F.when(e % 3 == 0, F.concat(F.lit("x-Q"), number)).otherwise(
        F.concat(patient, F.lit("-Q"), number))
    rows = roles.table(spark, sf_dir, "events").select(
        patient.alias("patient_id"), qid.alias("question_id"))
    return rows.select("question_id",
                       R.numeric_suffix_key("question_id", "patient_id").alias("order_key"))


@QUERIES.add("coverage_fill", "JON-09", """
WITH l AS (SELECT l_orderkey AS k, min(l_shipdate) AS first_ship, count(*) AS n FROM lineitem
  GROUP BY 1)
SELECT o_orderkey, coalesce(n, 0) AS lines, n IS NULL AS filled,
  CASE WHEN n IS NULL THEN 'unknown' WHEN n > 3 THEN 'satisfied' ELSE 'violated' END AS status
FROM orders LEFT JOIN l ON k = o_orderkey""")
def coverage_fill(spark, sf_dir):
    expected = roles.table(spark, sf_dir, "orders").select("o_orderkey")
    actual = roles.table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = RS.fill_expected(expected, actual, ["o_orderkey"])
    return rows.select(
        "o_orderkey", F.coalesce("n", F.lit(0)).alias("lines"), "filled",
        F.when(F.col("filled"), "unknown").when(F.col("n") > 3, "satisfied")
        .otherwise("violated").alias("status"))


@QUERIES.add("overlay_rows", "JON-10", Q.with_roles(*Q.LOOP) + """,
i AS (SELECT patient_id, trial_id, part, status FROM verdicts WHERE rules = 'new'
  AND phase = 'initial'),
f AS (SELECT patient_id, trial_id, part, status FROM verdicts WHERE rules = 'old'
  AND phase = 'final' AND ctype = 'inclusion')
SELECT CASE WHEN f.part IS NULL THEN 'initial' ELSE 'final' END AS source,
  coalesce(f.status, i.status) AS status, count(*) AS n
FROM i FULL JOIN f USING (patient_id, trial_id, part) GROUP BY ALL""")
def overlay_rows(spark, sf_dir):
    # both sides of a pair are judged in one pass, the rows of neither are moved
    rows = QL.judgments(spark, sf_dir, rules=("new", "old"), by_pair=True)
    final = (F.col("rules") == "old") & (F.col("phase") == "final") & (F.col("criterion_type") == "inclusion")
    first = (F.col("rules") == "new") & (F.col("phase") == "initial")
    return RS.overlay_criteria(rows.filter(first | final), final).groupBy("source", "status").agg(
        F.count(F.lit(1)).alias("n"))


# --- event-based run reports ------------------------------------------------------------------------

def calls(spark, sf_dir):
    """Events read as model calls: six in a row are one patient's run, the type is the agent."""
    k = props_k()
    usage = F.to_json(F.struct(
        F.when(F.col("event_id") % 2 == 0, k).alias("input_tokens"),
        F.when(F.col("event_id") % 2 != 0, k).alias("prompt_tokens"),
        (k - 10).alias("output_tokens"),
        F.when(F.col("event_id") % 5 == 0, F.lit(7)).alias("total_tokens"),
        F.struct((k % 3).alias("cached_tokens")).alias("prompt_tokens_details")))
    return roles.texts(spark, sf_dir, "events").select(
        F.concat(F.lit("R"), F.floor(F.col("event_id") / 6).cast("string")).alias("patient_id"),
        F.col("event_type").alias("agent"), F.col("event_id").alias("call_pos"),
        (F.col("event_type") != "error").alias("ok"), (k % 4 != 0).alias("json_ok"),
        F.when(F.col("event_type") == "error", "500").otherwise("200").alias("http_status"),
        F.when(k < 5, F.concat(F.lit("t"), k.cast("string"))).alias("retry_after"),
        F.round(F.col("value") * 100).cast("bigint").alias("ms"),
        F.lit("failed").alias("error"),
        S.usage_of(F.try_parse_json(usage)).alias("token_usage"))


_CALLS = """WITH c AS (SELECT *, (props->>'$.k')::INT AS k, 'R' || event_id // 6 AS patient_id,
    event_type <> 'error' AS ok, round(value * 100)::BIGINT AS ms FROM events)
"""


@QUERIES.add("usage_rollup", "AGG-12", _CALLS + """,
u AS (SELECT event_type AS agent, 'prompt_tokens' AS counter, k::BIGINT AS tokens FROM c
  UNION ALL SELECT event_type, 'completion_tokens', k - 10 FROM c WHERE k >= 10
  UNION ALL SELECT event_type, 'total_tokens', CASE WHEN event_id % 5 = 0 THEN 7 ELSE k + k - 10
    END FROM c WHERE event_id % 5 = 0 OR k >= 10
  UNION ALL SELECT event_type, 'cached_tokens', k % 3 FROM c)
SELECT agent, counter, sum(tokens)::BIGINT AS tokens, count(*) AS calls FROM u
GROUP BY GROUPING SETS ((agent, counter), (counter))""")
def usage_rollup(spark, sf_dir):
    return S.usage_rollup(calls(spark, sf_dir))


@QUERIES.add("call_report", "AGG-15", _CALLS + f""",
r AS (SELECT event_type AS agent, count(*) AS calls, count(*) FILTER (NOT ok) AS failed_calls,
    count(*) FILTER (k % 4 <> 0) AS parsed,
    coalesce(array_to_string(list_sort(list(DISTINCT 't' || k) FILTER (k < 5)), ','), '')
    AS retries FROM c GROUP BY 1)
SELECT *, {Q.round_exact('parsed / calls', 3)} AS json_parse_rate FROM r""")
def call_report(spark, sf_dir):
    r = S.call_report(calls(spark, sf_dir), ["agent"])
    return r.withColumn("retries", F.array_join("retry_values", ",")).drop("retry_values")


@QUERIES.add("merged_calls", "AGG-16", _CALLS + """
SELECT patient_id, bool_and(ok AND k % 4 <> 0) AS ok, CASE WHEN bool_and(ok AND k % 4 <> 0)
    THEN '200' ELSE string_agg(CASE WHEN ok THEN '200' ELSE '500' END, ',' ORDER BY event_id) END
    AS http_status, sum(ms)::BIGINT AS ms,
  coalesce(string_agg(event_type || ': failed', '; ' ORDER BY event_id)
    FILTER (NOT (ok AND k % 4 <> 0)), '') AS error, count(*) AS calls
FROM c GROUP BY patient_id""")
def merged_calls(spark, sf_dir):
    return S.merged_calls(calls(spark, sf_dir))


@QUERIES.add("latency_percentiles", "AGG-13", _CALLS + """,
r AS (SELECT event_type AS agent, ms, row_number() OVER (PARTITION BY event_type ORDER BY ms) - 1
    AS i, count(*) OVER (PARTITION BY event_type) AS n FROM c),
p AS (SELECT unnest([0.5, 0.95])::DOUBLE AS p)
SELECT agent, p, ms AS percentile FROM r, p WHERE i = floor((n - 1) * p)""")
def latency_percentiles(spark, sf_dir):
    return S.latency_percentiles(calls(spark, sf_dir), ["agent"])


@QUERIES.add("label_report", "AGG-15 AGG-14", Q.with_roles(Q.EVIDENCE, Q.JUDGED) + f""",
l AS (SELECT CASE flag WHEN 'A' THEN decision WHEN 'N' THEN 'recommend' ELSE 'huh' END AS label,
    decision, retrieval_pos % 7 = 0 AS fallback FROM judged),
r AS (SELECT count(*) AS labels, count(*) FILTER (label <> 'huh') AS valid,
    count(*) FILTER (label <> 'huh' AND label = decision) AS agreed,
    count(*) FILTER (fallback) AS fallbacks FROM l)
SELECT *, {Q.round_exact('valid / labels', 3)} AS valid_rate,
  {Q.round_exact('agreed / valid', 3)} AS agreement_rate,
  {Q.round_exact('fallbacks / labels', 3)} AS fallback_rate FROM r""")
def label_report(spark, sf_dir):
    flags = roles.ordered_parts(spark, sf_dir).select(
        F.concat(F.lit("P"), X.padded(F.col("o_custkey"), 12))
        .alias("patient_id"),
        F.concat(F.lit("T"), X.padded(F.col("l_partkey"), 12))
        .alias("trial_id"), "flag", (F.col("l_partkey") % 7 == 0).alias("fallback"))
    decided = M.decide(M.judge_pairs(flags, roles.patients(spark, sf_dir),
                                     roles.trials(spark, sf_dir), detail=False))
    label = F.when(F.col("flag") == "A", F.col("decision")).when(
        F.col("flag") == "N", "recommend").otherwise("huh")
    rows = decided.select(label.alias("label"), "decision", "fallback")
    return S.label_report(rows.select(F.col("label").alias("decision"), "fallback",
                                      (F.col("label") == F.col("decision")).alias("agrees")))


@QUERIES.add("run_summary", "AGG-11", Q.with_roles(*Q.LOOP, Q.ROLLED) + """,
a AS (SELECT * FROM rolled WHERE rules = 'new' AND phase = 'final'),
v AS (SELECT * FROM verdicts WHERE rules = 'new' AND phase = 'final')
SELECT 'patient_count' AS dimension, '' AS value, count(DISTINCT patient_id) AS n FROM a
UNION ALL SELECT 'final_trial_judgment_count', '', count(*) FROM a
UNION ALL SELECT 'follow_up_question_count', '', count(*) FROM v WHERE status = 'unknown'
UNION ALL SELECT 'simulated_patient_answer_count', '', count(*) FROM answers
UNION ALL SELECT 'eligibility', eligibility, count(*) FROM a GROUP BY ALL
UNION ALL SELECT 'status', status, count(*) FROM v GROUP BY ALL""")
def run_summary(spark, sf_dir):
    v = QL.judgments(spark, sf_dir, phases=("final",))
    return S.run_summary(U.roll_up(v, na_policy="accept"), v, v.filter("status = 'unknown'"),
                         QL.answers(spark, sf_dir))


@QUERIES.add("run_invariants", "VAL-10", _CALLS + """,
n AS (SELECT patient_id, count(*) AS n FROM c GROUP BY 1)
SELECT * FROM (
  SELECT 'expected 6 calls' AS error, count(*) AS n FROM n WHERE n <> 6
  UNION ALL SELECT event_type || ': API call failed', count(*) FROM c WHERE NOT ok GROUP BY 1
  UNION ALL SELECT event_type || ': JSON parse failed', count(*) FROM c WHERE k % 4 = 0
    GROUP BY 1) WHERE n > 0""")
def run_invariants(spark, sf_dir):
    e = A.run_errors(calls(spark, sf_dir))
    return e.select(F.regexp_replace("error", ", found.*", "").alias("error")).groupBy(
        "error").agg(F.count(F.lit(1)).alias("n"))


#: the tables' columns by name, as SQL text
_CANONICAL = {
    "customer": ["c_acctbal::DECIMAL(38,6)", "c_custkey", "c_mktsegment", "c_name", "c_nationkey"],
    "part": ["p_brand", "p_name", "p_partkey", "p_retailprice::DECIMAL(38,6)", "p_size", "p_type"],
    "orders": ["o_custkey", "epoch_us(o_orderdate)", "o_orderkey", "o_orderpriority", "o_orderstatus",
               "o_totalprice::DECIMAL(38,6)"],
    "lineitem": ["l_discount::DECIMAL(38,6)", "l_extendedprice::DECIMAL(38,6)", "l_linenumber",
                 "l_linestatus", "l_orderkey", "l_partkey", "l_quantity::DECIMAL(38,6)", "l_returnflag",
                 "epoch_us(l_shipdate)", "l_suppkey", "l_tax::DECIMAL(38,6)"],
    "events": ["event_id", "event_type", "props", "epoch_us(ts)", "user_id", "value::DECIMAL(38,6)"],
    "documents": ["doc_id", "lang", "n_chars", "source", "text"],
}


def _fingerprint_sql(name: str) -> str:
    row = " || '|' || ".join(f"coalesce(({c})::VARCHAR, 'null')" for c in _CANONICAL[name])
    piece = "coalesce(sum(('0x' || substr(h, {}, 8))::BIGINT), 0)::BIGINT"
    return (f"SELECT 'table' AS kind, '{name}' AS name, count(*) || ':' || {piece.format(1)} || ':' || "
            f"{piece.format(9)} AS value FROM (SELECT sha256({row}) AS h FROM {name})")


@QUERIES.add("table_fingerprints", "SNK-06", " UNION ALL ".join(map(_fingerprint_sql, _CANONICAL))
             + " UNION ALL SELECT 'setting', 'top_k', '10'")
def table_fingerprints(spark, sf_dir):
    names = ("customer", "part", "orders", "lineitem", "events", "documents")
    return S.manifest({n: roles.table(spark, sf_dir, n) for n in names}, {"top_k": "10"})


# --- forbidden material ---------------------------------------------------------------------------------

@QUERIES.add("secret_scan", "VAL-07", """
SELECT doc_id, no::INT AS pattern_no, n::INT AS n FROM (
  SELECT doc_id, 0 AS no, len(regexp_extract_all(text, '\\b[0-9a-f]{40}\\b')) AS n FROM documents
  UNION ALL SELECT doc_id, 1, len(regexp_extract_all(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+'))
    FROM documents
  UNION ALL SELECT doc_id, 2, len(regexp_extract_all(text, 'sk-[A-Za-z0-9]{20,}'))
    FROM documents) WHERE n > 0""")
def secret_scan(spark, sf_dir):
    patterns = [r"\b[0-9a-f]{40}\b", r"[A-Za-z0-9.]+@[A-Za-z0-9.]+", A.K.SECRET_PATTERNS[0]]
    return A.scan_secrets(roles.table(spark, sf_dir, "documents"), "text", "doc_id", patterns)


def event_records(spark, sf_dir):
    """A candidate record per event, with material outside the allow-lists placed by number."""
    e = F.col("event_id")
    w = lambda n, text: F.when(e % n == 0, F.lit(text)).otherwise(F.lit(""))
    doc = F.concat(
        F.lit('{"patient_id":"U'), F.col("user_id").cast("string"),
        F.lit('","patient_information_string":"'), F.when(e % 11 == 0, "").otherwise("note"),
        F.lit('","candidate_trials":['), F.when(e % 13 == 0, "").otherwise(F.concat(
            F.lit('{"trial_id":"T1","phase":"'), w(7, "see gold_label"), F.lit('"'),
            w(5, ',"raw_criteria_excerpt":{"inclusion":[],"answer_key":{"deep":[{"gold_label":1}]}}'),
            F.lit(',"criteria_to_assess":[{"criterion_id":"c1"'), w(3, ',"weight":2'),
            F.lit("}]}"))),
        F.lit("]"), w(17, ',"agent_trace":{}'), F.lit("}"))
    return roles.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("record_no"), doc.alias("record"))


@QUERIES.add("blinded_audit", "VAL-05 VAL-06", """
WITH e AS (SELECT event_id AS e, event_id % 13 <> 0 AS t FROM events)
SELECT error, n FROM (
  SELECT 'top-level keys mismatch' AS error, count(*) AS n FROM e WHERE e % 17 = 0
  UNION ALL SELECT 'patient_information_string must be a non-empty string', count(*) FROM e
    WHERE e % 11 = 0
  UNION ALL SELECT 'candidate_trials must be a non-empty list', count(*) FROM e WHERE NOT t
  UNION ALL SELECT 'candidate_trials[0].raw_criteria_excerpt has unexpected keys', count(*) FROM e
    WHERE t AND e % 5 = 0
  UNION ALL SELECT 'candidate_trials[0].criteria_to_assess[0] has unexpected keys', count(*)
    FROM e WHERE t AND e % 3 = 0
  UNION ALL SELECT '$.candidate_trials[0].raw_criteria_excerpt.answer_key is forbidden in blinded'
    || ' input', count(*) FROM e WHERE t AND e % 5 = 0
  UNION ALL SELECT '$.candidate_trials[0].raw_criteria_excerpt.answer_key.deep[0].gold_label is '
    || 'forbidden in blinded input', count(*) FROM e WHERE t AND e % 5 = 0
  UNION ALL SELECT '$.candidate_trials[0].phase contains evaluator-only field text', count(*)
    FROM e WHERE t AND e % 7 = 0
  UNION ALL SELECT '$.agent_trace is forbidden in blinded input', count(*) FROM e
    WHERE e % 17 = 0) WHERE n > 0""")
def blinded_audit(spark, sf_dir):
    e = A.blinded_errors(event_records(spark, sf_dir), key="record_no")
    return e.select(F.regexp_replace("error", ": \\[.*", "").alias("error")).groupBy("error").agg(
        F.count(F.lit(1)).alias("n"))


@QUERIES.add("forbidden_paths", "VAL-06", """
SELECT event_id::VARCHAR AS record_no, unnest(['$.candidate_trials[0].raw_criteria_excerpt.'
  || 'answer_key', '$.candidate_trials[0].raw_criteria_excerpt.answer_key.deep[0].gold_label'])
  AS path FROM events WHERE event_id % 5 = 0 AND event_id % 13 <> 0""")
def forbidden_paths(spark, sf_dir):
    hits = A.scan_keys(event_records(spark, sf_dir), key="record_no",
                       exact=A.K.RUN_FORBIDDEN_KEYS, fragments=A.K.RUN_FORBIDDEN_FRAGMENTS,
                       value_pattern=None, fold_case=True)
    return hits.select(F.col("patient_id").alias("record_no"), "path")


@QUERIES.add("json_line_checks", "VAL-08", """
SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'invalid JSON' ELSE 'row is not an object' END
  AS error FROM events WHERE event_id % 6 IN (1, 2)""")
def json_line_checks(spark, sf_dir):
    e = F.col("event_id") % 6
    text = (F.when(e == 0, "  ").when(e == 1, F.concat("props", F.lit(" }")))
            .when(e == 2, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props")))
    rows = roles.table(spark, sf_dir, "events").select("event_id", text.alias("value"))
    return A.json_line_errors(rows, "event_id")


@QUERIES.add("path_terms", "VAL-11", """
SELECT url AS path, 'hidden_eval' AS term FROM (SELECT url || CASE WHEN page_id % 4 = 0
  THEN '/Hidden_Eval/x.json' ELSE '' END AS url, page_id FROM pages) WHERE page_id % 4 = 0""")
def path_terms(spark, sf_dir):
    path = F.concat("url", F.when(F.col("page_id") % 4 == 0, "/Hidden_Eval/x.json").otherwise(""))
    return A.path_errors(roles.table(spark, sf_dir, "pages").select(path.alias("path")))


# --- cohorts ------------------------------------------------------------------------------------------------

# --- streams ------------------------------------------------------------------------------------------------

@QUERIES.add("stream_scores", "STR-01 JON-08", Q.with_roles(Q.EVIDENCE, Q.JUDGED) + """
SELECT patient_id, trial_id, score, decision FROM judged""")
def stream_scores(spark, sf_dir):
    """Line items arrive as a stream; new customer-part pairs are judged once."""
    path = f"{sf_dir}/lineitem.parquet"
    items = spark.readStream.schema(spark.read.parquet(path).schema).parquet(
        f"{sf_dir}/lineitem*.parquet").select("l_orderkey", "l_partkey")
    orders = roles.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    patients, trials = roles.patients(spark, sf_dir), roles.trials(spark, sf_dir)
    arrivals = items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).select(
        roles._pid("o_custkey").alias("patient_id"), roles._tid("l_partkey").alias("trial_id"))

    def score(batch):
        return M.decide(M.judge_pairs(batch, patients, trials, detail=False)).select(
            *PAIR, "score", "decision")
    sink = scratch_path(spark, "scores")
    SS.score_stream(arrivals, score, PAIR, sink, scratch_path(spark, "scores-log")
                    ).awaitTermination()
    return SS.results(spark, sink)


@QUERIES.add("stream_answers", "STR-02 QST-06", Q.with_roles(*Q.LOOP) + """
SELECT patient_id, a_ecog AS ecog, a_stage AS stage, coalesce(a_platinum::VARCHAR, '?') AS platinum,
  coalesce(a_organ_transplant::VARCHAR, '?') AS transplant FROM stated""")
def stream_answers(spark, sf_dir):
    """Events arrive as answers; the facts they state are kept current per patient."""
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(
        f"{sf_dir}/events*.parquet")
    rows = QL.answer_rows(stream)
    sink = scratch_path(spark, "facts")
    SA.answer_stream(rows, F.col("ans_pos"), sink, scratch_path(spark, "facts-log")
                     ).awaitTermination()
    f = SA.current_facts(spark, sink)
    return f.select("patient_id", F.col("a_ecog").alias("ecog"), F.col("a_stage").alias("stage"),
                    QL.bool_text(F.col("a_platinum")).alias("platinum"),
                    QL.bool_text(F.col("a_organ_transplant")).alias("transplant"))


# --- files written and read back ------------------------------------------------------------------------

@QUERIES.add("answers_from_files", "SRC-02 SRC-07 SNK-01", """
SELECT 'U' || user_id AS patient_id, max(event_id) AS question_id, arg_max(event_type, event_id) AS answer
FROM events GROUP BY user_id""")
def answers_from_files(spark, sf_dir):
    """Answers written as several JSON-lines files; the last one of each patient is read back."""
    rows = roles.table(spark, sf_dir, "events").repartitionByRange(7, "event_id").sortWithinPartitions(
        "event_id").select(F.concat(F.lit("U"), "user_id").alias("patient_id"), F.array(F.struct(
            F.col("event_id").cast("string").alias("question_id"), F.col("event_type").alias("answer"),
            F.lit("file").alias("source"))).alias("simulated_patient_answers"))
    path = scratch_path(spark, "answers")
    SK.write_lines(rows, path)
    return RD.read_answers(spark, path).select(
        "patient_id", F.col("question_id").cast("bigint").alias("question_id"), "answer")


@QUERIES.add("batches_from_files", "SRC-06 SNK-04 RNK-07", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 10 ELSE (doc_id % 8 + 2)::INT END AS batch_no,
  CASE WHEN doc_id % 5 = 0 THEN 'corrected' ELSE lang END AS lang,
  ((row_number() OVER (ORDER BY doc_id) - 1) // 50 + 1)::INT AS batch FROM documents""")
def batches_from_files(spark, sf_dir):
    """Numbered batches, written in a folder each and read by number; a corrected row of the last one
    replaces the row of an earlier one.  What is kept is cut into batches of 50, written and read."""
    docs = roles.table(spark, sf_dir, "documents").select("doc_id", "lang")
    first = docs.withColumn("batch", F.col("doc_id") % 8 + 2)
    again = docs.where("doc_id % 5 = 0").select(
        "doc_id", F.lit("corrected").alias("lang"), F.lit(10).cast("bigint").alias("batch"))
    folder = scratch_path(spark, "numbered")
    first.unionByName(again).write.partitionBy("batch").json(folder)
    numbered = RD.read_batches(spark, f"{folder}/batch=*", "doc_id BIGINT, lang STRING")
    last = R.keep_last(numbered, ["doc_id"], F.struct("batch_no", "line_pos"))
    path = scratch_path(spark, "batches")
    SK.write_batches(last.select("doc_id", "batch_no", "lang"), "doc_id", 50, path)
    return spark.read.schema("batch INT, batch_no INT, doc_id BIGINT, lang STRING").json(path)


def expected_candidates(spark, sf_dir):
    """What every order's prediction must cover: its lines, each with the criterion to be assessed.

    An order has few lines, so its candidates fit in its row.
    """
    own = QR.lines(spark, sf_dir).groupBy("k").agg(F.collect_set("trial_id").alias("trials"))
    orders = roles.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).distinct()
    return orders.join(shuffled(own), "k", "left").select(
        F.concat(F.lit("O"), F.col("k")).alias("patient_id"),
        F.transform(F.coalesce("trials", X.no_strings()), lambda t: F.struct(
            t.alias("trial_id"), F.array(F.struct(F.concat(t, F.lit("-I-age")).alias("criterion_id")))
            .alias("criteria_to_assess"))).alias("candidate_trials"))


@QUERIES.add("gated_run", "EVL-11 VAL-01 EVL-07", """
SELECT 0::BIGINT AS errors, count(DISTINCT o_orderkey) AS checked FROM orders""")
def gated_run(spark, sf_dir):
    """The contract audit over the predictions of all orders, and the gate behind it.

    What is expected comes from orders and their lines, not from the predictions: a missing or surplus
    order, line or criterion is an error like any other breach.  The job fails if there is one,
    else it tells how many predictions were checked.
    """
    orders = roles.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).distinct()
    p = written(QR.predictions(spark, sf_dir, breaches=False, orders=orders), "gated")
    gold = expected_candidates(spark, sf_dir)
    absent = E.missing_and_extra(gold, p, ["patient_id"]).select(
        "patient_id", F.concat("patient_id", F.lit(": prediction is "), "side").alias("error"))
    return A.gate(A.contract_errors(p, gold).unionByName(absent), p)
