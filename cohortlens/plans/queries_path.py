"""The main path: notes find trials, pairs are judged and ranked, open facts become questions.

Every customer's note searches the sections of all parts; no pairs are given.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import matching as M
from ..operators import ranking as R
from ..operators import registry as G
from ..operators import retrieval as T
from ..session import scratch_path, shuffled, spread
from ..sources import sinks as SK
from . import queries_matching as QM
from . import recommend as RC
from . import roles
from . import roles_sql as Q
from .registry import Registry

QUERIES = Registry()


def _path(*parts: str) -> str:
    return "WITH " + ",\n".join([Q.PATIENTS, Q.TRIALS, *parts])


# --- retrieve, judge, rank, ask --------------------------------------------------------------------

_FOUND_PAIRS = """pairs AS (SELECT query_id AS patient_id, trial_id, score AS retrieval_score,
  trial_pos AS retrieval_pos, NULL::VARCHAR AS flag FROM found)"""


@QUERIES.add("recommend_from_notes", "JON-01 PRD-14 RET-03 RNK-01 QST-01 AGG-03", _path(
    Q.NOTES, Q.SECTIONS, Q.found(30, True), _FOUND_PAIRS, Q.EVIDENCE, Q.JUDGED) + """
, ranked AS (SELECT j.*, row_number() OVER (PARTITION BY patient_id ORDER BY score DESC,
    (decision = 'recommend') DESC, retrieval_pos) AS rank FROM judged j),
asked AS (SELECT patient_id, trial_id, k, CASE
    WHEN criterion = 'field:diagnosis' THEN 'What is the confirmed diagnosis?'
    WHEN criterion = 'field:stage' THEN 'What is the current disease stage?'
    WHEN criterion = 'field:ecog' THEN 'What is the current ECOG performance status?'
    WHEN criterion = 'field:age' THEN 'What is the patient''s age?'
    WHEN criterion = 'field:sex' THEN 'What sex is recorded for trial eligibility purposes?'
    WHEN criterion = 'field:prior_treatments'
      THEN 'Which prior systemic treatments has the patient received?'
    WHEN criterion LIKE 'field:%' THEN 'What is the patient''s ' || substr(criterion, 7) || '?'
    WHEN criterion LIKE 'biomarker:%'
      THEN 'What is the patient''s ' || substr(criterion, 11) || ' biomarker result?'
    ELSE 'Does the patient have ' || replace(substr(criterion, 6), '_', ' ') || '?' END AS question
  FROM ev WHERE status = 'missing'),
once AS (SELECT patient_id, trial_id, question, min(k) AS k FROM asked GROUP BY ALL),
listed AS (SELECT patient_id, trial_id, string_agg(question, ' ' ORDER BY k) AS questions FROM once
  GROUP BY ALL)
SELECT r.patient_id, r.trial_id, rank::INT AS rank, score, decision, matched, missing, conflicts,
  coalesce(questions, '') AS questions, CASE decision WHEN 'recommend' THEN
      'Eligible-looking match across ' || matched || ' checked criteria.'
    WHEN 'needs_more_info' THEN
      'Potential match, but ' || missing || ' required criteria need confirmation.'
    ELSE 'Not recommended because ' || conflicts || ' conflicts and ' || missing
      || ' missing items were found.' END AS rationale
FROM ranked r LEFT JOIN listed USING (patient_id, trial_id) WHERE rank <= 3""")
def recommend_from_notes(spark, sf_dir):
    """The three best open trials of every patient among the thirty that the note finds."""
    best = RC.recommend(spread(roles.patients(spark, sf_dir)),
                        M.recruiting_only(spread(roles.trials(spark, sf_dir))))
    return best.select("patient_id", "trial_id", "rank", "score", "decision", "matched", "missing",
                       "conflicts", F.array_join("questions", " ").alias("questions"), "rationale")


_TARGETED = Q.with_roles(Q.EVIDENCE, Q.JUDGED, Q.NOTES, Q.SECTIONS, Q.found(10, False))


def _targeted(spark, sf_dir):
    """Patients whose known trial is the first of those ordered, and the pairs decided for them."""
    targets = roles.pair_columns(spark, sf_dir).groupBy("patient_id").agg(
        F.min("trial_id").alias("target_trial_id"))
    patients = spread(roles.patients(spark, sf_dir)).drop("target_trial_id").join(
        shuffled(targets), "patient_id", "left")
    return RC.candidate_job(patients, spread(roles.trials(spark, sf_dir)), QM.decided_pairs(spark, sf_dir))


@QUERIES.add("retrieval_recall", "RET-08 EVL-08", _TARGETED + f""",
targets AS (SELECT patient_id, min(trial_id) AS trial_id FROM pairs GROUP BY patient_id),
expected AS (SELECT patient_id, trial_id, 'recommend' AS kind FROM judged WHERE decision = 'recommend'
  UNION ALL SELECT patient_id, trial_id, 'potential' FROM judged WHERE decision <> 'not_recommended'
  UNION ALL SELECT patient_id, trial_id, 'target' FROM targets),
c AS (SELECT kind, count(rk) AS hits, count(*) AS expected FROM expected e
  LEFT JOIN found f ON f.query_id = e.patient_id AND f.trial_id = e.trial_id GROUP BY kind)
SELECT kind, hits, expected, {Q.round_exact('hits / expected', 3)} AS recall FROM c""")
def retrieval_recall(spark, sf_dir):
    """How many of the expected trials the notes find, by kind of expectation."""
    return _targeted(spark, sf_dir)[1]


@QUERIES.add("retrieved_labels", "RET-08 AGG-06", _TARGETED + """
SELECT query_id AS patient_id, f.trial_id, rk::INT AS retrieval_rank, f.score AS retrieval_score,
  decision, j.score, CASE decision WHEN 'recommend' THEN 'eligible' WHEN 'needs_more_info'
    THEN 'uncertain' WHEN 'not_recommended' THEN 'ineligible' ELSE 'uncertain' END AS eligibility
FROM found f LEFT JOIN judged j ON j.patient_id = f.query_id AND j.trial_id = f.trial_id""")
def retrieved_labels(spark, sf_dir):
    """The trials that notes find, with their label; what was never judged is uncertain."""
    return _targeted(spark, sf_dir)[0].select(
        "patient_id", "trial_id", "retrieval_rank", "retrieval_score", "decision", "score",
        "eligibility")


@QUERIES.add("context_blocks", "RET-06 RET-05", _path(Q.NOTES, Q.SECTIONS, Q.found(5, False)) + """,
hits AS (SELECT f.query_id, f.trial_id, chunk_pos, sum(qtf * idf * tf)::BIGINT AS s FROM found f
  JOIN q USING (query_id) JOIN idf USING (token) JOIN tf ON tf.trial_id = f.trial_id
    AND tf.token = q.token GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, trial_id ORDER BY s DESC, chunk_pos) AS n
  FROM hits),
names AS (SELECT query_id, trial_id, string_agg(section, ', ' ORDER BY n) AS top_sections
  FROM best JOIN sections USING (trial_id, chunk_pos) WHERE n <= 3 GROUP BY ALL),
body AS (SELECT trial_id, title, string_agg(text, chr(10) ORDER BY chunk_pos) AS body FROM sections
  GROUP BY ALL)
SELECT query_id, trial_id, rk::INT AS retrieval_rank, md5('--- ' || trial_id || ' | RAG score '
  || score || ' ---' || chr(10) || 'Title: ' || title || chr(10) || 'Top retrieved sections: '
  || top_sections || chr(10) || body) AS context_md5
FROM found JOIN names USING (query_id, trial_id) JOIN body USING (trial_id)""")
def context_blocks(spark, sf_dir):
    """The text block of each trial that a note finds, with its best sections named."""
    sections = T.trial_sections(spread(roles.trials(spark, sf_dir)))
    chunks = T.index_tokens(sections)
    postings, stats = T.build_postings(chunks)
    queries = roles.notes(spark, sf_dir).select(
        F.col("patient_id").alias("query_id"), F.col("note").alias("text"))
    found = T.retrieve(queries, postings, stats, 5)
    best = T.top_chunks(found, queries, chunks, stats)
    return T.context_blocks(found, best, sections).select(
        "query_id", "trial_id", "retrieval_rank", F.md5("context").alias("context_md5"))


# --- registry pages ---------------------------------------------------------------------------------------

#: conditions searched for, in this order; a study is listed under one by its type and maybe a second by size
SEARCHED = ["promo", "small", "large", "medium", "standard", "economy"]
STUDIES = 500


def _named(**fields):
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def registry_pages(spark, sf_dir):
    """Pages of studies a condition, as a registry search returns them (a page spans 200 part keys)."""
    part = roles.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    study = _named(protocolSection=_named(
        identificationModule=_named(
            nctId=F.when(k % 97 != 0, roles._tid("p_partkey")), briefTitle=F.col("p_name")),
        statusModule=_named(
            overallStatus=F.when(k % 7 == 0, "COMPLETED").when(k % 7 != 1, "Recruiting")),
        eligibilityModule=_named(
            minimumAge=F.concat(F.col("p_size").cast("string"), F.lit(" Years")), sex=F.lit("ALL"),
            eligibilityCriteria=F.concat(F.lit("Inclusion Criteria:\n- "), "p_name",
                                         F.lit("\nExclusion Criteria:\n- "), "p_brand"))))
    second = F.element_at(F.array(*[F.lit(c) for c in SEARCHED]),
                          (F.col("p_size") % len(SEARCHED) + 1).cast("int"))
    under = F.array_distinct(F.array(F.lower("p_type"), second))
    listed = part.select(k.alias("k"), study.alias("study"), F.explode(under).alias("condition"))
    return listed.groupBy("condition", F.floor(F.col("k") / 200).cast("int").alias("page_no")).agg(
        F.transform(F.array_sort(F.collect_list(_named(
            k=F.col("k"), study=F.col("study")))), lambda x: x["study"])
        .alias("studies"))


def _chosen() -> str:
    """The conditions choose one after the other, each what is left by those before."""
    quota = -(-STUDIES // len(SEARCHED))
    steps, before = [], "SELECT NULL::BIGINT AS k WHERE false"
    for i, name in enumerate(SEARCHED):
        steps.append(f"""c{i} AS (SELECT {i} AS condition_no, k FROM usable WHERE condition = '{name}'
  AND k NOT IN ({before}) ORDER BY k LIMIT {quota})""")
        before = " UNION ALL ".join(f"SELECT k FROM c{j}" for j in range(i + 1))
    return ",\n".join(steps)


@QUERIES.add("registry_selection", "SRC-05 SNK-01 NRM-07", f"""
WITH names AS (SELECT {SEARCHED} AS searched),
listed AS (SELECT p_partkey AS k, unnest(list_distinct([lower(p_type),
    searched[p_size % len(searched) + 1]])) AS condition FROM part, names),
usable AS (SELECT * FROM listed WHERE k % 97 <> 0 AND k % 7 <> 0),
{_chosen()},
taken AS ({" UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(len(SEARCHED)))}),
kept AS (SELECT * FROM taken ORDER BY condition_no, k LIMIT {STUDIES})
SELECT 'T' || lpad(k::VARCHAR, greatest(12, length(k::VARCHAR))::INT, '0') AS trial_id, condition_no::INT
  AS condition_no, (k // 200)::INT AS page_no, p_size::INT AS min_age,
  CASE WHEN k % 7 <> 1 THEN 'Recruiting' ELSE '' END AS status, p_name AS inclusion
FROM kept JOIN part ON p_partkey = k""")
def registry_selection(spark, sf_dir):
    """Pages written as JSON lines and read back; six searches share out five hundred studies."""
    path = scratch_path(spark, "registry-pages")
    SK.write_lines(registry_pages(spark, sf_dir), path)
    pages = spark.read.schema(f"condition STRING, page_no INT, {S.STUDY_PAGES}").json(path)
    taken = G.select_studies(pages, SEARCHED, STUDIES)
    trials = G.normalize_studies(taken)
    return trials.join(taken.select("trial_id", "condition_no", "page_no"), "trial_id").select(
        "trial_id", "condition_no", "page_no", "min_age", "status",
        F.array_join("inclusion_criteria", "|").alias("inclusion"))
