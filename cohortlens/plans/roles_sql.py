"""The roles of :mod:`.roles` as SQL text, for checking results against another engine."""

from ..constants import STOP_WORDS

PATIENTS = """patients AS (
  SELECT c_custkey AS patient_pos, 'P' || lpad(c_custkey::VARCHAR, greatest(12, length(c_custkey::VARCHAR))::INT, '0') AS patient_id,
    CASE WHEN c_custkey % 17 <> 0 THEN (c_custkey % 95)::INT END AS age,
    CASE WHEN c_custkey % 3 = 0 THEN 'female' WHEN c_custkey % 3 = 1 THEN 'Male'
         WHEN c_custkey % 5 <> 0 THEN 'female' END AS sex,
    CASE WHEN c_custkey % 19 <> 0 THEN CASE c_mktsegment
      WHEN 'MACHINERY' THEN 'metastatic non-small cell lung cancer'
      WHEN 'BUILDING' THEN 'HER2-positive breast cancer'
      WHEN 'AUTOMOBILE' THEN 'advanced renal cell carcinoma'
      WHEN 'FURNITURE' THEN 'migraine with aura'
      WHEN 'HOUSEHOLD' THEN 'unresectable melanoma' END END AS diagnosis,
    CASE c_nationkey % 5 WHEN 0 THEN 'I' WHEN 1 THEN 'II' WHEN 2 THEN 'III'
      WHEN 3 THEN 'IV' END AS stage,
    CASE WHEN c_acctbal >= 0 THEN (c_nationkey % 5)::INT END AS ecog,
    CASE c_custkey % 4 WHEN 0 THEN MAP {'EGFR': 'exon19del'}
      WHEN 1 THEN MAP {'EGFR': 'negative', 'ALK': 'positive'}
      WHEN 2 THEN MAP {'her2': 'Positive'}
      ELSE CAST(MAP {} AS MAP(VARCHAR, VARCHAR)) END AS biomarkers,
    CASE c_custkey % 5 WHEN 0 THEN ['platinum chemotherapy']
      WHEN 1 THEN ['Platinum-based doublet', 'trastuzumab']
      WHEN 2 THEN ['oxaliplatin'] ELSE CAST([] AS VARCHAR[]) END AS prior_treatments,
    CASE c_custkey % 6
      WHEN 0 THEN MAP {'uncontrolled_cardiac_disease': true, 'organ_transplant': false}
      WHEN 1 THEN MAP {'uncontrolled_cardiac_disease': false, 'organ_transplant': false,
                       'active_autoimmune_disease': false}
      WHEN 2 THEN MAP {'active_autoimmune_disease': true}
      WHEN 3 THEN MAP {'active_interstitial_lung_disease': false,
                       'active_uncontrolled_infection': false}
      ELSE CAST(MAP {} AS MAP(VARCHAR, BOOLEAN)) END AS flags,
    CASE WHEN c_nationkey % 7 <> 6
      THEN ['CA','NY','TX','WA','MA','IL','FL'][c_nationkey % 7 + 1] END AS state,
    lower(c_mktsegment) AS scenario
  FROM customer)"""

TRIALS = """trials AS (
  SELECT p_partkey AS trial_pos, 'T' || lpad(p_partkey::VARCHAR, greatest(12, length(p_partkey::VARCHAR))::INT, '0') AS trial_id,
    p_name || ' ' || p_brand AS title,
    CASE p_type WHEN 'MEDIUM' THEN ['Non-Small Cell Lung Cancer']
      WHEN 'STANDARD' THEN ['Breast Cancer', 'HER2 Positive Breast Carcinoma']
      WHEN 'LARGE' THEN ['Renal Cell Carcinoma'] WHEN 'PROMO' THEN ['Migraine']
      WHEN 'SMALL' THEN ['Melanoma', 'Solid Tumor']
      ELSE CAST([] AS VARCHAR[]) END AS conditions,
    CASE WHEN p_partkey % 7 <> 0 THEN p_size::INT END AS min_age,
    CASE WHEN p_partkey % 5 <> 0 THEN (p_size + 30)::INT END AS max_age,
    CASE p_partkey % 4 WHEN 0 THEN 'female' WHEN 1 THEN 'male' ELSE 'all' END AS sex,
    CASE p_partkey % 3 WHEN 0 THEN ['III', 'IV'] WHEN 1 THEN ['II', 'III']
      ELSE CAST([] AS VARCHAR[]) END AS allowed_stages,
    CASE WHEN p_partkey % 6 < 3 THEN (p_partkey % 3)::INT END AS max_ecog,
    CASE p_partkey % 8 WHEN 0 THEN [['EGFR', 'L858R_or_exon19del']]
      WHEN 1 THEN [['HER2', 'positive']]
      WHEN 2 THEN [['ALK', 'negative'], ['EGFR', 'positive']]
      ELSE CAST([] AS VARCHAR[][]) END AS markers,
    CASE p_partkey % 9 WHEN 0 THEN ['platinum chemotherapy']
      WHEN 1 THEN ['trastuzumab', 'oxaliplatin'] ELSE CAST([] AS VARCHAR[]) END AS priors,
    CASE p_partkey % 5 WHEN 0 THEN ['organ_transplant']
      WHEN 1 THEN ['uncontrolled_cardiac_disease', 'active_autoimmune_disease']
      WHEN 2 THEN ['active_interstitial_lung_disease']
      ELSE CAST([] AS VARCHAR[]) END AS excluded_flags,
    CASE WHEN p_partkey % 10 = 0 THEN 'COMPLETED' ELSE 'RECRUITING' END AS status
  FROM part)"""

PAIRS = """pairs AS (
  SELECT 'P' || lpad(o_custkey::VARCHAR, greatest(12, length(o_custkey::VARCHAR))::INT, '0') AS patient_id,
    'T' || lpad(l_partkey::VARCHAR, greatest(12, length(l_partkey::VARCHAR))::INT, '0') AS trial_id,
    sum(l_quantity)::BIGINT / 100.0::DOUBLE AS retrieval_score, l_partkey AS retrieval_pos,
    min(l_returnflag) AS flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY o_custkey, l_partkey)"""

# Words of a condition text that identify a disease.
_TOKENS = """list_filter(string_split({0}, ' '), lambda w: length(w) > 3 AND NOT list_contains(
  ['adult','adults','cancer','chronic','children','disease','diseases','disorder','disorders',
   'headache','headaches','idiopathic','pediatric','primary','pulmonary','syndrome','with',
   'without'], w))"""


def _norm(c: str) -> str:
    return f"replace(lower(trim({c})), '-', ' ')"


# One row per pair and check, as nine UNION ALL branches.
EVIDENCE = f"""joined AS (
  SELECT pr.patient_id, pr.trial_id, p.* EXCLUDE (patient_id), t.* EXCLUDE (trial_id, sex),
    t.sex AS t_sex, {_norm('p.diagnosis')} AS dx
  FROM pairs pr JOIN patients p USING (patient_id) JOIN trials t USING (trial_id)),
needed AS (
  SELECT *, unnest(list_concat(['diagnosis'],
    CASE WHEN len(allowed_stages) > 0 THEN ['stage'] ELSE CAST([] AS VARCHAR[]) END,
    CASE WHEN max_ecog IS NOT NULL THEN ['ecog'] ELSE CAST([] AS VARCHAR[]) END,
    CASE WHEN len(markers) > 0 THEN ['biomarkers'] ELSE CAST([] AS VARCHAR[]) END,
    CASE WHEN len(priors) > 0 THEN ['prior_treatments'] ELSE CAST([] AS VARCHAR[]) END)) AS fld,
    unnest([0, 1, 2, 3, 4]) AS _i
  FROM joined),
cond AS (
  SELECT *, list_filter(conditions, lambda c: contains(dx, {_norm('c')})
      OR contains({_norm('c')}, dx)
      OR len(list_intersect({_TOKENS.format('dx')}, {_TOKENS.format(_norm('c'))})) > 0) AS hits
  FROM joined WHERE len(conditions) > 0),
mark AS (
  SELECT patient_id, trial_id, unnest(markers) AS m, generate_subscripts(markers, 1) AS i,
    biomarkers FROM joined WHERE len(markers) > 0),
mark2 AS (
  SELECT patient_id, trial_id, m[1] AS marker, m[2] AS need, i,
    list_filter(map_entries(biomarkers), lambda e: {_norm('e.key')} = {_norm('m[1]')})[-1].value
      AS have FROM mark),
mark3 AS (
  SELECT *, CASE {_norm('need')} WHEN 'positive' THEN {_norm('have')} NOT IN
      ('negative', 'not detected', 'wild type', 'stable')
    WHEN 'negative' THEN {_norm('have')} IN ('negative', 'not detected', 'wild type')
    ELSE list_contains(string_split({_norm('need')}, '_or_'), {_norm('have')}) END AS ok
  FROM mark2),
prior AS (
  SELECT patient_id, trial_id, unnest(priors) AS need, generate_subscripts(priors, 1) AS i,
    prior_treatments FROM joined WHERE len(priors) > 0 AND len(prior_treatments) > 0),
prior2 AS (
  SELECT *, len(list_filter(prior_treatments, lambda x: contains({_norm('x')}, {_norm('need')})
    OR contains({_norm('need')}, {_norm('x')}))) > 0 AS ok FROM prior),
flag AS (
  SELECT patient_id, trial_id, unnest(excluded_flags) AS f,
    generate_subscripts(excluded_flags, 1) AS i, flags FROM joined
  WHERE len(excluded_flags) > 0),
flag2 AS (SELECT *, flags[f] AS v FROM flag),
ev AS (
  SELECT patient_id, trial_id, 100 + _i AS k, 'field:' || fld AS criterion,
    'missing' AS status, 'Required patient field ''' || fld || ''' is missing.' AS detail
  FROM needed WHERE (fld = 'diagnosis' AND diagnosis IS NULL) OR (fld = 'stage' AND stage IS NULL)
    OR (fld = 'ecog' AND ecog IS NULL) OR (fld = 'biomarkers' AND cardinality(biomarkers) = 0)
    OR (fld = 'prior_treatments' AND len(prior_treatments) = 0)
  UNION ALL
  SELECT patient_id, trial_id, 200, CASE WHEN diagnosis IS NULL THEN 'field:diagnosis'
      ELSE 'condition' END,
    CASE WHEN diagnosis IS NULL THEN 'missing' WHEN len(hits) > 0 THEN 'matched'
      ELSE 'conflict' END,
    CASE WHEN diagnosis IS NULL THEN 'Patient diagnosis is missing.'
      WHEN len(hits) > 0 THEN 'Diagnosis ''' || diagnosis || ''' matches trial condition '''
        || hits[1] || '''.'
      ELSE 'Diagnosis ''' || diagnosis || ''' does not match trial conditions.' END FROM cond
  UNION ALL
  SELECT patient_id, trial_id, 300, CASE WHEN age IS NULL THEN 'field:age' ELSE 'age' END,
    CASE WHEN age IS NULL THEN 'missing' WHEN age < min_age OR age > max_age THEN 'conflict'
      ELSE 'matched' END,
    CASE WHEN age IS NULL THEN 'Patient age is missing.'
      WHEN age < min_age THEN 'Age ' || age || ' is below minimum age ' || min_age || '.'
      WHEN age > max_age THEN 'Age ' || age || ' is above maximum age ' || max_age || '.'
      ELSE 'Age ' || age || ' is within bounds.' END
  FROM joined WHERE min_age IS NOT NULL OR max_age IS NOT NULL
  UNION ALL
  SELECT patient_id, trial_id, 400, CASE WHEN sex IS NULL THEN 'field:sex' ELSE 'sex' END,
    CASE WHEN sex IS NULL THEN 'missing' WHEN lower(sex) = t_sex THEN 'matched'
      ELSE 'conflict' END,
    CASE WHEN sex IS NULL THEN 'Patient sex is missing.'
      WHEN lower(sex) = t_sex THEN 'Sex ''' || sex || ''' matches.'
      ELSE 'Sex ''' || sex || ''' does not match trial criterion ''' || t_sex || '''.' END
  FROM joined WHERE t_sex <> 'all'
  UNION ALL
  SELECT patient_id, trial_id, 500, CASE WHEN stage IS NULL THEN 'field:stage' ELSE 'stage' END,
    CASE WHEN stage IS NULL THEN 'missing' WHEN list_contains(allowed_stages, stage)
      THEN 'matched' ELSE 'conflict' END,
    CASE WHEN stage IS NULL THEN 'Patient stage is missing.'
      WHEN list_contains(allowed_stages, stage) THEN 'Stage ''' || stage || ''' is allowed.'
      ELSE 'Stage ''' || stage || ''' is not in allowed stages ['''
        || array_to_string(allowed_stages, ''', ''') || '''].' END
  FROM joined WHERE len(allowed_stages) > 0
  UNION ALL
  SELECT patient_id, trial_id, 600, CASE WHEN ecog IS NULL THEN 'field:ecog' ELSE 'ecog' END,
    CASE WHEN ecog IS NULL THEN 'missing' WHEN ecog <= max_ecog THEN 'matched'
      ELSE 'conflict' END,
    CASE WHEN ecog IS NULL THEN 'Patient ECOG is missing.'
      WHEN ecog <= max_ecog THEN 'ECOG ' || ecog || ' is at or below maximum ' || max_ecog || '.'
      ELSE 'ECOG ' || ecog || ' is above maximum ' || max_ecog || '.' END
  FROM joined WHERE max_ecog IS NOT NULL
  UNION ALL
  SELECT patient_id, trial_id, 700 + i, 'biomarker:' || marker,
    CASE WHEN have IS NULL THEN 'missing' WHEN ok THEN 'matched' ELSE 'conflict' END,
    CASE WHEN have IS NULL THEN 'Required biomarker ''' || marker || ''' is missing.'
      WHEN ok THEN marker || ' value ''' || have || ''' matches ''' || need || '''.'
      ELSE marker || ' value ''' || have || ''' does not match ''' || need || '''.' END
  FROM mark3
  UNION ALL
  SELECT patient_id, trial_id, 800, 'field:prior_treatments', 'missing',
    'Prior treatment history is missing.'
  FROM joined WHERE len(priors) > 0 AND len(prior_treatments) = 0
  UNION ALL
  SELECT patient_id, trial_id, 800 + i, 'prior_treatment:' || need,
    CASE WHEN ok THEN 'matched' ELSE 'conflict' END,
    'Prior treatment ''' || need || CASE WHEN ok THEN ''' is documented.'
      ELSE ''' is not documented.' END FROM prior2
  UNION ALL
  SELECT patient_id, trial_id, 900 + i, 'flag:' || f,
    CASE WHEN v IS NULL THEN 'missing' WHEN v THEN 'conflict' ELSE 'matched' END,
    CASE WHEN v IS NULL THEN 'Exclusion flag ''' || f || ''' is unknown.'
      WHEN v THEN 'Patient has exclusion flag ''' || f || '''.'
      ELSE 'Patient does not have exclusion flag ''' || f || '''.' END FROM flag2)"""


def round_exact(x: str, places: int) -> str:
    """Half-even rounding of the stored binary value (see ``functions.exprs``)."""
    s = f"1e{places}::DOUBLE"
    p = f"(({x}) * {s})"
    big = f"(({x}) * 134217729.0::DOUBLE)"
    hi = f"({big} - ({big} - ({x})))"
    err = f"(({hi} * {s} - {p}) + (({x}) - {hi}) * {s})"
    fl, fr = f"floor({p})", f"({p} - floor({p}))"
    return (f"(CASE WHEN {fr} > 0.5 THEN {fl} + 1 WHEN {fr} < 0.5 THEN {fl} "
            f"WHEN {err} > 0 THEN {fl} + 1 WHEN {err} < 0 THEN {fl} "
            f"WHEN {fl} % 2 = 0 THEN {fl} ELSE {fl} + 1 END / {s})")


# Counts, score and decision of every pair.  A pair without any check scores 0.
JUDGED = f"""counted AS (
  SELECT patient_id, trial_id, count(*)::INT AS n,
    count(*) FILTER (status = 'matched')::INT AS matched,
    count(*) FILTER (status = 'missing')::INT AS missing,
    count(*) FILTER (status = 'conflict')::INT AS conflicts,
    list_reduce(list(CASE status WHEN 'matched' THEN 1.0::DOUBLE WHEN 'missing'
      THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END ORDER BY k), lambda a, b: a + b) AS points
  FROM ev GROUP BY patient_id, trial_id),
scored AS (
  SELECT pr.patient_id, pr.trial_id, pr.retrieval_score, pr.retrieval_pos, pr.flag,
    coalesce(matched, 0) AS matched, coalesce(missing, 0) AS missing,
    coalesce(conflicts, 0) AS conflicts,
    CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE {round_exact('points / n', 3)} END AS score
  FROM pairs pr LEFT JOIN counted USING (patient_id, trial_id)),
judged AS (
  SELECT *, CASE WHEN conflicts > 0 THEN 'not_recommended'
    WHEN missing > 0 THEN CASE WHEN score >= 0.45 THEN 'needs_more_info'
      ELSE 'not_recommended' END
    WHEN score >= 0.75 THEN 'recommend' ELSE 'not_recommended' END AS decision
  FROM scored)"""


def with_roles(*parts: str) -> str:
    return "WITH " + ",\n".join([PATIENTS, TRIALS, PAIRS, *parts]) + "\n"


# --- notes and facts ------------------------------------------------------------------------

_ONC = ("regexp_matches(lower(coalesce(diagnosis, '')), 'cancer|carcinoma|leukemia|lymphoma|"
        "melanoma|myeloma|neoplasm|sarcoma|tumor')")

NOTES = f"""notes AS (
  SELECT patient_id, patient_pos, concat_ws(' ',
    CASE WHEN onc AND even THEN 'Oncology referral note' WHEN onc THEN 'Tumor board intake'
      WHEN even THEN 'Clinical referral note' ELSE 'Clinical intake' END || ': ' || patient_id
      || ' is a ' || CASE WHEN age IS NULL OR sex IS NULL THEN 'Adult patient'
        ELSE age || '-year-old ' || sex END || ' ' || CASE WHEN diagnosis IS NULL
        THEN 'with diagnosis not clearly documented' ELSE 'with ' || diagnosis END || '.',
    CASE WHEN stage IS NOT NULL THEN 'Stage is recorded as ' || stage || '.'
      WHEN onc THEN 'No formal stage is documented.' END,
    CASE WHEN ecog IS NULL THEN 'ECOG performance status is not documented.'
      ELSE 'ECOG performance status is ' || ecog || '.' END,
    CASE WHEN cardinality(biomarkers) > 0 THEN 'Molecular testing shows ' || array_to_string(
        list_transform(map_entries(biomarkers), lambda e: e.key || ' ' || e.value), ', ') || '.'
      WHEN onc THEN 'Molecular testing results are not available in the note.' END,
    CASE WHEN len(prior_treatments) > 0
      THEN 'Prior therapy includes ' || array_to_string(prior_treatments, ', ') || '.'
      WHEN onc THEN 'No prior systemic therapy is listed in the referral.' END,
    CASE WHEN cardinality(flags) = 0 THEN 'No explicit exclusion comorbidities are addressed.'
      ELSE array_to_string(list_transform(map_entries(flags), lambda e: CASE WHEN e.value
        THEN 'The note reports ' || replace(e.key, '_', ' ') || '.'
        ELSE 'No ' || replace(e.key, '_', ' ') || ' is reported.' END), ' ') END,
    CASE WHEN state IS NOT NULL THEN 'The patient receives care in ' || state || '.' END,
    'The note is a synthetic record created for software testing, not a real patient chart.'
    ) AS note
  FROM (SELECT *, {_ONC} AS onc, patient_pos % 2 = 0 AS even FROM patients))"""


def _hit(pattern: str, c: str = "note", group: int = 1) -> str:
    return f"nullif(regexp_extract({c}, '{pattern}', {group}), '')"


def negated(c: str, phrase: str) -> str:
    return (f"(regexp_matches({c}, '\\b(no|not|without|absent|absence of|lacks?|lack of)\\b"
            f"[^.]{{0,80}}{phrase}') OR regexp_matches({c}, '{phrase}[^.]{{0,80}}"
            f"\\b(absent|negative|not present|is absent)\\b'))")


CANONICAL_FLAGS = ["active_interstitial_lung_disease", "active_autoimmune_disease",
                   "uncontrolled_cardiac_disease", "active_uncontrolled_infection",
                   "organ_transplant"]
_MARKER = "(positive|negative|mutated|wild type|V600E|exon 19|L858R|amplified)"
_FLAG_COLUMNS = ",\n    ".join(
    f"CASE WHEN contains(low, '{f.replace('_', ' ')}') THEN "
    f"NOT {negated('low', f.replace('_', ' '))} END AS f_{f}" for f in CANONICAL_FLAGS)

FACTS = f"""facts AS (
  SELECT patient_id, note, {_hit('(?i)\\b(\\d{1,3})-year-old\\b')}::INT AS age,
    CASE WHEN regexp_matches(low, '\\b(male|man|boy)\\b') THEN 'male'
      WHEN regexp_matches(low, '\\b(female|woman|girl)\\b') THEN 'female' END AS sex,
    coalesce({_hit('(?i)with ([^.]+?)\\. Stage')}, {_hit('(?i)with ([^.]+?)\\. ECOG')},
      {_hit('(?i)with ([^.]+?)\\. Molecular')}, {_hit('(?i)diagnosis of ([^.]+?)\\.')})
      AS diagnosis,
    upper({_hit('(?i)stage (?:is recorded as )?(iv|iii|ii|i|4|3|2|1)\\b')}) AS stage,
    {_hit('(?i)\\bECOG performance status is\\s*([0-5])\\b')}::INT AS ecog,
    {_hit('(?i)\\bEGFR\\b[^.]*?' + _MARKER)} AS b_egfr,
    {_hit('(?i)\\bALK\\b[^.]*?' + _MARKER)} AS b_alk,
    {_hit('(?i)\\bHER2\\b[^.]*?' + _MARKER)} AS b_her2,
    CASE WHEN contains(low, 'platinum') THEN NOT {negated('low', 'platinum')}
      WHEN contains(low, 'no prior systemic therapy')
        OR contains(low, 'prior systemic therapy is not listed') THEN false END AS platinum,
    {_FLAG_COLUMNS},
    {_hit('receives care in ([A-Z]{2})\\b')} AS state
  FROM (SELECT *, lower(note) AS low FROM notes))"""

# Events read as answers of the customer with the same number.
ANSWERS = """answers AS (
  SELECT 'P' || lpad(user_id::VARCHAR, greatest(12, length(user_id::VARCHAR))::INT, '0') AS patient_id, ts, event_id,
    CASE event_type
      WHEN 'click' THEN 'ECOG performance status is ' || (event_id % 6) || '.'
      WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'Now stage IV disease.'
        ELSE 'It is stage 3.' END
      WHEN 'error' THEN 'There is no organ transplant history.'
      WHEN 'signup' THEN 'Had prior platinum in ' || (2000 + event_id % 24) || '.'
      ELSE 'An active autoimmune disease was found.' END AS answer
  FROM events)"""


def _latest(value: str, name: str) -> str:
    return (f"arg_max({value}, (ts, event_id)) FILTER (({value}) IS NOT NULL) AS {name}")


_LOW = "lower(answer)"
STATED = f"""stated AS (
  SELECT patient_id,
    {_latest("nullif(regexp_extract(" + _LOW + ", '\\becog(?: performance status)?\\s*(?:is|=)?"
             "\\s*([0-5])\\b', 1), '')::INT", 'a_ecog')},
    {_latest("CASE WHEN contains(lower(answer), 'stage iii') OR contains(lower(answer), "
             "'stage 3') THEN 'III' WHEN contains(lower(answer), 'stage iv') OR "
             "contains(lower(answer), 'stage 4') THEN 'IV' END", 'a_stage')},
    {_latest("CASE WHEN contains(lower(answer), 'prior platinum') OR contains(lower(answer), "
             "'platinum chemotherapy') THEN NOT " + negated(_LOW, 'platinum') + " END",
             'a_platinum')},
    {", ".join(_latest("CASE WHEN contains(lower(answer), '" + f.replace('_', ' ')
                       + "') THEN NOT " + negated(_LOW, f.replace('_', ' ')) + " END", 'a_' + f)
               for f in CANONICAL_FLAGS)}
  FROM answers GROUP BY patient_id)"""

FACTS_BOTH = f"""facts_both AS (
  SELECT 'initial' AS phase, * EXCLUDE (note, state) FROM facts
  UNION ALL
  SELECT 'final', patient_id, age, sex, diagnosis, coalesce(a_stage, stage),
    coalesce(a_ecog, ecog), b_egfr, b_alk, b_her2, coalesce(a_platinum, platinum),
    {", ".join(f"coalesce(a_{f}, f_{f})" for f in CANONICAL_FLAGS)}
  FROM facts LEFT JOIN stated USING (patient_id))"""

CRITERIA = """criteria AS (
  SELECT trial_id, 0 AS criterion_pos, 'I-condition' AS part, 'inclusion' AS ctype,
    'Patient diagnosis should match the trial condition.' AS criterion,
    NULL::VARCHAR AS name, NULL::VARCHAR AS need FROM trials
  UNION ALL SELECT trial_id, 1, 'I-age', 'inclusion',
    'Patient age should be within trial bounds.', NULL, NULL
    FROM trials WHERE min_age IS NOT NULL OR max_age IS NOT NULL
  UNION ALL SELECT trial_id, 2, 'I-sex', 'inclusion',
    'Patient recorded sex should match the trial sex criterion.', NULL, NULL
    FROM trials WHERE sex <> 'all'
  UNION ALL SELECT trial_id, 3, 'I-stage', 'inclusion',
    'Patient disease stage should be allowed.', NULL, NULL
    FROM trials WHERE len(allowed_stages) > 0
  UNION ALL SELECT trial_id, 4, 'I-ecog', 'inclusion',
    'Patient ECOG performance status should be at or below the maximum.', NULL, NULL
    FROM trials WHERE max_ecog IS NOT NULL
  UNION ALL SELECT trial_id, 10 + i, 'I-biomarker-' || lower(m[1]), 'inclusion',
    'Patient biomarker ' || m[1] || ' should match ' || m[2] || '.', m[1], m[2]
    FROM (SELECT trial_id, unnest(markers) AS m, generate_subscripts(markers, 1) AS i FROM trials)
  UNION ALL SELECT trial_id, 20 + i, 'I-prior-' || replace(x, ' ', '-'), 'inclusion',
    'Patient should have prior treatment: ' || x || '.', x, NULL
    FROM (SELECT trial_id, unnest(priors) AS x, generate_subscripts(priors, 1) AS i FROM trials)
  UNION ALL SELECT trial_id, 30 + i, 'E-' || replace(x, '_', '-'), 'exclusion',
    'Exclude if patient has ' || replace(x, '_', ' ') || '.', x, NULL
    FROM (SELECT trial_id, unnest(excluded_flags) AS x,
      generate_subscripts(excluded_flags, 1) AS i FROM trials))"""

_NT = """list_filter(regexp_extract_all({0}, '[a-z0-9]+'), lambda w: length(w) > 3 AND NOT
  list_contains(['advanced','cancer','carcinoma','disease','locally','metastatic','patient',
  'patients','recurrent','solid','stage','tumor','tumors'], w))"""
_FLAG_VALUE = "CASE name " + " ".join(
    f"WHEN '{f}' THEN f_{f}" for f in CANONICAL_FLAGS) + " END"
_SEEN = "CASE name WHEN 'EGFR' THEN b_egfr WHEN 'ALK' THEN b_alk WHEN 'HER2' THEN b_her2 END"

# Statuses of every criterion of every pair in both phases; ``rules`` is 'new' or 'old'.
VERDICTS = f"""rows0 AS (
  SELECT pr.patient_id, pr.trial_id, c.criterion_pos, c.part, c.ctype, c.name, c.need, f.phase,
    f.* EXCLUDE (patient_id, phase), t.min_age, t.max_age, t.sex AS t_sex, t.allowed_stages,
    t.max_ecog, t.conditions, {_norm('f.diagnosis')} AS dx, {_FLAG_VALUE} AS flag_on,
    {_SEEN} AS seen
  FROM pairs pr JOIN criteria c USING (trial_id) JOIN trials t USING (trial_id)
  JOIN facts_both f USING (patient_id)),
rows1 AS (
  SELECT *, len(list_filter(conditions, lambda c: contains(dx, {_norm('c')})
      OR contains({_norm('c')}, dx) OR len(list_intersect({_NT.format('dx')},
        {_NT.format(_norm('c'))})) > 0)) > 0 AS dx_ok,
    CASE lower(need) WHEN 'positive' THEN lower(seen) NOT IN ('negative', 'not detected',
        'wild type') WHEN 'negative' THEN lower(seen) IN ('negative', 'not detected',
        'wild type') ELSE contains(lower(seen), lower(need)) OR contains(lower(need),
        lower(seen)) END AS marker_ok FROM rows0),
verdicts AS (
  SELECT patient_id, trial_id, phase, criterion_pos, part, ctype, rules,
    CASE WHEN part = 'I-condition' THEN CASE WHEN diagnosis IS NULL THEN 'unknown'
        WHEN dx_ok THEN 'satisfied' ELSE 'violated' END
      WHEN part = 'I-age' THEN CASE WHEN age IS NULL THEN 'unknown'
        WHEN age < min_age OR age > max_age THEN 'violated' ELSE 'satisfied' END
      WHEN part = 'I-stage' AND rules = 'old' THEN
        CASE WHEN age IS NULL THEN 'unknown' ELSE 'satisfied' END
      WHEN part = 'I-stage' THEN CASE WHEN stage IS NULL THEN 'unknown'
        WHEN list_contains(allowed_stages, stage) THEN 'satisfied' ELSE 'violated' END
      WHEN part = 'I-ecog' THEN CASE WHEN ecog IS NULL THEN 'unknown'
        WHEN ecog <= max_ecog THEN 'satisfied' ELSE 'violated' END
      WHEN part = 'I-prior-platinum-chemotherapy' THEN CASE WHEN platinum IS NULL
        THEN 'unknown' WHEN platinum THEN 'satisfied' ELSE 'violated' END
      WHEN ctype = 'exclusion' THEN CASE WHEN flag_on IS NULL THEN 'unknown'
        WHEN flag_on THEN 'violated' ELSE 'satisfied' END
      WHEN rules = 'old' THEN 'unknown'
      WHEN part = 'I-sex' THEN CASE WHEN sex IS NULL THEN 'unknown'
        WHEN sex = t_sex THEN 'satisfied' ELSE 'violated' END
      WHEN need IS NOT NULL THEN CASE WHEN seen IS NULL THEN 'unknown'
        WHEN marker_ok THEN 'satisfied' ELSE 'violated' END
      ELSE 'unknown' END AS status
  FROM rows1, (VALUES ('new'), ('old')) AS r(rules))"""

LOOP = [NOTES, FACTS, ANSWERS, STATED, FACTS_BOTH, CRITERIA, VERDICTS]

ROLLED = """rolled AS (
  SELECT patient_id, trial_id, phase, rules,
    count(*) FILTER (status = 'satisfied')::INT AS satisfied,
    CASE WHEN bool_or(status = 'violated') THEN 'ineligible'
      WHEN bool_or(status = 'unknown') THEN 'uncertain' ELSE 'eligible' END AS eligibility
  FROM verdicts GROUP BY ALL)"""

# --- the sections of a trial, and the trials that a note finds ------------------------------------

SECTIONS = """sections AS (
  SELECT trial_id, trial_pos, title, 0 AS chunk_pos, 'overview' AS section, trial_id || ': ' || title
    || '. Phase: PHASE' || (trial_pos % 3 + 1) || '. Status: ' || status || '. Conditions: '
    || array_to_string(conditions, ', ') || '. Interventions: ' || p_brand || '. A study of '
    || p_name AS text FROM trials JOIN part ON p_partkey = trial_pos
  UNION ALL SELECT trial_id, trial_pos, title, 1, 'inclusion', 'Age: minimum '
    || coalesce(min_age::VARCHAR, 'none') || ', maximum ' || coalesce(max_age::VARCHAR, 'none')
    || '. Sex: ' || sex || '. Allowed stages: ' || CASE WHEN len(allowed_stages) > 0
      THEN array_to_string(allowed_stages, ', ') ELSE 'not stage-restricted' END
    || '. Maximum ECOG: ' || coalesce(max_ecog::VARCHAR, 'not specified')
    || '. Required prior treatments: ' || CASE WHEN len(priors) > 0
      THEN array_to_string(priors, ', ') ELSE 'none' END || '.' FROM trials
  UNION ALL SELECT trial_id, trial_pos, title, 2, 'biomarkers', CASE WHEN len(markers) > 0 THEN
    'Required biomarkers: ' || array_to_string(list_transform(markers, lambda m: m[1] || ' must be '
      || m[2]), '; ') || '.' ELSE 'No required biomarker is specified.' END FROM trials
  UNION ALL SELECT trial_id, trial_pos, title, 3, 'exclusions', CASE WHEN len(excluded_flags) > 0
    THEN 'Exclude patients with ' || replace(array_to_string(excluded_flags, '; '), '_', ' ') || '.'
    ELSE 'No explicit exclusion flags are listed.' END FROM trials
  UNION ALL SELECT trial_id, trial_pos, title, 4, 'raw_criteria', 'Inclusion criteria:  Exclusion '
    || 'criteria:  Raw eligibility criteria:' FROM trials)"""


def tokens(c: str) -> str:
    words = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return (f"list_filter(string_split_regex(replace(replace(replace(lower({c}), 'non-small', "
            "'nonsmall'), 'pd-l1', 'pdl1'), 'msi-h', 'msih'), '[^a-z0-9]+'), "
            f"lambda w: length(w) > 1 AND NOT list_contains([{words}], w))")


def found(k: int, open_only: bool) -> str:
    """The ``k`` best trials of every note: ``query_id, trial_id, trial_pos, rk, score``."""
    kept = " WHERE status = 'RECRUITING'" if open_only else ""
    return f"""searched AS (SELECT s.* FROM sections s JOIN trials USING (trial_id){kept}),
terms AS (SELECT trial_id, trial_pos, chunk_pos, unnest({tokens("concat_ws(' ', title, section, text)")})
    AS token FROM searched),
tf AS (SELECT trial_id, trial_pos, chunk_pos, token, count(*) AS tf FROM terms GROUP BY ALL),
idf AS (SELECT token, round(ln(1 + ((SELECT count(*) FROM searched) + 1) / (count(*) + 1)) * 1e9)
    ::BIGINT AS idf FROM tf GROUP BY token),
q AS (SELECT patient_id AS query_id, token, count(*) AS qtf FROM (SELECT patient_id,
    unnest({tokens('note')}) AS token FROM notes) GROUP BY ALL),
whole AS (SELECT trial_id, trial_pos, token, sum(tf)::BIGINT AS tf FROM tf GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, trial_pos) AS rk FROM (
    SELECT query_id, trial_id, trial_pos, sum(qtf * idf * tf)::BIGINT AS s
    FROM q JOIN idf USING (token) JOIN whole USING (token) GROUP BY ALL)),
found AS (SELECT query_id, trial_id, trial_pos, rk, {round_exact('s / 1e9::DOUBLE', 3)} AS score
  FROM top WHERE rk <= {k})"""
