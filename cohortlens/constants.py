"""Word lists, patterns, thresholds and templates.

Everything in this module is a plain value that results depend on.  Operators take
most of them as arguments, with these as the defaults.
"""

from __future__ import annotations

# --- label sets -----------------------------------------------------------------
ELIGIBILITY = ["eligible", "ineligible", "uncertain"]
CRITERION_STATUS = ["satisfied", "violated", "unknown", "not_applicable"]
DECISIONS = ["recommend", "needs_more_info", "not_recommended"]
DECISION_TO_ELIGIBILITY = {
    "recommend": "eligible",
    "needs_more_info": "uncertain",
    "not_recommended": "ineligible",
}
EVIDENCE_TO_STATUS = {"matched": "satisfied", "conflict": "violated", "missing": "unknown"}
STATUS_CONFIDENCE = {"satisfied": 0.82, "violated": 0.88, "unknown": 0.55}
ELIGIBILITY_WEIGHT = {"eligible": 3, "uncertain": 2, "ineligible": 1}
DISCLAIMER = (
    "Synthetic software-evaluation output only. Not medical advice and not a real "
    "clinical eligibility decision."
)

# --- scoring --------------------------------------------------------------------
MISSING_WEIGHT = 0.35
RECOMMEND_AT = 0.75
INFO_AT = 0.45

# --- condition matching: words that do not identify a disease -----------------------
PAIR_GENERIC_WORDS = [
    "adult", "adults", "cancer", "chronic", "children", "disease", "diseases",
    "disorder", "disorders", "headache", "headaches", "idiopathic", "pediatric",
    "primary", "pulmonary", "syndrome", "with", "without",
]
NOTE_GENERIC_WORDS = [
    "advanced", "cancer", "carcinoma", "disease", "locally", "metastatic", "patient",
    "patients", "recurrent", "solid", "stage", "tumor", "tumors",
]
QUESTION_GENERIC_WORDS = [
    "cancer", "patient", "patients", "trial", "study", "testing", "condition",
    "criteria", "participation", "advanced", "metastatic", "solid", "tumor", "tumors",
    "care",
]
QUESTION_ALIASES = [
    ["psychotherapy", "existential", "distress", "orphys"],
    ["genetic", "inherited"],
    ["rural"],
    ["urothelial", "bladder"],
    ["lymphoma", "cell"],
    ["fibrosis", "pulmonary"],
]
QUESTION_HINTS = [
    ("ecog", ["ecog"]),
    ("performance status", ["ecog"]),
    ("platinum", ["prior-platinum-chemotherapy"]),
    ("autoimmune", ["active-autoimmune-disease"]),
    ("interstitial lung", ["active-interstitial-lung-disease"]),
    ("cardiac", ["uncontrolled-cardiac-disease"]),
    ("infection", ["active-uncontrolled-infection"]),
    ("organ transplant", ["organ-transplant"]),
    ("transplant", ["organ-transplant"]),
    ("stage", ["stage"]),
    ("biomarker", ["biomarker"]),
    ("molecular", ["biomarker"]),
    ("prior systemic", ["prior-treatment", "prior-systemic-therapy"]),
]
ONCOLOGY_WORDS = [
    "cancer", "carcinoma", "leukemia", "lymphoma", "melanoma", "myeloma", "neoplasm",
    "sarcoma", "tumor",
]

# --- retrieval --------------------------------------------------------------------
STOP_WORDS = [
    "the", "and", "or", "is", "a", "an", "of", "for", "with", "to", "in", "as", "no",
    "not", "are", "be", "patient", "patients", "trial", "note",
]
PHRASE_JOINS = [("non-small", "nonsmall"), ("pd-l1", "pdl1"), ("msi-h", "msih")]

# --- protocol text ------------------------------------------------------------------
RECRUITING = [
    "RECRUITING", "NOT_YET_RECRUITING", "ACTIVE_NOT_RECRUITING", "ENROLLING_BY_INVITATION",
]
STAGES = ["I", "II", "III", "IV"]
STAGE_SEGMENT = r"STAGE(?:S)?[^.\n;:]{0,100}"
ECOG_LIMIT = r"(?i)ECOG[^0-9]{0,30}(?:<=|0-|0\s+to\s+|or\s+)?([0-4])"
BIOMARKER_PATTERNS = {
    "EGFR": [
        (r"egfr[^.\n;]*(?:exon\s*19|19\s*del|deletion)", "exon19del"),
        (r"egfr[^.\n;]*l858r", "L858R"),
        (r"egfr[^.\n;]*(?:mutation|mutated|positive)", "positive"),
    ],
    "ALK": [(r"\balk[^.\n;]*(?:rearrangement|fusion|positive)", "positive")],
    "BRAF": [
        (r"\bbraf[^.\n;]*v600e", "V600E"),
        (r"\bbraf[^.\n;]*(?:mutation|mutated)", "positive"),
    ],
    "HER2": [(r"\bher2[^.\n;]*(?:positive|overexpress)", "positive")],
    "MSI": [(r"\bmsi[- ]?h|microsatellite instability[- ]high", "MSI-H")],
    "FLT3": [
        (r"\bflt3[^.\n;]*(?:itd|tkd)", "ITD_or_TKD"),
        (r"\bflt3[^.\n;]*(?:mutation|mutated)", "positive"),
    ],
    "BRCA1": [(r"\bbrca1[^.\n;]*(?:pathogenic|mutation|mutated)", "pathogenic")],
    "BRCA2": [(r"\bbrca2[^.\n;]*(?:pathogenic|mutation|mutated)", "pathogenic")],
    "KRAS": [(r"\bkras[^.\n;]*wild[- ]type", "wild type")],
}
BIOMARKER_NEGATION = r"\b(no|without|negative for|absence of|lack of|wild[- ]type)\b"
BIOMARKER_NEGATION_WINDOW = 60
PRIOR_TREATMENT_WORDS = [
    ("platinum", "platinum chemotherapy"),
    ("trastuzumab", "trastuzumab"),
    ("oxaliplatin", "oxaliplatin"),
    ("induction chemotherapy", "induction chemotherapy"),
    ("androgen receptor", "androgen receptor inhibitor"),
]
EXCLUSION_FLAG_PATTERNS = [
    ("untreated_brain_metastases", r"untreated[^.\n;]*brain metast"),
    ("active_interstitial_lung_disease", r"interstitial lung disease|pneumonitis"),
    ("active_autoimmune_disease", r"active autoimmune|autoimmune disease"),
    ("uncontrolled_cardiac_disease",
     r"uncontrolled cardiac|heart failure|myocardial infarction"),
    ("active_uncontrolled_infection", r"active infection|uncontrolled infection"),
    ("organ_transplant", r"organ transplant|transplant recipient"),
]
SECTION_LINE_CAP = 80  # the historic limit, off unless asked for
LABEL_TEXT_LIMITS = {"reason": 500, "question": 300, "rationale": 1000}  # likewise
SECTION_MIN_CHARS = 4

# --- patient notes ---------------------------------------------------------------------
CANONICAL_FLAGS = [
    "active_interstitial_lung_disease", "active_autoimmune_disease",
    "uncontrolled_cardiac_disease", "active_uncontrolled_infection", "organ_transplant",
]
DIAGNOSIS_RULES = [
    ("acute pancreatitis", ["epigastric pain", "lipase", "amylase"]),
    ("Graves disease", ["heat intolerance", "diffusely enlarged", "thyroid"]),
    ("nephrotic syndrome", ["frothy urine", "proteinuria", "albumin"]),
    ("bladder cancer", ["hematuria", "bladder wall"]),
    ("migraine with aura", ["visual scotomata", "photophobia", "phonophobia"]),
    ("mucormycosis", ["black necrotic eschar", "diabetes", "periorbital"]),
    ("hypertrophic pyloric stenosis", ["projectile", "non-bilious", "olive-shaped"]),
    ("idiopathic pulmonary fibrosis", ["honeycombing", "basal reticular", "clubbing"]),
    ("infectious mononucleosis", ["monospot", "posterior cervical", "splenomegaly"]),
    ("retinal detachment", ["curtain-like", "flashes", "floaters"]),
]
NOTE_DIAGNOSIS_PATTERNS = [
    r"(?i)with ([^.]+?)\. Stage",
    r"(?i)with ([^.]+?)\. ECOG",
    r"(?i)with ([^.]+?)\. Molecular",
    r"(?i)diagnosis of ([^.]+?)\.",
]
NOTE_BIOMARKERS = ["EGFR", "ALK", "BRAF", "KRAS", "HER2", "PD-L1", "PDL1"]
NOTE_BIOMARKER_VALUES = "positive|negative|mutated|wild type|V600E|exon 19|L858R|amplified"
LISTED_BIOMARKERS = [
    "PD-L1", "BRCA1", "BRCA2", "EGFR", "ALK", "BRAF", "HER2", "ER", "PR", "MSI", "KRAS",
    "FLT3", "NPM1",
]
NEGATORS = r"\b(no|not|without|absent|absence of|lacks?|lack of)\b"
ABSENCE_WORDS = r"\b(absent|negative|not present|is absent)\b"
NEGATION_WINDOW = 80
NOTE_CLOSING = (
    "The note is a synthetic record created for software testing, not a real patient chart."
)

# --- follow-up questions ---------------------------------------------------------------
FIELD_QUESTIONS = {
    "age": "What is the patient's age?",
    "sex": "What sex is recorded for trial eligibility purposes?",
    "diagnosis": "What is the confirmed diagnosis?",
    "stage": "What is the current disease stage?",
    "ecog": "What is the current ECOG performance status?",
    "prior_treatments": "Which prior systemic treatments has the patient received?",
}
UNKNOWN_FIELD_QUESTIONS = {
    "age": "What is the patient's age?",
    "condition": "What is the patient's confirmed diagnosis?",
    "ecog": "What is the patient's ECOG performance status?",
    "stage": "What is the patient's current disease stage?",
    "prior_platinum_chemotherapy": "Has the patient received prior platinum chemotherapy?",
    "biomarker_required": "What relevant biomarker or molecular test result is documented?",
}
CATCH_ALL_QUESTION = (
    "What missing clinical details are needed to resolve the unknown eligibility criteria?"
)
PLACEHOLDER_QUESTION = (
    "Question text was not preserved in the draft normalization; see the linked simulated "
    "answer."
)

# --- audits --------------------------------------------------------------------------------
RECORD_KEYS = ["patient_id", "patient_information_string", "candidate_trials"]
TRIAL_KEYS = [
    "conditions", "criteria_to_assess", "interventions", "known_structured_fields", "phase",
    "raw_criteria_excerpt", "retrieval_rank", "retrieval_score", "status", "trial_id",
    "trial_source_url", "trial_title",
]
CRITERION_KEYS = [
    "criterion", "criterion_id", "criterion_type", "required", "structured_value",
]
STRUCTURED_KEYS = [
    "allowed_stages", "excluded_flags", "max_age", "max_ecog", "min_age",
    "required_biomarkers", "required_prior_treatments", "sex",
]
EXCERPT_KEYS = ["eligibility_criteria_excerpt", "exclusion", "inclusion"]
FORBIDDEN_KEYS = [
    "agent_trace", "answer_key", "criterion_level_judgments", "final_assessment",
    "final_eligibility", "final_output", "gold_label", "hidden_label", "label_source",
    "teacher_label", "teacher_rationale",
]
FORBIDDEN_VALUE_PATTERN = (
    r"(?i)\b(agent_trace|final_output|teacher_label|teacher_rationale|gold_label|hidden_label)\b"
)
RUN_FORBIDDEN_KEYS = [
    "answer", "answer_key", "answers", "expected", "expected_label", "expected_output",
    "final_output", "gold", "gold_label", "ground_truth", "label", "labels",
    "teacher_label", "teacher_rationale", "target_label", "true_label",
]
RUN_FORBIDDEN_FRAGMENTS = [
    "answer_key", "gold_label", "ground_truth", "teacher_", "target_label", "true_label",
]
FORBIDDEN_PATH_TERMS = [
    "answer-key", "answer_key", "eval-report", "eval_report", "gpt-e2e-teacher-labeling",
    "gold-label", "gold_label", "hidden-eval", "hidden_eval", "teacher-label",
    "teacher_label",
]
SECRET_PATTERNS = [
    r"sk-[A-Za-z0-9]{20,}",
    r"\bup_[A-Za-z0-9]{20,}\b",
    r"\bflp_[A-Za-z0-9]{20,}\b",
    r"(?i)Bearer\s+[A-Za-z0-9._-]{20,}",
]
FINAL_SECTIONS = [
    "initial_assessment", "follow_up_questions", "simulated_patient_answers",
    "final_assessment_after_answers", "recommended_trials",
    "uncertain_but_actionable_trials", "excluded_trials", "patient_level_summary",
    "medical_disclaimer",
]
STAGE_NAMES = [
    "criteria_parser_agent", "patient_information_understanding_agent",
    "inference_matching_agent", "question_generation_agent",
    "interaction_simulation_agent", "recommendation_agent", "result_explanation_agent",
]

# --- test cohorts --------------------------------------------------------------------------
US_STATES = ["CA", "NY", "TX", "WA", "MA", "IL", "FL", "PA", "CO", "AZ"]
NEGATIVE_BIOMARKERS = {
    "EGFR": "negative", "ALK": "negative", "BRAF": "wild type", "HER2": "negative",
    "MSI": "stable", "FLT3": "negative", "BRCA1": "wild type", "BRCA2": "wild type",
    "KRAS": "mutated",
}
WRONG_DIAGNOSES = [
    "advanced renal cell carcinoma", "metastatic colorectal cancer",
    "unresectable melanoma", "relapsed acute myeloid leukemia",
]
