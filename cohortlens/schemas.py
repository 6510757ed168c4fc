"""Explicit schemas.  Never inferred: a map with varying keys would become a struct."""

PATIENTS = (
    "patient_id STRING, age INT, sex STRING, diagnosis STRING, stage STRING, ecog INT, "
    "biomarkers MAP<STRING,STRING>, prior_treatments ARRAY<STRING>, "
    "flags MAP<STRING,BOOLEAN>, location MAP<STRING,STRING>, clinical_note STRING, "
    "scenario STRING, target_trial_id STRING"
)
# As landed, with the aliases and the loose types the loader accepts.
RAW_PATIENTS = (
    "patient_id STRING, id STRING, num STRING, age STRING, sex STRING, diagnosis STRING, "
    "stage STRING, ecog STRING, biomarkers MAP<STRING,STRING>, "
    "prior_treatments ARRAY<STRING>, flags MAP<STRING,STRING>, location MAP<STRING,STRING>, "
    "clinical_note STRING, note STRING, title STRING, scenario STRING, target_trial_id STRING"
)
TRIALS = (
    "trial_id STRING, title STRING, phase STRING, conditions ARRAY<STRING>, "
    "interventions ARRAY<STRING>, min_age INT, max_age INT, sex STRING, "
    "allowed_stages ARRAY<STRING>, max_ecog INT, required_biomarkers MAP<STRING,STRING>, "
    "required_prior_treatments ARRAY<STRING>, excluded_flags ARRAY<STRING>, "
    "required_patient_fields ARRAY<STRING>, summary STRING, status STRING, enrollment INT, "
    "source_url STRING, eligibility_criteria STRING, inclusion_criteria ARRAY<STRING>, "
    "exclusion_criteria ARRAY<STRING>"
)
RAW_TRIALS = (
    "trial_id STRING, nct_id STRING, id STRING, title STRING, phase STRING, "
    "conditions ARRAY<STRING>, interventions ARRAY<STRING>, min_age STRING, max_age STRING, "
    "sex STRING, allowed_stages ARRAY<STRING>, max_ecog STRING, "
    "required_biomarkers MAP<STRING,STRING>, required_prior_treatments ARRAY<STRING>, "
    "excluded_flags ARRAY<STRING>, required_patient_fields ARRAY<STRING>, summary STRING, "
    "status STRING, enrollment STRING, source_url STRING, eligibility_criteria STRING, "
    "inclusion_criteria ARRAY<STRING>, exclusion_criteria ARRAY<STRING>"
)
TOPICS = "topics ARRAY<STRUCT<num: STRING, id: STRING, title: STRING>>"
STUDY = (
    "STRUCT<protocolSection: STRUCT<"
    "identificationModule: STRUCT<nctId: STRING, briefTitle: STRING, officialTitle: STRING>, "
    "descriptionModule: STRUCT<briefSummary: STRING>, "
    "statusModule: STRUCT<overallStatus: STRING>, "
    "conditionsModule: STRUCT<conditions: ARRAY<STRING>>, "
    "designModule: STRUCT<phases: ARRAY<STRING>, enrollmentInfo: STRUCT<count: INT>>, "
    "armsInterventionsModule: STRUCT<interventions: ARRAY<STRUCT<name: STRING>>>, "
    "eligibilityModule: STRUCT<minimumAge: STRING, maximumAge: STRING, sex: STRING, "
    "eligibilityCriteria: STRING>>>"
)
STUDY_PAGES = f"nextPageToken STRING, studies ARRAY<{STUDY}>"
CRITERION = (
    "STRUCT<criterion_id: STRING, criterion_type: STRING, criterion: STRING, "
    "structured_value: VARIANT, required: BOOLEAN>"
)
CANDIDATE = (
    "STRUCT<trial_id: STRING, trial_title: STRING, title: STRING, trial_source_url: STRING, "
    "source_url: STRING, retrieval_rank: INT, retrieval_score: DOUBLE, "
    "conditions: ARRAY<STRING>, phase: STRING, status: STRING, interventions: ARRAY<STRING>, "
    f"known_structured_fields: VARIANT, criteria_to_assess: ARRAY<{CRITERION}>, "
    "raw_criteria_excerpt: STRUCT<inclusion: ARRAY<STRING>, exclusion: ARRAY<STRING>, "
    "eligibility_criteria_excerpt: STRING>>"
)
RECORDS = (
    "patient_id STRING, patient_information_string STRING, "
    f"candidate_trials ARRAY<{CANDIDATE}>"
)
ANSWERS = (
    "patient_id STRING, simulated_patient_answers "
    "ARRAY<STRUCT<question_id: STRING, answer: STRING, source: STRING>>"
)
STATUS_ROW = "STRUCT<criterion_id: STRING, status: STRING, reason: STRING>"
ASSESSED = (
    "STRUCT<trial_id: STRING, trial_title: STRING, trial_source_url: STRING, "
    f"eligibility: STRING, criterion_results: ARRAY<{STATUS_ROW}>, "
    "related_question_ids: ARRAY<STRING>, explanation: STRING, source: STRING, "
    "patient_id: STRING>"
)
FINAL_OUTPUT = (
    f"STRUCT<initial_assessment: STRUCT<evaluated_trials: ARRAY<{ASSESSED}>>, "
    f"final_assessment_after_answers: STRUCT<evaluated_trials: ARRAY<{ASSESSED}>>, "
    "follow_up_questions: ARRAY<STRUCT<question_id: STRING, question: STRING, reason: STRING, "
    "source: STRING, needed_for: ARRAY<STRUCT<trial_id: STRING, criterion_id: STRING>>>>, "
    "simulated_patient_answers: ARRAY<STRUCT<question_id: STRING, answer: STRING, "
    "source: STRING>>, "
    "recommended_trials: ARRAY<STRUCT<rank: INT, trial_id: STRING, trial_title: STRING, "
    "eligibility: STRING, recommendation_reason: STRING, "
    "supporting_criterion_ids: ARRAY<STRING>, related_question_ids: ARRAY<STRING>>>, "
    "uncertain_but_actionable_trials: ARRAY<STRUCT<trial_id: STRING, trial_title: STRING, "
    "eligibility: STRING, reason: STRING, unknown_criterion_ids: ARRAY<STRING>, "
    "related_question_ids: ARRAY<STRING>>>, "
    "excluded_trials: ARRAY<STRUCT<trial_id: STRING, trial_title: STRING, "
    "eligibility: STRING, exclusion_reason: STRING, "
    f"violated_criteria: ARRAY<{STATUS_ROW}>, related_question_ids: ARRAY<STRING>>>, "
    "patient_level_summary: STRING, medical_disclaimer: STRING>"
)
PREDICTIONS = (
    "patient_id STRING, patient_information_string STRING, "
    f"candidate_trials ARRAY<{CANDIDATE}>, final_output {FINAL_OUTPUT}"
)
PAIR_LABELS = (
    "pair_id STRING, patient_id STRING, trial_id STRING, eligibility STRING, "
    f"criterion_results ARRAY<{STATUS_ROW}>, follow_up_questions ARRAY<STRING>, "
    "rationale STRING, source STRING"
)
MODEL_CALLS = (
    "patient_id STRING, agent STRING, call_pos INT, ok BOOLEAN, http_status STRING, "
    "retry_after STRING, ms BIGINT, finish_reason STRING, json_ok BOOLEAN, "
    "json_repaired BOOLEAN, token_usage MAP<STRING,BIGINT>, error STRING, content STRING"
)
EVIDENCE = "STRUCT<criterion: STRING, status: STRING, detail: STRING>"
