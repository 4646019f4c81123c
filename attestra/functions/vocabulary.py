"""Closed vocabularies. Results are compared by these strings."""

# fixed values
FILE_ROLES = (
    "subject_list", "demographics", "diagnosis_or_labels", "clinical_scale", "cognitive", "medication", "dictionary_or_codebook",
    "scanner_or_site_metadata", "visit_metadata", "imaging_derivative", "mixed", "ambiguous", "unknown",
)
COLUMN_CONCEPTS = (
    "subject_identifier", "site_identifier", "visit_identifier", "experiment_identifier", "assessment_identifier", "diagnosis", "sex_or_gender",
    "current_age", "age_at_onset", "panss_item", "panss_positive", "panss_negative", "panss_total", "medication_name", "medication_dose",
    "cpz_candidate", "cognitive_domain", "imaging_feature", "unknown_or_study_specific",
)
TASKS = ("T-FILE", "T-COL", "T-VAL", "T-ID", "T-GOV")
ACTIONS = ("recover", "accept_provisionally", "abstain", "escalate")
COMMITS = ("recover", "accept_provisionally")
SENSITIVE_CONCEPTS = ("sex_or_gender", "diagnosis", "current_age", "age_at_onset", "medication_dose")
VERIFIERS = ("get_dictionary_entry", "compare_redundant_values")
SCOPE_TOOLS = {"imaging_row_alignment": "check_imaging_order", "identifier_linkage": "check_id_overlap", "source_independence": "check_lineage"}
DEFAULT_SCOPE = "imaging_row_alignment"
INTERFACES = ("hidden", "visible", "contract")
PROVISIONAL_KEYS = ("proposed_primary_role", "proposed_concept", "component_hints")
#: Substitutes for corrupted proposals. Fixed values.
WRONG_ROLE = {
    "mixed": "demographics",
    "subject_list": "diagnosis_or_labels",
    "demographics": "subject_list",
    "diagnosis_or_labels": "demographics",
    "clinical_scale": "subject_list",
    "cognitive": "clinical_scale",
    "medication": "scanner_or_site_metadata",
    "dictionary_or_codebook": "subject_list",
}
#: Fixed value: what stands in for roles that have no substitute of their own.
OTHER_WRONG_ROLE = "unknown"
#: Fixed values.
WRONG_CONCEPT = {
    "subject_identifier": "site_identifier",
    "site_identifier": "subject_identifier",
    "visit_identifier": "subject_identifier",
    "experiment_identifier": "subject_identifier",
    "assessment_identifier": "subject_identifier",
    "diagnosis": "sex_or_gender",
    "sex_or_gender": "diagnosis",
    "current_age": "age_at_onset",
    "age_at_onset": "current_age",
    "panss_item": "panss_total",
    "panss_positive": "panss_item",
    "panss_negative": "panss_item",
    "panss_total": "panss_item",
    "medication_name": "diagnosis",
    "medication_dose": "cpz_candidate",
    "cpz_candidate": "medication_dose",
    "cognitive_domain": "clinical_scale",
}
#: What a changed relationship becomes; the last entry is our addition, as linkage can also classify so.
OTHER_RELATIONSHIP = {
    "left_complete_subset": "partial_overlap", "partial_overlap": "left_complete_subset",
    "left_complete_with_right_duplicates": "partial_overlap", "one_to_one_technical_overlap": "partial_overlap",
}
SEX_CODES = {"1": "male", "2": "female"}
