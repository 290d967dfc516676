"""Schemas of the inputs."""

from __future__ import annotations


def _strings(names: list[str]) -> str:
    return ", ".join(f"{name} string" for name in names)


# --- Fixed values: field lists of the public record sets ---
RAW_FIELDS = {
    "osha_inspections": [
        "activity_nr", "estab_name", "site_address", "site_city", "site_state", "site_zip", "naics_code", "open_date",
        "close_case_date", "insp_type", "owner_type",
    ],
    "osha_violations": [
        "activity_nr", "citation_id", "viol_type", "gravity", "nr_instances", "initial_penalty", "current_penalty",
        "abate_date", "issuance_date",
    ],
    "whd_actions": [
        "trade_nm", "legal_name", "street_addr_1_txt", "cty_nm", "st_cd", "zip_cd", "naics_code_description",
        "naic_cd", "findings_start_date", "findings_end_date", "bw_atp_amt", "ee_violtd_cnt", "case_id",
    ],
    "msha_mines": [
        "MINE_ID", "MINE_NAME", "MINE_TYPE", "MINE_STATUS", "STATE", "FIPS_CNTY_CD", "FIPS_CNTY_NM", "PRIMARY_SIC",
        "PRIMARY_SIC_DESC", "PRIMARY_CANVASS_CD", "CURRENT_MINE_NAME", "CURRENT_MINE_TYPE", "CURRENT_MINE_STATUS",
        "CURRENT_CONTROLLER_ID", "CURRENT_CONTROLLER_NAME", "CURRENT_OPERATOR_ID", "CURRENT_OPERATOR_NAME",
        "LATITUDE", "LONGITUDE", "AVG_MINE_EMP_CNT", "AVG_MINE_EMP_CNT_COAL", "AVG_MINE_EMP_CNT_MNM",
    ],
    "msha_violations": [
        "EVENT_NO", "MINE_ID", "VIOLATION_NO", "VIOLATOR_ID", "VIOLATOR_NAME", "VIOLATION_OCCUR_DT",
        "VIOLATION_ISSUE_DT", "SECTION_OF_ACT", "SIG_SUB", "PROPOSED_PENALTY", "AMOUNT_PAID", "ASSESSED_PENALTY",
        "NEGLIGENCE", "GRAVITY", "INJ_ILLNESS",
    ],
    "msha_inspections": [
        "EVENT_NO", "MINE_ID", "INSPECTION_BEGIN_DT", "INSPECTION_END_DT", "INSP_TYPE_CD", "INSPECTED_LAST_DT",
        "TOTAL_VIOLATIONS", "TOTAL_S_AND_S_VIOLATIONS",
    ],
}
SERVING_COLUMNS = [
    "employer_id", "snapshot_date", "pipeline_run_id", "employer_name", "address", "city", "state", "zip", "naics_code",
    "naics_description", "osha_inspections", "osha_violations", "osha_serious_willful", "osha_total_penalties",
    "osha_open_date_latest", "osha_avg_gravity", "whd_cases", "whd_backwages_total", "whd_ee_violated_total",
    "msha_violations", "msha_assessed_penalties", "risk_tier", "risk_score", "confidence_tier", "trend_signal",
    "location_count", "parent_name",
]
SERVING_RENAMES = {
    "zip5": "zip", "osha_willful_count": "osha_serious_willful", "osha_last_inspection_date": "osha_open_date_latest",
}
SERVING_COUNTS = [
    "osha_inspections", "osha_violations", "osha_serious_willful", "location_count", "whd_cases",
    "whd_ee_violated_total",
]
FEEDBACK_TYPES = ["incorrect_match", "missing_data", "wrong_employer", "other"]
# --- end of fixed values ---

RAW_SCHEMAS = {source: _strings(fields) for source, fields in RAW_FIELDS.items()}
PARENT_SEED_SCHEMA = "name_pattern string, parent_name string, match_type string"
NAICS_SEED_SCHEMA = "naics_code string, naics_title string"
OWNERSHIP_SCHEMA = "id string, schema string, properties map<string, array<string>>"
