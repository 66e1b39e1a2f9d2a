"""Every code list, limit, threshold and pattern below is part of the
result definition and must stay exactly as it is."""

# --- item codes -> variable -------------------------------------------------
VITAL_CODES = {
    "heart_rate": [220045],
    "resp_rate": [220210],
    "map": [220052],
    "temp": [223761, 223762],
    "sbp": [220179],
    "dbp": [220180],
    "spo2": [220277],
}
LAB_CODES = {
    "bun": [51006],
    "alkaline_phosphatase": [50863],
    "bilirubin": [50885],
    "creatinine": [50912],
    "glucose": [50931],
    "platelets": [51265],
    "hemoglobin": [51222],
    "wbc": [51301],
    "sodium": [50983],
    "potassium": [50971],
    "lactate": [50813],
    "hematocrit": [51221],
    "chloride": [50902],
    "bicarbonate": [50882],
    "anion_gap": [50868],
    "inr": [51237, 51675],
}
URINE_CODES = [226559, 226560, 226561, 226584, 226563, 226564, 226565, 226567, 226557, 226558, 227489, 227488, 226627, 226631]
HEIGHT_CODES = [226730, 226707, 1394, 216235, 3486, 3485]
WEIGHT_CODES = [226512, 226531, 224639, 763, 3580, 3693, 3581]
FAHRENHEIT_CODES = [223761]
INCH_CODES = [226730, 1394, 3486]
POUND_CODES = [226531, 763, 3693]

# --- value ranges -----------------------------------------------------------
NORMAL_RANGES = {
    "heart_rate": (60, 100),
    "resp_rate": (12, 20),
    "map": (65, 110),
    "sbp": (90, 140),
    "dbp": (50, 90),
    "spo2": (92, 100),
    "temp": (36, 38),
    "lactate": (0, 2),
    "creatinine": (0, 1.5),
    "bun": (0, 25),
    "bilirubin": (0, 1.2),
    "inr": (0.8, 1.2),
    "platelets": (150, 450),
    "wbc": (4, 11),
    "hemoglobin": (12, 18),
    "bicarbonate": (22, 29),
    "anion_gap": (8, 16),
}
OUTLIER_RANGES = {
    "heart_rate_mean": (30, 200),
    "resp_rate_mean": (5, 60),
    "map_mean": (40, 180),
    "sbp_mean": (60, 220),
    "dbp_mean": (30, 120),
    "temp_mean": (33, 42),
    "spo2_mean": (60, 100),
    "glucose_mean": (30, 600),
    "creatinine_mean": (0.1, 15),
    "lactate_mean": (0.1, 30),
}
LAB_LIMITS = {
    "glucose": (20, 600),
    "creatinine": (0.1, 15),
    "sodium": (110, 175),
    "potassium": (1.5, 9),
    "bun": (1, 200),
    "wbc": (0, 100),
    "hemoglobin": (1, 25),
    "platelets": (1, 1000),
    "lactate": (0.1, 30),
    "bilirubin": (0.1, 30),
    "alkaline_phosphatase": (1, 1000),
    "hematocrit": (5, 65),
    "chloride": (70, 150),
    "bicarbonate": (5, 50),
    "anion_gap": (1, 40),
    "inr": (0.5, 12),
}
VITAL_LIMITS = {
    "heart_rate": (20, 220),
    "resp_rate": (4, 60),
    "sbp": (30, 250),
    "dbp": (20, 180),
    "map": (20, 200),
    "spo2": (50, 100),
}

# --- row rules --------------------------------------------------------------
ORGAN_RULES = {
    "cardiovascular_dysfunction": [("map_min", "<", 65), ("sbp_min", "<", 90), ("shock_index", ">", 0.9)],
    "respiratory_dysfunction": [("spo2_min", "<", 92), ("resp_rate_max", ">", 30), ("resp_distress_score", ">", 30)],
    "renal_dysfunction": [("creatinine_max", ">=", 1.5), ("bun_max", ">=", 40), ("urine_output_total", "<", 300)],
    "hepatic_dysfunction": [("bilirubin_max", ">=", 2.0), ("inr_max", ">=", 1.5)],
    "coagulation_dysfunction": [("platelets_min", "<", 100), ("hemoglobin_min", "<", 8)],
    "metabolic_dysfunction": [("lactate_max", ">=", 2.0), ("bicarbonate_min", "<", 18), ("anion_gap_max", ">", 16)],
}
CRITICAL_RULES = [
    ("lactate_max", ">", 4.0), ("potassium_max", ">", 6.0), ("potassium_min", "<", 2.8),
    ("sodium_max", ">", 155), ("sodium_min", "<", 125), ("bicarbonate_min", "<", 15),
    ("glucose_max", ">", 400), ("glucose_min", "<", 50), ("calcium_min", "<", 7.0),
    ("phosphate_max", ">", 7.0), ("wbc_max", ">", 25), ("wbc_min", "<", 2),
    ("platelets_min", "<", 50), ("hemoglobin_min", "<", 7), ("inr_max", ">", 2.0),
    ("heart_rate_max", ">", 140), ("sbp_min", "<", 80), ("resp_rate_max", ">", 30),
    ("temp_max", ">", 39.5), ("temp_min", "<", 35.0), ("spo2_min", "<", 88),
    ("bilirubin_max", ">", 4.0), ("creatinine_max", ">", 3.0), ("bun_max", ">", 50),
    ("troponin_max", ">", 0.5), ("ph_min", "<", 7.25), ("ph_max", ">", 7.55),
    ("fibrinogen_min", "<", 100), ("albumin_min", "<", 2.0), ("amylase_max", ">", 500),
    ("lipase_max", ">", 1000), ("co2_min", "<", 15), ("pco2_max", ">", 60),
    ("pco2_min", "<", 25), ("gcs_min", "<", 9), ("neutrophil_min", "<", 1.0),
    ("procalcitonin_max", ">", 10.0), ("alt_max", ">", 1000), ("ast_max", ">", 1000),
    ("magnesium_min", "<", 1.2), ("ddimer_max", ">", 5000), ("ferritin_max", ">", 2000),
    ("stroke_volume_min", "<", 50), ("cardiac_index_min", "<", 2.0), ("base_excess_min", "<", -8),
    ("pao2_min", "<", 60), ("fio2_max", ">", 0.5),
]
# channel, below, above: critical when value < below or value > above
GRID_CRITICAL_RULES = [
    ("heart_rate_last", 40, 130), ("respiratory_rate_last", 8, 30), ("sbp_min", 90, None),
    ("map_min", 65, None), ("temperature_last", 36, 38.5), ("spo2_min", 90, None),
    ("wbc_last", 4, 12), ("hemoglobin_last", 8, None), ("platelets_last", 100, None),
    ("sodium_last", 130, 150), ("potassium_last", 3, 5.5), ("creatinine_last", None, 2),
    ("bun_last", None, 40), ("glucose_last", 70, 180), ("bilirubin_last", None, 2),
    ("inr_last", None, 1.5), ("lactate_last", None, 2), ("bicarbonate_last", 18, None),
    ("anion_gap_last", None, 16),
]
NORMAL_POINTS = {
    "temp_mean": 36.5,
    "heart_rate_mean": 75,
    "resp_rate_mean": 15,
    "lactate_mean": 1.0,
    "sbp_mean": 120,
    "spo2_mean": 97,
}
TREND_GROUPS = ["lactate", "heart_rate", "sbp", "dbp", "resp_rate", "temp", "spo2"]
LOG_LABS = ["bilirubin", "creatinine", "lactate", "wbc", "platelets", "alkaline_phosphatase", "bun"]
HOUR_DELTAS = [("spo2", 1, 2), ("lactate", 4, 6), ("dbp", 0, 1), ("sodium", 3, 4), ("wbc", 0, 6),
               ("heart_rate", 2, 3), ("resp_rate", 4, 6)]
ORGAN_MARKERS = {
    "renal": ["creatinine_max", "bun_max", "urine_output_total"],
    "liver": ["bilirubin_max", "alkaline_phosphatase_max"],
    "cardiac": ["heart_rate_max", "sbp_min", "shock_index"],
    "respiratory": ["resp_rate_max", "spo2_min"],
    "hematologic": ["platelets_min", "inr_max", "hemoglobin_min"],
}
HIGH_IS_WORSE = ["creatinine", "bun", "bilirubin", "heart_rate", "resp_rate", "inr"]
LOW_IS_WORSE = ["sbp", "platelets", "spo2", "hemoglobin", "urine_output"]
AGE_BINS = [(0, 40, "young_adult"), (40, 60, "middle_aged"), (60, 80, "elderly"), (80, 120, "very_elderly")]
BMI_BY_AGE = {"M": [(30, 24.5), (45, 26.0), (60, 27.5), (None, 26.8)],
              "F": [(30, 23.8), (45, 25.5), (60, 26.8), (None, 26.2)]}
DEFAULT_BMI = 26.0

# --- diagnosis chapters -----------------------------------------------------
CHAPTERS = [
    "infectious_parasitic", "neoplasms", "endocrine_metabolic", "blood_disorders", "mental_disorders",
    "nervous_sensory", "circulatory", "respiratory", "digestive", "genitourinary", "pregnancy_childbirth",
    "skin_subcutaneous", "musculoskeletal_connective", "congenital_anomalies", "perinatal_conditions",
    "symptoms_signs_illdefined", "injury_poisoning", "external_causes", "factors_health_status",
    "other_icd9", "other_icd10", "unknown",
]
ICD9_RANGES = [
    (1, 139, "infectious_parasitic"), (140, 239, "neoplasms"), (240, 279, "endocrine_metabolic"),
    (280, 289, "blood_disorders"), (290, 319, "mental_disorders"), (320, 389, "nervous_sensory"),
    (390, 459, "circulatory"), (460, 519, "respiratory"), (520, 579, "digestive"),
    (580, 629, "genitourinary"), (630, 679, "pregnancy_childbirth"), (680, 709, "skin_subcutaneous"),
    (710, 739, "musculoskeletal_connective"), (740, 759, "congenital_anomalies"),
    (760, 779, "perinatal_conditions"), (780, 799, "symptoms_signs_illdefined"),
    (800, 999, "injury_poisoning"),
]
# regular expression on the upper-cased code -> chapter, first match wins
ICD10_PREFIXES = [
    ("^[AB]", "infectious_parasitic"), ("^C|^D[0-4]", "neoplasms"), ("^D[5-9]", "blood_disorders"),
    ("^E", "endocrine_metabolic"), ("^F", "mental_disorders"), ("^G|^H[0-9]", "nervous_sensory"),
    ("^I", "circulatory"), ("^J", "respiratory"), ("^K", "digestive"), ("^L", "skin_subcutaneous"),
    ("^M", "musculoskeletal_connective"), ("^N", "genitourinary"), ("^O", "pregnancy_childbirth"),
    ("^P", "perinatal_conditions"), ("^Q", "congenital_anomalies"), ("^R", "symptoms_signs_illdefined"),
    ("^[ST]", "injury_poisoning"), ("^[V-Y]", "external_causes"), ("^Z", "factors_health_status"),
]
METASTATIC_ICD9_PREFIXES = ["196", "197", "198"]
METASTATIC_ICD9_EXACT = ["1990", "1991"]
METASTATIC_ICD10_PREFIXES = ["C77", "C78", "C79", "C7B", "C80"]

# --- column guards ----------------------------------------------------------
IDENTIFIER_COLUMNS = ["subject_id", "hadm_id", "stay_id", "patient_id", "icustay_id"]
OUTCOME_TERMS = ["death", "deathtime", "dod", "expire", "expired", "mortality", "outcome", "survival", "died",
                 "discharge", "dischtime", "outtime", "length_of_stay", "time_in_hospital", "duration_hours"]
IRRELEVANT_TERMS = ["id", "time", "date", "minute", "hour", "day"]
KEPT_TIME_TERMS = ["los", "time_in_hospital", "time_delta", "duration"]
TIMESTAMP_TERMS = ["time", "date", "admission", "discharge", "admittime", "dischtime", "intime", "outtime",
                   "charttime", "storetime"]
CLINICAL_TERMS = ["heart_rate", "resp_rate", "sbp", "dbp", "map", "spo2", "temp", "lactate", "creatinine", "bun",
                  "glucose", "wbc", "platelets", "hemoglobin", "sodium", "potassium", "age", "shock_index", "bmi",
                  "duration_hours", "anion_gap"]
DERIVED_SUFFIXES = ["_log", "_min", "_max", "_mean", "_delta"]
SCALE_EXCLUDED = ["subject_id", "hadm_id", "stay_id", "mortality", "target", "label"]
RESTORE_LIMITS = {"demographic": 0.3, "vitals": 0.5, "labs": 0.6, "always": None}
RESTORE_COLUMNS = {
    "demographic": ["age"],
    "vitals": ["heart_rate_mean", "heart_rate_min", "sbp_mean", "dbp_mean", "map_mean", "resp_rate_mean",
               "temp_mean", "spo2_mean"],
    "labs": ["lactate_max", "wbc_mean", "creatinine_mean", "bun_mean", "glucose_mean", "platelets_mean",
             "hemoglobin_mean", "sodium_mean", "potassium_mean", "bicarbonate_mean"],
    "always": ["gender_numeric", "has_prior_diagnoses", "duration_hours"],
}

# --- regular grid -----------------------------------------------------------
VARIABLE_ALIASES = {"resp_rate": "respiratory_rate", "rr": "respiratory_rate", "temp": "temperature",
                    "platelet": "platelets", "alk_phos": "alkaline_phosphatase"}
GRID_VITALS = ["heart_rate", "respiratory_rate", "sbp", "dbp", "map", "temperature", "spo2"]
GRID_LABS = ["wbc", "hemoglobin", "hematocrit", "platelets", "sodium", "potassium", "creatinine", "bun", "glucose",
             "bilirubin", "alkaline_phosphatase", "alt", "ast", "inr", "lactate", "bicarbonate", "anion_gap"]
GRID_DERIVED = ["shock_index_bin", "hypotension_flag_bin", "hypoxemia_flag_bin", "sirs_count_bin",
                "critical_value_count_bin"]

# --- feature name families: name, full-match pattern, group, allowed, first match wins --
_V = "heart_rate|resp_rate|map|temp|sbp|dbp|spo2"
_L = ("bun|alkaline_phosphatase|bilirubin|creatinine|glucose|platelets|hemoglobin|wbc|sodium|potassium|lactate|"
      "hematocrit|chloride|bicarbonate|anion_gap|inr")
_VL = f"({_V}|{_L})"
FEATURE_FAMILIES = [
    ("age", "age|age_(young_adult|middle_aged|elderly|very_elderly)", "demographic", True),
    ("gender_numeric", "gender_numeric|gender_[A-Za-z0-9_]+", "demographic", True),
    ("bmi", "bmi", "demographic", True),
    ("bmi_measured", "bmi_measured|bmi_missing", "missingness", True),
    ("vital_summary", f"({_V})_(mean|min|max)", "vital", True),
    ("vital_measured", f"({_V})(_(mean|min|max))?_(measured|missing)", "missingness", True),
    ("lab_summary", f"({_L})_(mean|min|max|delta)", "lab", True),
    ("lab_measured", f"({_L})(_(mean|min|max|delta))?_(measured|missing)", "missingness", True),
    ("urine_output_total", "urine_output_(total|measured)", "fluid_balance", True),
    ("time_window_value", f"{_VL}_hour_(0|1|2|3|4|6)", "time_window", True),
    ("time_window_change", f"{_VL}_(change_0to6|hourly_change|delta_[0-9]+to[0-9]+)", "trajectory", True),
    ("hourly_bin_summary", f"{_VL}_bin_[0-5]_[1-6]h_(mean|min|max|last|observed|count)", "time_window", True),
    ("trajectory_summary", f"{_VL}_(first|last|last_minus_first|percent_change|first_2h_mean|last_2h_mean|"
     "last2h_minus_first2h|slope_0_6h|deterioration_flag|recovery_flag)", "trajectory", True),
    ("instability_summary", f"{_VL}_(range_0_6h|std_0_6h|cv_0_6h|abnormal_count_0_6h|"
     "longest_abnormal_run_0_6h|worst_recent_value_0_6h)", "instability", True),
    ("measurement_process", f"({_VL}_(measured_0_6h|measurement_count_0_6h|time_to_first_measurement|"
     "time_since_last_measurement_at_6h)|total_(lab|vital|chart)_measurements_0_6h|total_measurements_0_6h|"
     "total_chart_event_count_0_6h|panel_missing_count_0_6h)", "measurement_process", True),
    ("prior_diagnosis", "has_prior_diagnoses|prev_dx_[A-Za-z0-9_]+_count|prev_dx_count_total", "diagnosis", True),
    ("has_metastatic_cancer", "has_metastatic_cancer", "diagnosis", False),
    ("derived_clinical", "has_[A-Za-z0-9_]+|shock_index|shock_lactate_interaction|bun_creatinine_ratio|"
     "resp_distress(_score)?|sirs_criteria_count|[A-Za-z0-9_]+_dysfunction|organ_dysfunction_count|"
     "age_comorbidity|[A-Za-z0-9_]+_x_[A-Za-z0-9_]+|hr_sbp_ratio|map_variance_x_lactate|sirs_x_lactate",
     "derived_clinical", True),
    ("organ_dysfunction_proxy", "(cardiovascular|respiratory|renal|hepatic|coagulation|metabolic)_dysfunction|"
     "organ_dysfunction_count", "organ_dysfunction", True),
    ("clinical_interaction", "age_x_prev_dx_count|age_x_shock_index|lactate_x_hypotension|"
     "resp_rate_x_spo2_deficit|platelets_x_inr|sirs_x_lactate|creatinine_x_urine_output|bilirubin_x_inr|"
     "critical_count_x_missing_lab_count", "interaction", True),
    ("temporal_trend", f"{_VL}_(pct_change|trend)", "trajectory", True),
    ("distance_or_polynomial", f"{_VL}(_(mean|min|max))?_(squared|dist_from_normal|log)", "derived_clinical", True),
]

# --- resampling: cumulative Poisson(1) probabilities for 0..7 ---
POISSON_CUTS = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
                0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]

# --- evaluation -------------------------------------------------------------
NAMED_THRESHOLDS = {"standard": 0.50, "f1_optimized": 0.45, "balanced": 0.30, "high_sensitivity": 0.20,
                    "clinical_utility": 0.10}
RESULT_FIELDS = ["model_name", "split", "auc_roc", "average_precision", "brier_score", "threshold_policy",
                 "threshold", "accuracy", "precision", "recall", "specificity", "f1", "npv", "n", "positive_rate"]
# fixed values: odd multipliers below 2^31 (products of two stay in 63 bits) and a constant of the resampling hash
MIX = (0x21F0AAAD, 0x735A2D97, 0x3C6EF372)
