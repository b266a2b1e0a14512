"""The shipped cohort specifications (fixed values)."""

ARRIVAL = "EMERGENCY_DEPARTMENT_REGISTRATION//ARRIVAL_TRANSPORT"
LEAVING = "EMERGENCY_DEPARTMENT_DISCHARGE//DISCHARGE_LOCATION//.*"

# Everything up to and including the arrival is input; the prediction is made at the arrival.
INPUT = {"start": None, "end": "trigger", "start_inclusive": True, "end_inclusive": True, "index_timestamp": "end"}
STAY = {"start": "input.end", "end": "start -> ed_discharge", "start_inclusive": True, "end_inclusive": True}

HISTORY_UP_TO_TRIAGE = (
    "Given a patient's historical electronic health record up to and including their arrival and triage at the "
    "Emergency Department, predict the probability of "
)

HOSPITALISATION = {
    "description": HISTORY_UP_TO_TRIAGE + "admitting the patient to the hospital from the Emergency Department.",
    "predicates": {
        "ed_arrival": {"code": ARRIVAL},
        "ed_discharge": {"code": {"regex": LEAVING}},
        "ed_discharge_admitted": {"code": "EMERGENCY_DEPARTMENT_DISCHARGE//DISCHARGE_LOCATION//ADMITTED"},
    },
    "trigger": "ed_arrival",
    "windows": {
        "input": INPUT,
        "target": {
            "start": "trigger",
            "end": "start -> ed_discharge",
            "start_inclusive": True,
            "end_inclusive": True,
            "label": "ed_discharge_admitted",
        },
    },
}

ED_REATTENDANCE = {
    "description": HISTORY_UP_TO_TRIAGE
    + "the patient returning to the Emergency Department within 72 hours of discharge from the Emergency Department.",
    "predicates": {"ed_arrival": {"code": ARRIVAL}, "ed_discharge": {"code": {"regex": LEAVING}}},
    "trigger": "ed_arrival",
    "windows": {
        "input": INPUT,
        "ed_stay": STAY,
        "target": {
            "start": "ed_stay.end",
            "end": "start + 72h",
            "start_inclusive": True,
            "end_inclusive": True,
            "label": "ed_arrival",
        },
    },
}

ICU_WITHIN_12H = {
    "description": HISTORY_UP_TO_TRIAGE
    + "the patient being admitted to the ICU within 12 hours of discharge from the Emergency Department.",
    "predicates": {
        "ed_arrival": {"code": ARRIVAL},
        "ed_discharge": {"code": {"regex": LEAVING}},
        "icu_admission": {"code": {"regex": "ICU_ADMISSION//.*"}},
    },
    "trigger": "ed_arrival",
    "windows": {
        "input": INPUT,
        "ed_stay": STAY,
        "target": {
            "start": "ed_stay.end",
            "end": "start + 12h",
            "start_inclusive": True,
            "end_inclusive": True,
            "label": "icu_admission",
        },
    },
}

HOSPITAL_MORTALITY = {
    "description": HISTORY_UP_TO_TRIAGE + "the patient dying in the hospital during their stay.",
    "predicates": {
        "ed_arrival": {"code": ARRIVAL},
        # a hospital discharge, or leaving the emergency department without being admitted
        "discharge": {
            "code": {
                "regex": "HOSPITAL_DISCHARGE//DISCHARGE_LOCATION//.*"
                "|EMERGENCY_DEPARTMENT_DISCHARGE//DISCHARGE_LOCATION//"
                "(OTHER|TRANSFER|LEFT_WITHOUT_BEING_SEEN|LEFT_AGAINST_MEDICAL_ADVICE|HOME|ELOPED)"
            }
        },
        "hosp_discharge_death": {"code": "HOSPITAL_DISCHARGE//DISCHARGE_LOCATION//DIED"},
    },
    "trigger": "ed_arrival",
    "windows": {
        "input": INPUT,
        "target": {
            "start": "trigger",
            "end": "start -> discharge",
            "start_inclusive": True,
            "end_inclusive": True,
            "label": "hosp_discharge_death",
        },
    },
}

READMISSION_30D = {
    "description": "30-day Readmission Risk Prediction",
    "predicates": {
        "admission": {"prefix": "Hospital Admission", "code": {"regex": "Gender.*"}},
        "discharge": {"prefix": "Hospital Discharge", "code": {"regex": "Location.*"}},
    },
    "trigger": "admission",
    "windows": {
        "input": {
            "start": "trigger",
            "end": "start -> discharge",
            "start_inclusive": False,
            "end_inclusive": True,
            "index_timestamp": "end",
        },
        "target": {
            "start": "input.end",
            "end": "start + 30 days",
            "start_inclusive": False,
            "end_inclusive": True,
            "label": "admission",
        },
    },
}

COHORTS = {
    "hospitalisation": HOSPITALISATION,
    "ed_reattendance": ED_REATTENDANCE,
    "critical_outcome_icu_12h": ICU_WITHIN_12H,
    "critical_outcome_hospital_mortality": HOSPITAL_MORTALITY,
}

# The critical outcome is either of these two; its labels come from `combine_labels`.
CRITICAL_OUTCOME = ("critical_outcome_icu_12h", "critical_outcome_hospital_mortality")
