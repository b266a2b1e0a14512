"""Event specifications of the hospital tables (fixed values).

Each event names the parts of its code, its time column and its values; `col(x)` is a column, other parts are literals.
"""

SECONDS = "%Y-%m-%d %H:%M:%S"
DATE = "%Y-%m-%d"

TRIAGE = "EMERGENCY_DEPARTMENT_TRIAGE"
VITALS = "EMERGENCY_DEPARTMENT_VITAL_SIGNS"


def _measure(section: str, name: str, column: str, time: str, value: str = "numeric_value") -> dict:
    return {"code": [section, name], value: column, "time": f"col({time})", "time_format": [SECONDS]}


def _event(code, time: str, time_format=SECONDS, **values) -> dict:
    spec = {"code": code, "time": f"col({time})", **values}
    return spec | ({"time_format": time_format} if time_format else {})


NARRATIVE_EVENTS = {
    "subject_id_col": "subject_id",
    "ed/edstays": {
        "ed_registration": _event(
            ["EMERGENCY_DEPARTMENT_REGISTRATION", "ARRIVAL_TRANSPORT"], "intime", text_value="arrival_transport"
        ),
        "ed_out": _event(["EMERGENCY_DEPARTMENT_DISCHARGE", "DISCHARGE_LOCATION", "col(disposition)"], "outtime"),
    },
    "ed/triage": {
        "temperature": _measure(TRIAGE, "TEMPERATURE_°C", "temperature", "intime"),
        "heart_rate": _measure(TRIAGE, "HEART_RATE_BPM", "heartrate", "intime"),
        "respiratory_rate": _measure(TRIAGE, "RESPIRATORY_RATE_BREATHS/MIN", "resprate", "intime"),
        "o2_saturation": _measure(TRIAGE, "O2_SATURATION_%", "o2sat", "intime"),
        "systolic_blood_pressure": _measure(TRIAGE, "SYSTOLIC_BLOOD_PRESSURE_MMHG", "sbp", "intime"),
        "diastolic_blood_pressure": _measure(TRIAGE, "DIASTOLIC_BLOOD_PRESSURE_MMHG", "dbp", "intime"),
        "pain": _measure(TRIAGE, "PAIN_SCORE", "pain", "intime", "text_value"),
        "acuity": _measure(TRIAGE, "SEVERITY_SCORE_(1_HIGH_-_5_LOW)", "acuity", "intime"),
        "gender": _event([TRIAGE, "GENDER"], "intime", text_value="col(gender)"),
        "age": _event([TRIAGE, "AGE"], "intime", numeric_value="col(age)"),
    },
    "ed/diagnosis": {
        "diagnosis": _event(
            ["EMERGENCY_DEPARTMENT_DIAGNOSIS", "ICD", "col(icd_version)", "col(icd_code)"],
            "outtime",
            text_value="col(icd_title)",
        ),
    },
    "hosp/admissions": {
        "admission": _event(["HOSPITAL_ADMISSION", "TYPE", "col(admission_type)"], "admittime"),
        "insurance": _event(["HOSPITAL_ADMISSION", "INSURANCE"], "admittime", text_value="col(insurance)"),
        "marital_status": _event(["HOSPITAL_ADMISSION", "MARITAL_STATUS"], "admittime", text_value="col(marital_status)"),
        "race": _event(["HOSPITAL_ADMISSION", "RACE"], "admittime", text_value="col(race)"),
        "gender": _event(["HOSPITAL_ADMISSION", "GENDER"], "admittime", text_value="col(gender)"),
        "age": _event(["HOSPITAL_ADMISSION", "AGE"], "admittime", numeric_value="col(age)"),
        "discharge": _event(["HOSPITAL_DISCHARGE", "DISCHARGE_LOCATION", "col(discharge_location)"], "dischtime"),
    },
    "hosp/diagnoses_icd": {
        "diagnosis": _event(
            ["HOSPITAL_DIAGNOSIS", "ICD", "col(icd_version)", "col(icd_code)"], "dischtime", text_value="col(long_title)"
        ),
    },
    "hosp/drgcodes": {
        "drg": _event(
            ["DIAGNOSIS_RELATED_GROUPS", "col(drg_type)", "col(drg_code)", "col(description)"],
            "dischtime",
            text_value="col(description)",
        ),
    },
    "hosp/emar": {
        "medication": _event(["HOSPITAL_MEDICATION", "col(medication)", "col(event_txt)"], "charttime"),
    },
    "ed/pyxis": {
        "medication": _event(["EMERGENCY_DEPARTMENT_MEDICATION", "col(name)", "DISPENSED"], "charttime"),
    },
    "hosp/hcpcsevents": {
        "hcpcs": _event(["HEALTHCARE_COMMON_PROCEDURE_CODING_SYSTEM", "col(long_description)"], "chartdate", None),
    },
    "hosp/labevents": {
        "lab": _event(
            ["LABORATORY_RESULT", "col(fluid)", "col(label)", "col(valueuom)"], "charttime", numeric_value="valuenum"
        ),
    },
    "ed/vitalsign": {
        "temperature": _measure(VITALS, "TEMPERATURE_°C", "temperature", "charttime"),
        "heart_rate": _measure(VITALS, "HEART_RATE_BPM", "heartrate", "charttime"),
        "respiratory_rate": _measure(VITALS, "RESPIRATORY_RATE_BREATHS/MIN", "resprate", "charttime"),
        "o2_saturation": _measure(VITALS, "O2_SATURATION_%", "o2sat", "charttime"),
        "diastolic_blood_pressure": _measure(VITALS, "DIASTOLIC_BLOOD_PRESSURE_MMHG", "dbp", "charttime"),
        "systolic_blood_pressure": _measure(VITALS, "SYSTOLIC_BLOOD_PRESSURE_MMHG", "sbp", "charttime"),
        "pain": _measure(VITALS, "PAIN_SCORE", "pain", "charttime", "text_value"),
    },
    "hosp/omr": {
        "omr": _event(["OBSERVATION_MEDICAL_RECORD", "col(result_name)"], "chartdate", None, numeric_value="col(result_num)"),
    },
    "hosp/patients": {
        "dob": _event(["BIRTH", "BORN"], "year_of_birth", "%Y"),
        "death": _event(["DEATH", "DIED"], "dod", None),
    },
    "hosp/procedures_icd": {
        "procedure": _event(
            ["HOSPITAL_PROCEDURE", "ICD", "col(icd_version)", "col(icd_code)"], "chartdate", None, text_value="col(long_title)"
        ),
    },
    "hosp/transfers": {
        "transfer": _event(["HOSPITAL_TRANSFER", "col(eventtype)", "TO", "col(careunit)"], "intime"),
    },
    "icu/icustays": {
        "icu_admission": _event(["ICU_ADMISSION", "col(first_careunit)"], "intime"),
        "icu_discharge": _event(["ICU_DISCHARGE", "col(last_careunit)"], "outtime"),
    },
}


def _bedside(time: str) -> dict:
    ids = {"stay_id": "stay_id"}
    return {
        "temperature": _event("TEMPERATURE", time, [SECONDS], numeric_value="temperature", **ids),
        "heart_rate": _event("HEART_RATE", time, [SECONDS], numeric_value="heartrate", **ids),
        "respiratory_rate": _event("RESPIRATORY_RATE", time, [SECONDS], numeric_value="resprate", **ids),
        "o2_saturation": _event("O2_SATURATION", time, [SECONDS], numeric_value="o2sat", **ids),
        "blood_pressure": _event("Blood Pressure", time, [SECONDS], numeric_value="sbp", text_value="dbp", **ids),
        "pain": _event("PAIN", time, [SECONDS], text_value="pain", **ids),
    }


# The comparison schema: short codes, ids passed through, gender as a static event.
STRUCTURED_EVENTS = {
    "subject_id_col": "subject_id",
    "ed/edstays": {
        "ed_registration": _event(
            "ED_REGISTRATION", "intime", text_value="arrival_transport", hadm_id="hadm_id", stay_id="stay_id"
        ),
        "ed_out": _event("ED_OUT", "outtime", text_value="disposition", hadm_id="hadm_id", stay_id="stay_id"),
    },
    "ed/triage": _bedside("intime")
    | {"acuity": _event("ACUITY", "intime", [SECONDS], numeric_value="acuity", stay_id="stay_id")},
    "ed/diagnosis": {
        "diagnosis": _event(["DIAGNOSIS", "ICD", "col(icd_version)", "col(icd_code)"], "outtime", stay_id="stay_id"),
    },
    "hosp/admissions": {
        "admission": _event(
            ["HOSPITAL_ADMISSION", "col(admission_type)", "col(admission_location)"],
            "admittime",
            insurance="insurance",
            language="language",
            marital_status="marital_status",
            race="race",
            hadm_id="hadm_id",
        ),
        "discharge": _event(["HOSPITAL_DISCHARGE", "col(discharge_location)"], "dischtime", hadm_id="hadm_id"),
    },
    "hosp/diagnoses_icd": {
        "diagnosis": _event(["DIAGNOSIS", "ICD", "col(icd_version)", "col(icd_code)"], "dischtime", hadm_id="hadm_id"),
    },
    "hosp/drgcodes": {
        "drg": _event(
            ["DRG", "col(drg_type)", "col(drg_code)", "col(description)"],
            "dischtime",
            text_value="col(drg_type)",
            hadm_id="hadm_id",
            drg_severity="drg_severity",
            drg_mortality="drg_mortality",
        ),
    },
    "hosp/emar": {
        "medication": _event(
            ["MEDICATION", "col(medication)", "col(event_txt)"],
            "charttime",
            hadm_id="hadm_id",
            emar_id="emar_id",
            emar_seq="emar_seq",
        ),
    },
    "ed/pyxis": {
        "medication": _event(["MEDICATION", "col(name)", "Administered"], "charttime", stay_id="stay_id"),
    },
    "hosp/hcpcsevents": {
        "hcpcs": _event(["HCPCS", "col(short_description)"], "chartdate", DATE, hadm_id="hadm_id"),
    },
    "hosp/labevents": {
        "lab": _event(
            ["LAB", "col(itemid)", "col(valueuom)"],
            "charttime",
            numeric_value="valuenum",
            text_value="value",
            hadm_id="hadm_id",
            priority="priority",
        ),
    },
    "ed/vitalsign": _bedside("charttime"),
    "hosp/omr": {"omr": _event("col(result_name)", "chartdate", DATE, text_value="col(result_value)")},
    "hosp/patients": {
        "gender": {"code": ["GENDER", "col(gender)"], "time": None},
        "dob": _event("MEDS_BIRTH", "year_of_birth", "%Y"),
        "death": _event("MEDS_DEATH", "dod", [SECONDS, DATE]),
    },
    "hosp/procedures_icd": {
        "procedure": _event(["PROCEDURE", "ICD", "col(icd_version)", "col(icd_code)"], "chartdate", DATE, hadm_id="hadm_id"),
    },
    "hosp/transfers": {
        "transfer": _event(["TRANSFER_TO", "col(eventtype)", "col(careunit)"], "intime", hadm_id="hadm_id"),
    },
    "icu/icustays": {
        "icu_admission": _event(["ICU_ADMISSION", "col(first_careunit)"], "intime", hadm_id="hadm_id", icustay_id="stay_id"),
        "icu_discharge": _event(["ICU_DISCHARGE", "col(last_careunit)"], "outtime", hadm_id="hadm_id", icustay_id="stay_id"),
    },
}

# The comparison schema for hospitals without emergency tables: registration and departure come with the admissions.
STRUCTURED_EVENTS_WITHOUT_ED = {name: spec for name, spec in STRUCTURED_EVENTS.items() if not name.startswith("ed/")} | {
    "hosp/admissions": {
        "ed_registration": _event("ED_REGISTRATION", "edregtime"),
        "ed_out": _event("ED_OUT", "edouttime"),
    }
    | STRUCTURED_EVENTS["hosp/admissions"],
    "hosp/drgcodes": {
        "drg": {k: v for k, v in STRUCTURED_EVENTS["hosp/drgcodes"]["drg"].items() if k != "text_value"},
    },
}
