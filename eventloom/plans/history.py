"""The configured stage lists: event table clean-up, and event table to text."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from eventloom.operators import transforms as t
from eventloom.operators.narrative import labelled_subjects, narratives
from eventloom.plans.timeline import Timeline, layout_of, written

Stage = Callable[[DataFrame], DataFrame]

# Parameters of the clean-up stages.
MEASURED_PREFIXES = ["EMERGENCY_DEPARTMENT_TRIAGE", "EMERGENCY_DEPARTMENT_VITAL_SIGNS", "LABORATORY_RESULT"]
DROPPED_CODES = [
    {"regex": "^DIAGNOSIS_RELATED_GROUPS//.*", "except_regex": "^DIAGNOSIS_RELATED_GROUPS//HCFA.*"},
    {"regex": "^HOSPITAL_TRANSFER//.*", "except_regex": "^HOSPITAL_TRANSFER//(ADMIT|TRANSFER).*"},
]
CODE_CLEANING = {
    "column": "code",
    "strip_whitespace": True,
    "to_uppercase": True,
    "patterns": [{"pattern": r"(\s){1,}", "replacement": "_"}],
}
ORDER_PREFIXES = [
    "BIRTH",
    "EMERGENCY_DEPARTMENT_REGISTRATION",
    "EMERGENCY_DEPARTMENT_TRIAGE",
    "EMERGENCY_DEPARTMENT_VITAL_SIGNS",
    "EMERGENCY_DEPARTMENT_MEDICATION",
    "EMERGENCY_DEPARTMENT_DISCHARGE",
    "EMERGENCY_DEPARTMENT_DIAGNOSIS",
    "HOSPITAL_ADMISSION",
    "ICU_ADMISSION",
    "OBSERVATION_MEDICAL_RECORD",
    "LABORATORY_RESULT",
    "HOSPITAL_MEDICATION",
    "HOSPITAL_PROCEDURE",
    "HOSPITAL_TRANSFER",
    "ICU_DISCHARGE",
    "HOSPITAL_DISCHARGE",
    "HOSPITAL_DIAGNOSIS",
    "DIAGNOSIS_RELATED_GROUPS",
    "HEALTHCARE_COMMON_PROCEDURE_CODING_SYSTEM",
    "DEATH",
]
SPLIT_FRACTIONS = {"train": 0.8, "tuning": 0.1, "held_out": 0.1}
SUBJECTS_PER_SHARD = 20_000

# Parameters of the text stages.
AGE_EVENTS = ["^EMERGENCY_DEPARTMENT_TRIAGE//AGE", "^HOSPITAL_ADMISSION//AGE"]
DESCRIBED_PREFIXES = [
    "EMERGENCY_DEPARTMENT_DIAGNOSIS",
    "HOSPITAL_DIAGNOSIS",
    "HOSPITAL_PROCEDURE",
    "DIAGNOSIS_RELATED_GROUPS",
]
TEXT_CLEANING = {
    "column": ["code", "prefix"],
    "to_titlecase": True,
    "patterns": [{"pattern": "_|//", "replacement": " "}, {"pattern": r"(\s){2,}", "replacement": " "}],
}


def apply_stages(df: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    return functools.reduce(DataFrame.transform, stages, df)


def clean_events(
    df: DataFrame,
    measured_prefixes: Sequence[str] = MEASURED_PREFIXES,
    dropped: Sequence = DROPPED_CODES,
    order_prefixes: Sequence[str] = ORDER_PREFIXES,
    tie_breakers: Sequence[str] = (),
    stored: bool = False,
) -> Timeline:
    """Drop measurements without a value, clean codes, drop unwanted groups, then order.

    `stored` says that `df` is a table as it lies on disk, or row-wise expressions over one. The sizes of the subjects are
    then counted from its key column alone and the cleaned rows go straight to the ordering; otherwise they are written
    once, as sizing and ordering would each run the whole extraction behind `df`.
    """
    stages: list[Stage] = [
        lambda d: t.filter_null_values(d, measured_prefixes),
        lambda d: t.clean_string_columns(d, **CODE_CLEANING, once=True),
        lambda d: t.drop_by_regex(d, dropped),
    ]
    cleaned = apply_stages(df, stages)
    cleaned = cleaned if stored else written(cleaned, "clean-events")
    layout = layout_of(df if stored else cleaned, ["subject_id"])
    return t.order_events(cleaned, order_prefixes, tie_breakers=tie_breakers, layout=layout)


def text_stages(
    age_events: Sequence = AGE_EVENTS,
    join_char: str = " ",
    described_prefixes: Sequence[str] = DESCRIBED_PREFIXES,
    cleaning: dict = TEXT_CLEANING,
) -> list[Stage]:
    """The row-wise stages that turn codes into phrases; `event_seq` must exist before, as `code` is rewritten."""
    return [
        lambda d: t.drop_by_regex(d, age_events),
        lambda d: t.append_values(d, join_char=join_char),
        t.create_prefix_column,
        lambda d: t.replace_code_with_text_value_by_prefix(d, described_prefixes),
        lambda d: t.clean_string_columns(d, **cleaning),
    ]


def text_events(
    events: Timeline,
    stages: Sequence[Stage] | None = None,
    birth_prefix: str = "Birth",
    time_format: str = "%H:%M",
) -> Timeline:
    """Phrases, ages and time of day for every event except births. The timeline's layout is kept throughout."""
    phrased = events.pipe(lambda df: apply_stages(df, text_stages() if stages is None else stages))
    aged = t.calculate_age(phrased, birth_prefix=birth_prefix, drop_birth_rows=True)
    return aged.pipe(lambda df: t.add_time_column(df, time_format, replace_end_of_day=True))


def text_dataset(
    events: Timeline,
    labels: DataFrame,
    stages: Sequence[Stage] | None = None,
    birth_prefix: str = "Birth",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Ordered events and labels to one text per label; subjects without labels are removed before any rendering."""
    wanted = events.pipe_whole(lambda df: labelled_subjects(df, labels))
    return narratives(text_events(wanted, stages, birth_prefix), labels, keep)
