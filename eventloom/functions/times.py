"""Date and time expressions. Timestamps are zone-free wall-clock values (`timestamp_ntz`)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

END_OF_DAY = "23:59:59.999999"

# strftime directives used by configured formats, with their Spark counterparts (fixed values).
DIRECTIVES = {
    "Y": "yyyy",
    "y": "yy",
    "m": "MM",
    "d": "dd",
    "H": "HH",
    "I": "hh",
    "M": "mm",
    "S": "ss",
    "f": "SSSSSS",
    "p": "a",
    "b": "MMM",
    "B": "MMMM",
    "a": "E",
    "A": "EEEE",
    "j": "DDD",
}


def spark_format(strftime: str) -> str:
    """Translate a strftime format to a Spark datetime pattern; literal letters are quoted."""
    out = []
    for directive, literal in re.findall(r"%(.)|([^%]+)", strftime):
        if directive == "%":
            out.append("%")
        elif directive == "F":
            out.append("yyyy-MM-dd")
        elif directive == "T":
            out.append("HH:mm:ss")
        elif directive:
            if directive not in DIRECTIVES:
                raise ValueError(f"unsupported time directive %{directive}")
            out.append(DIRECTIVES[directive])
        else:
            out.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m.group()}'", literal))
    return "".join(out)


def is_end_of_day(time: Column) -> Column:
    return F.date_format(time, "HH:mm:ss.SSSSSS") == END_OF_DAY


def end_of_day(date: Column) -> Column:
    """Date (or date text) to its last microsecond."""
    last = F.make_dt_interval(F.lit(0), F.lit(23), F.lit(59), F.lit(59.999999))
    return F.to_date(date).cast("timestamp_ntz") + last


def whole_days(start: Column, end: Column) -> Column:
    """Elapsed whole days, truncated toward zero."""
    return F.timestamp_diff("DAY", start, end)


def add_years(time: Column, years: Column) -> Column:
    """Calendar years later; 29 February falls back to the 28th."""
    return time + F.make_ym_interval(years, F.lit(0))


def complete_years(birth: Column, time: Column) -> Column:
    before_birthday = (F.month(time) < F.month(birth)) | (
        (F.month(time) == F.month(birth)) & (F.dayofmonth(time) < F.dayofmonth(birth))
    )
    return F.year(time) - F.year(birth) - F.when(before_birthday, 1).otherwise(0)


def parse_time(col: Column, formats: list[str], strict: bool = False) -> Column:
    """First format that fits; null (or an error when `strict`) if none does."""
    parsed = [F.try_to_timestamp(col, F.lit(spark_format(f))).cast("timestamp_ntz") for f in formats]
    if strict:
        parsed[-1] = F.to_timestamp(col, spark_format(formats[-1])).cast("timestamp_ntz")
    return F.coalesce(*parsed)
