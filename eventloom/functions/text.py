"""String expressions shared by the operators. All of them are native column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "//"
MARK = "\x01"


# Every character with the Unicode property White_Space (fixed values).
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f"
    "\u205f\u3000"
)
SEPARATORS = "\x1c\x1d\x1e\x1f"


def unicode_regex(pattern: str) -> str:
    """Make \\s, \\d, \\w and \\b Unicode-aware where a pattern uses them, as configured patterns expect."""
    return f"(?U){pattern}" if re.search(r"\\[sSdDwWbB]|\\p\{|\[\[:", pattern) else pattern


def strip(col: Column) -> Column:
    """Remove leading and trailing whitespace of any kind (plain `trim` removes only blanks)."""
    return F.trim(col, F.lit(WHITESPACE))


def strip_text(col: Column) -> Column:
    """`strip` for free text, where information separators count as whitespace too."""
    return F.trim(col, F.lit(WHITESPACE + SEPARATORS))


def strip_text_end(col: Column) -> Column:
    return F.rtrim(col, F.lit(WHITESPACE + SEPARATORS))


def title_case(col: Column, boundary: str = "nonalnum") -> Column:
    """First letter of each word up, the rest down.

    `nonalnum` starts a word after anything that is not a letter or digit; `whitespace` only after blanks.
    """
    if boundary == "whitespace":
        return F.initcap(col)
    if boundary != "nonalnum":
        raise ValueError("boundary must be 'nonalnum' or 'whitespace'")
    # initcap starts words after blanks only: put a marked blank after every other separator and take it out again
    marked = F.regexp_replace(col, r"([^\p{L}\p{N} ])", f"$1{MARK} ")
    return F.replace(F.initcap(marked), F.lit(f"{MARK} "), F.lit(""))


def replace_all(col: Column, patterns: Iterable[tuple[str, str]]) -> Column:
    for pattern, replacement in patterns:
        col = F.regexp_replace(col, unicode_regex(pattern), replacement)
    return col


def first_part(code: Column) -> Column:
    """The category of a composite code: everything before the first separator."""
    return F.substring_index(code, SEPARATOR, 1)


def remaining_parts(code: Column) -> Column:
    """The code without its category; empty when there is no separator."""
    head = F.length(first_part(code)) + F.lit(1 + len(SEPARATOR))
    return F.substr(code, head)


def starts_with_any(col: Column, prefixes: Iterable[str]) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | col.startswith(prefix)
    return hit


def extract_or_null(col: Column, pattern: str, group: int = 1) -> Column:
    """`regexp_extract` gives '' both for an empty group and for no match; tell the two apart."""
    return F.when(col.rlike(pattern), F.regexp_extract(col, pattern, group))
