"""Text to date / number parsing with an explicit notion of what is valid.

Every helper returns a Column; a value that cannot be parsed becomes NULL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that a CSV reader treats as "no value".
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Plain decimal, optionally with exponent, or an infinity word; no digit grouping,
# no type suffix, no hex.
NUMBER_PATTERN = r"^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)$"

# strptime directive -> (Spark datetime letter, accepted text)
_DIRECTIVES = {
    "Y": ("y", r"\d{4}"),
    "m": ("M", r"\d{1,2}"),
    "d": ("d", r"\d{1,2}"),
    "H": ("H", r"\d{1,2}"),
    "M": ("m", r"\d{1,2}"),
    "S": ("s", r"\d{1,2}"),
    "I": ("h", r"(?:0?[1-9]|1[0-2])"),
    "p": ("a", r"(?i:am|pm)"),
    "f": ("SSSSSS", r"\d{1,6}"),
    "j": ("D", r"\d{1,3}"),
    "y": ("yy", r"\d{2}"),
    "b": ("MMM", r"[A-Za-z]{3}"),
    "B": ("MMMM", r"[A-Za-z]+"),
}
# Two-digit years from 69 on belong to the last century; the JVM puts all into this one.
_LAST_CENTURY = 2069


def na_to_null(col: Column) -> Column:
    """NULL for the usual missing-value tokens, the text itself otherwise."""
    return F.when(~col.isin(*NA_TOKENS), col)


def parse_number(col: Column, dtype: T.DataType) -> Column:
    """Double value of ``col``; text is accepted only when it is a plain number."""
    if not isinstance(dtype, T.StringType):
        value = col.cast("double")
        return F.when(~F.isnan(value), value)
    text = F.lower(F.btrim(col, F.lit(" \t\n\r\f\x0b")))
    # No match extracts "", which casts to NULL; text is parsed where it is matched.
    value = F.regexp_extract(text, NUMBER_PATTERN, 0).try_cast("double")
    overflow = F.abs(value) == F.lit(float("inf"))
    return F.when(~overflow | text.contains("inf"), value)


def date_format_parts(date_format: str) -> tuple[str, str]:
    """(Spark pattern, guard regex) of a strptime format such as ``%Y-%m-%d``."""
    pattern, guard = "", "^"
    for directive, literal in re.findall(r"%(.)|([^%]+)", date_format):
        if literal:
            pattern += re.sub(r"([A-Za-z]+)", r"'\1'", literal)
            guard += re.escape(literal)
        elif directive in _DIRECTIVES:
            letter, accepted = _DIRECTIVES[directive]
            pattern += letter
            guard += accepted
        else:
            raise ValueError(f"Unsupported date directive '%{directive}'.")
    return pattern, guard + "$"


def parse_date(col: Column, dtype: T.DataType, date_format: str | None) -> Column:
    """Timestamp (without time zone) of ``col``.

    With a format, text must match it as a whole: unpadded month and day are
    accepted, impossible days (such as day 366 of a common year) and trailing text are not.
    """
    if not isinstance(dtype, T.StringType):
        return col.cast("timestamp_ntz")
    if not date_format:
        return col.try_cast("timestamp_ntz")
    pattern, guard = date_format_parts(date_format)
    has_time = any(f"%{c}" in date_format for c in "HMSIpf")
    text = F.regexp_extract(col, guard, 0)
    parsed = (F.try_to_timestamp(text, F.lit(pattern)) if has_time
              else F.try_to_date(text, pattern))
    found = parsed.cast("timestamp_ntz")
    if "%y" in date_format:
        century = F.expr("interval 100 years")
        found = F.when(F.year(found) >= _LAST_CENTURY, found - century).otherwise(found)
    return found
