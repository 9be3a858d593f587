"""Number, date and text formatting as Column expressions (no UDFs)."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_AVAILABLE = "N/A"


def grouped_number(col: Column, decimals: int = 2) -> Column:
    """``1,234.50``; half-even on the exact binary value; NULL stays NULL."""
    return F.format_number(col, decimals)


def number(col: Column, decimals: int = 2) -> Column:
    return F.coalesce(grouped_number(col, decimals), F.lit(NOT_AVAILABLE))


def fixed(col: Column, decimals: int) -> Column:
    """``1234.50``: no digit grouping; NULL stays NULL."""
    pattern = "0" + ("." + "0" * decimals if decimals else "")
    return F.call_function("format_number", col, F.lit(pattern))


def percent(col: Column, decimals: int = 2) -> Column:
    return F.coalesce(F.concat(fixed(col, decimals), F.lit("%")), F.lit(NOT_AVAILABLE))


def currency(col: Column) -> Column:
    """Rupiah without decimals, digits grouped by dots: ``Rp1.234.567``."""
    # To four decimals first: the last bits of a sum must not decide a tie.
    text = F.translate(F.format_number(F.round(col, 4), 0), ",", ".")
    return F.coalesce(F.concat(F.lit("Rp"), text), F.lit(NOT_AVAILABLE))


def title_label(name: str) -> str:
    """``customer_id`` -> ``Customer Id``."""
    return name.replace("_", " ").title()


def date_text(col: Column) -> Column:
    """Calendar day of a date or timestamp, ``2024-03-31``."""
    return F.to_date(col).cast("string")


def timestamp_text(col: Column, separator: str = " ") -> Column:
    """``2024-03-31 12:00:00``; microseconds (six digits) only when not zero."""
    text = col.cast("timestamp_ntz").cast("string")
    text = F.when(F.length(text) > 19, F.rpad(text, 26, "0")).otherwise(text)
    return text if separator == " " else F.replace(text, F.lit(" "), F.lit(separator))


def iso_timestamp(col: Column) -> Column:
    return timestamp_text(col, "T")


def float_text(col: Column) -> Column:
    """Shortest round-trip text of a double: ``12000000.5``, ``100.0``, ``1e+16``."""
    java = col.cast("string")
    size = F.abs(col)
    one_zero = r"(\.\d+?)0+$"
    wide = F.regexp_replace(java.try_cast("decimal(38,18)").cast("string"), one_zero, "$1")
    small = F.regexp_replace(java.try_cast("decimal(38,21)").cast("string"), one_zero, "$1")
    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", "")
    exponent = F.substring_index(java, "E", -1).try_cast("int")
    digits = F.abs(exponent).cast("string")
    science = F.concat(
        mantissa, F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits),
    )
    return (
        F.when(F.isnan(col), F.lit("nan"))
        .when(col == float("inf"), F.lit("inf"))
        .when(col == float("-inf"), F.lit("-inf"))
        .when((size == 0) | ((size >= 1e-3) & (size < 1e7)), java)
        .when((size >= 1e7) & (size < 1e16), wide)
        .when((size >= 1e-4) & (size < 1e-3), small)
        .otherwise(science)
    )


def quoted(col: Column) -> Column:
    """Text in quotes, as a Python literal would show it."""
    body = col
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    double = F.concat(F.lit('"'), body, F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(col.contains("'") & ~col.contains('"'), double).otherwise(single)


def cut(col: Column, max_chars: int, marker: str = "", strip: bool = False) -> Column:
    """First ``max_chars`` characters, then ``marker``, when the text is longer."""
    head = F.substring(col, 1, max_chars)
    if strip:
        head = F.regexp_replace(head, r"\s+$", "")
    return F.when(F.length(col) > max_chars, F.concat(head, F.lit(marker))).otherwise(col)


def fill(template: str, **values: Column) -> Column:
    """Replace ``{name}`` placeholders by columns.

    The template is split once while the plan is built. A template that does not fit
    the given names is returned as it is.
    """
    try:
        pieces = list(Formatter().parse(template))
    except ValueError:
        return F.lit(template)
    names = [name for _, name, _, _ in pieces if name is not None]
    if not values or any(name not in values for name in names):
        return F.lit(template)
    parts: list[Column] = []
    for literal, name, _, _ in pieces:
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(values[name].cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def language_code(language: str | None) -> str:
    """The two supported report languages: anything like ``id*`` is ``id``, else ``en``."""
    return "id" if str(language or "").strip().lower().startswith("id") else "en"


def language_column(col: Column) -> Column:
    """Row-wise form of :func:`language_code`."""
    return F.when(F.lower(F.trim(col)).startswith("id"), F.lit("id")).otherwise(F.lit("en"))
