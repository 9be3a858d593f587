"""Validation and cleaning of raw transaction tables.

All results are lazy. Validity counts and the cleaning summary are plain aggregates
over the parsed columns, so each is one pass with map-side partial aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formatting import iso_timestamp
from ..functions.parsing import parse_date, parse_number

REQUIRED = ("date", "amount")
PARSED = ("date", "amount", "cost")
FIELDS = ("date", "amount", "cost", "category", "product", "customer_id", "channel")

# Raw column names assumed when no mapping is given.
DEFAULT_COLUMNS = {
    "date": "order_date",
    "amount": "total_price",
    "cost": "cost",
    "category": "category",
    "product": "product_name",
    "customer_id": "customer_id",
    "channel": "sales_channel",
}
DEFAULT_DATE_FORMAT = "%Y-%m-%d"


def present_columns(raw: DataFrame, columns: Mapping[str, str | None]) -> dict[str, str]:
    """Logical name -> raw column, for the mapped columns that exist.

    Raises ``ValueError`` naming the required columns that are missing.
    """
    missing = [str(columns.get(f)) for f in REQUIRED if columns.get(f) not in raw.columns]
    if missing:
        raise ValueError("Required columns are missing from the input: " + ", ".join(missing))
    return {f: columns[f] for f in FIELDS if columns.get(f) in raw.columns}


def _parsed(raw: DataFrame, name: str, field: str, date_format: str | None,
            parse_dates: bool = True) -> Column:
    col, dtype = F.col(f"`{name}`"), raw.schema[name].dataType
    if field == "date":
        return parse_date(col, dtype, date_format) if parse_dates else col
    if field in ("amount", "cost"):
        return parse_number(col, dtype)
    return col


def _count(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


def _validation_columns(raw: DataFrame, columns: Mapping[str, str | None],
                        date_format: str | None) -> list[Column]:
    found = present_columns(raw, columns)

    def invalid(field: str) -> Column:
        if field not in found:
            return F.lit(0).cast("bigint")
        before = F.col(f"`{found[field]}`")
        return _count(before.isNotNull()
                      & _parsed(raw, found[field], field, date_format).isNull())

    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(raw.columns)).cast("bigint").alias("n_columns"),
        F.array().cast("array<string>").alias("missing_required_columns"),
        invalid("date").alias("invalid_dates"),
        invalid("amount").alias("invalid_amounts"),
        invalid("cost").alias("invalid_costs"),
    ]


def _summary_columns(raw: DataFrame, columns: Mapping[str, str | None],
                     date_format: str | None, parse_dates: bool) -> list[Column]:
    found = present_columns(raw, columns)
    date, amount = (_parsed(raw, found[f], f, date_format, parse_dates) for f in REQUIRED)
    kept = date.isNotNull() & amount.isNotNull()
    return [
        F.count(F.lit(1)).alias("original_rows"),
        _count(kept).alias("clean_rows"),
        _count(~kept).alias("dropped_rows"),
        iso_timestamp(F.min(F.when(kept, date))).alias("date_min"),
        iso_timestamp(F.max(F.when(kept, date))).alias("date_max"),
    ]


def validation_report(raw: DataFrame, columns: Mapping[str, str | None] = DEFAULT_COLUMNS,
                      date_format: str | None = DEFAULT_DATE_FORMAT) -> DataFrame:
    """One row: table shape and the number of values that do not parse.

    A value that was missing already does not count as invalid.
    """
    return raw.agg(*_validation_columns(raw, columns, date_format))


def cleaning_summary(raw: DataFrame, columns: Mapping[str, str | None] = DEFAULT_COLUMNS,
                     date_format: str | None = DEFAULT_DATE_FORMAT,
                     parse_dates: bool = True) -> DataFrame:
    """One row: rows in, rows kept, rows dropped, first and last kept date (ISO text)."""
    return raw.agg(*_summary_columns(raw, columns, date_format, parse_dates))


def quality_report(raw: DataFrame, columns: Mapping[str, str | None] = DEFAULT_COLUMNS,
                   date_format: str | None = DEFAULT_DATE_FORMAT,
                   parse_dates: bool = True) -> DataFrame:
    """Validation report and cleaning summary as structs of one row, in one pass."""
    checks = _validation_columns(raw, columns, date_format)
    kept = _summary_columns(raw, columns, date_format, parse_dates)
    row = raw.agg(*checks, *kept)
    return row.select(F.struct(*row.columns[:len(checks)]).alias("validation"),
                      F.struct(*row.columns[len(checks):]).alias("cleaning"))


def rename_and_parse(raw: DataFrame, columns: Mapping[str, str | None] = DEFAULT_COLUMNS,
                     date_format: str | None = DEFAULT_DATE_FORMAT,
                     parse_dates: bool = True) -> DataFrame:
    """Logical names and types for the mapped columns; other columns pass through."""
    found = present_columns(raw, columns)
    field_of = {name: field for field, name in found.items()}
    return raw.select(*[
        _parsed(raw, c, field_of[c], date_format, parse_dates).alias(field_of[c])
        if c in field_of else F.col(f"`{c}`")
        for c in raw.columns
    ])


def clean_transactions(raw: DataFrame, columns: Mapping[str, str | None] = DEFAULT_COLUMNS,
                       date_format: str | None = DEFAULT_DATE_FORMAT,
                       parse_dates: bool = True) -> DataFrame:
    """Rows with a usable date and amount; an unusable cost only becomes NULL.

    Parsed values come from a generator of one row, below which no filter is pushed: each is
    parsed once per row.
    """
    found = present_columns(raw, columns)
    field_of = {name: field for field, name in found.items()}
    parsed = [f for f in PARSED if f in found]
    others = [F.col(f"`{c}`").alias(field_of.get(c, c)) for c in raw.columns
              if field_of.get(c) not in parsed]
    values = F.struct(*[_parsed(raw, found[f], f, date_format, parse_dates).alias(f)
                        for f in parsed])
    rows = raw.select(*others, F.inline(F.array(values)))
    kept = rows.where(F.col("date").isNotNull() & F.col("amount").isNotNull())
    return kept.select(*[F.col(f"`{field_of.get(c, c)}`") for c in raw.columns])
