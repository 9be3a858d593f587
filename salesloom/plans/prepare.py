"""From a raw file to clean transactions and a quality report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..operators.cleaning import (DEFAULT_COLUMNS, DEFAULT_DATE_FORMAT, clean_transactions,
                                  quality_report)
from ..sources.files import read_checked, read_transactions, write_broken, write_clean


def load_and_clean(spark: SparkSession, path: str,
                   columns: Mapping[str, str | None] = DEFAULT_COLUMNS,
                   date_format: str | None = DEFAULT_DATE_FORMAT, parse_dates: bool = True,
                   save_path: str | None = None, save_format: str = "parquet",
                   broken_path: str | None = None
                   ) -> tuple[DataFrame, DataFrame]:
    """(clean transactions, one-row report), both lazy.

    With ``save_path`` the clean rows are written once and read back from there, so that
    everything after it reads typed columns and not the raw text. (CSV keeps no types:
    what was saved as CSV is not read back.) With ``broken_path``, CSV lines with too few or too
    many fields are written there and are no rows; without it they are padded or cut.
    """
    if broken_path:
        raw, broken = read_checked(spark, path)
        write_broken(broken, broken_path)
    else:
        raw = read_transactions(spark, path)
    clean = clean_transactions(raw, columns, date_format, parse_dates)
    if save_path:
        write_clean(clean, save_path, save_format)
        if save_format == "parquet":
            clean = spark.read.parquet(save_path)
    return clean, quality_report(raw, columns, date_format, parse_dates)
