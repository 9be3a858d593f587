"""Reading raw transaction files and writing results."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import na_to_null

_RECORD = "_broken_record"


def read_transactions(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Raw transactions from CSV (all text, missing-value tokens as NULL) or Parquet.

    Nothing is inferred, so ids keep their leading zeros and one pass over the file is
    enough. ``multiline`` admits line breaks inside quoted fields, at the price that a
    file can then no longer be split among tasks.
    """
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    try:
        if suffix == ".csv":
            raw = (spark.read.option("header", True).option("escape", '"')
                   .option("multiLine", multiline).csv(path))
            return raw.select(*[na_to_null(F.col(f"`{c}`")).alias(c) for c in raw.columns])
        if suffix == ".parquet":
            return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"Input data not found: {path}") from error
        raise
    raise ValueError(f"Unsupported file type '{suffix}'; use .csv or .parquet.")


def read_checked(spark: SparkSession, path: str, names: Sequence[str] | None = None
                 ) -> tuple[DataFrame, DataFrame]:
    """(rows, broken) of CSV files: lines with as many fields as there are columns, and the others.

    ``names`` are the columns of files without a header line. ``broken`` holds ``record`` (the
    line), ``n_fields``, ``cause`` and ``file``. Both come from the same parse; a file is split
    among tasks, so a line break inside quotes ends a record. A quote that is not closed is text
    of its field, and ends at the next comma.
    """
    reader = spark.read.option("header", names is None).option("escape", '"')
    columns = list(names) if names is not None else reader.csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, _RECORD]])
    # A parser that skips columns does not see how many fields a line has.
    raw = (reader.schema(schema).option("mode", "PERMISSIVE").option("columnPruning", False)
           .option("columnNameOfCorruptRecord", _RECORD).csv(path))
    rows = raw.where(F.col(_RECORD).isNull()).select(
        *[na_to_null(F.col(f"`{c}`")).alias(c) for c in columns])
    # The scan must not be asked for the record alone, so another column takes part.
    record = F.coalesce(F.col(_RECORD), F.col(f"`{columns[0]}`"))
    broken = raw.where(F.coalesce(F.col(_RECORD), F.lit("")) != "").select(
        record.alias("record"), F.input_file_name().alias("file"))
    bare = F.regexp_replace("record", r'"(?:[^"]|"")*+"', "")
    n_fields = F.size(F.split(bare, ",")).cast("bigint")
    cause = (F.when(n_fields < len(columns), "too few fields")
             .when(n_fields > len(columns), "too many fields").otherwise("not readable"))
    return rows, broken.select("record", n_fields.alias("n_fields"), cause.alias("cause"), "file")


def fault_counts(broken: DataFrame) -> DataFrame:
    """Broken lines per cause."""
    return broken.groupBy("cause").agg(F.count(F.lit(1)).alias("n_rows"))


def write_broken(broken: DataFrame, path: str) -> None:
    """Broken lines as JSON lines, to be mended and read again."""
    broken.write.mode("overwrite").json(path)


def write_clean(clean: DataFrame, path: str, fmt: str = "parquet",
                partition_by_month: bool = False, touched_only: bool = False) -> None:
    """Clean transactions as a Parquet or CSV folder.

    With ``partition_by_month`` rows are brought together per month before the write; a heavy
    month is split among as many tasks as its size asks for. ``touched_only`` then replaces the
    months of these rows and leaves all others as they are.
    """
    if touched_only and not partition_by_month:
        raise ValueError("touched_only needs partition_by_month.")
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"Unsupported output format '{fmt}'; use parquet or csv.")
    writer_input = clean
    if partition_by_month:
        writer_input = (clean.withColumn("month", F.date_format("date", "yyyy-MM"))
                        .hint("rebalance", F.col("month")))
    writer = writer_input.write.mode("overwrite")
    if partition_by_month:
        mode = "dynamic" if touched_only else "static"
        writer = writer.option("partitionOverwriteMode", mode).partitionBy("month")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Long metric table as JSON lines."""
    metrics.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_report(lines: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Report rows ``(by, line_no, text)`` as text: one file, or one folder per group."""
    grouped = lines.repartition(*by) if by else lines.repartition(1)
    writer = (grouped.sortWithinPartitions(*by, "line_no").select(*by, "text")
              .write.mode("overwrite"))
    (writer.partitionBy(*by) if by else writer).text(path)


def preview(clean: DataFrame, rows: int = 5) -> DataFrame:
    """A few rows to look at; which ones is not defined."""
    return clean.limit(rows)
