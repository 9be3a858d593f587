"""Run registered queries next to their SQL twins and report differences.

    python -m checks.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks.oracle import ORACLE_SQL
from checks.queries import QUERIES


def duck_tables(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def canonical(names: list[str], rows: list[tuple]) -> list[tuple]:
    """Rows with columns in name order, sorted by their text."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows),
                  key=lambda row: tuple(map(repr, row)))


def differences(spark: SparkSession, connection: duckdb.DuckDBPyConnection, folder: str,
                name: str, inspect: Callable[[DataFrame], None] | None = None
                ) -> tuple[list[str], int]:
    """(findings, rows of the Spark result). ``inspect`` sees the query before it runs."""
    df = QUERIES[name](spark, folder)
    if inspect:
        inspect(df)
    ours = canonical(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    theirs = canonical(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return [f"columns differ: {sorted(df.columns)} / {sorted(columns)}"], len(ours)
    found = []
    if len(ours) != len(theirs):
        found.append(f"{len(ours)} rows instead of {len(theirs)}")
    found += [f"{a}\n    {b}" for a, b in zip(ours, theirs) if a != b][:3]
    return found, len(ours)


def main(folder: str, names: list[str]) -> int:
    from salesloom.session import build_session

    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    connection, failed = duck_tables(folder), 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            found, rows = differences(spark, connection, folder, name)
        except Exception as error:  # report and go on with the next query
            found, rows = [f"{type(error).__name__}: {str(error)[:600]}"], 0
        spark.catalog.clearCache()
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name}: {rows} rows, "
              f"{time.time() - start:.1f} s", flush=True)
        for text in found:
            print("    " + text, flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
