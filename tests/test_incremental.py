"""Streamed daily sums, broken CSV lines, sinks that replace what they touch, limits that callers set."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from salesloom.operators import bundle as bundles
from salesloom.operators import kpi, retrieval
from salesloom.plans import prepare, report
from salesloom.sources import files
from salesloom.streaming import kpi_stream

SCHEMA = "key long, date timestamp, amount double, channel string"


def at(text):
    return datetime.datetime.fromisoformat(text)


def stored(spark, path):
    return {(r.channel, str(r.day)): (r.revenue, r.n_rows) for r in kpi_stream.read_days(spark, path).collect()}


def test_daily_stream(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "out")

    def load(*rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = kpi_stream.daily_stream(stream, table, str(tmp_path / "state"), ["key"], "3 days", ["channel"], once=True)
        query.awaitTermination()
        return query

    load((1, at("2024-01-30 10:00"), 1.5, "a"), (2, at("2024-01-30 23:59"), 2.25, "a"), (2, at("2024-01-30 23:59"), 2.25, "a"),
         (3, at("2024-02-01 00:00"), None, None), (4, None, 9.0, "a"), (5, at("2024-02-01 08:00"), 4.0, "b"))
    first = {("a", "2024-01-30"): (3.75, 2), (None, "2024-02-01"): (None, 1), ("b", "2024-02-01"): (4.0, 1)}
    assert stored(spark, table) == first
    january = {p.name for p in (tmp_path / "out" / "month=2024-01-01").glob("*.parquet")}
    # The next load repeats a key, adds to a day that is stored and to a new one, and touches February only.
    load((5, at("2024-02-01 08:00"), 4.0, "b"), (6, at("2024-02-01 09:00"), 1.0, "b"), (7, at("2024-02-09 09:00"), 7.0, "a"))
    second = {**first, ("b", "2024-02-01"): (5.0, 2), ("a", "2024-02-09"): (7.0, 1)}
    assert stored(spark, table) == second
    assert {p.name for p in (tmp_path / "out" / "month=2024-01-01").glob("*.parquet")} == january
    # A day that ended before the watermark is late: left out and counted.
    query = load((8, at("2024-01-30 09:00"), 100.0, "a"), (9, at("2024-02-08 09:00"), 3.0, "a"))
    assert stored(spark, table) == {**second, ("a", "2024-02-08"): (3.0, 1)}
    assert kpi_stream.late_rows(query) == 1
    days = kpi.series_from(kpi_stream.read_days(spark, table), "month").orderBy("period").collect()
    assert [(str(r.period), r.revenue) for r in days] == [("2024-01-31", 3.75), ("2024-02-29", 15.0)]


def test_broken_lines(spark, tmp_path):
    path, apart = tmp_path / "raw.csv", str(tmp_path / "broken")
    path.write_text('order_date,total_price,cost\n2024-01-01,5,1\n2024-01-02,6\n"2024-01-03","7, and ""more""",NA\n'
                    '2024-01-04,8,1,2,3\n2024-01-05,9,"open\n')
    clean, quality = prepare.load_and_clean(spark, str(path), broken_path=apart)
    assert sorted(r.amount for r in clean.collect()) == [5.0, 9.0]
    checks = quality.first().validation
    assert (checks.n_rows, checks.invalid_amounts, checks.invalid_costs) == (3, 1, 1)
    broken = spark.read.json(apart)
    assert {(r.record, r.n_fields, r.cause) for r in broken.collect()} == {
        ("2024-01-02,6", 2, "too few fields"), ("2024-01-04,8,1,2,3", 5, "too many fields")}
    assert broken.where(F.col("file").endswith("raw.csv")).count() == broken.count()
    rows, broken = files.read_checked(spark, str(path), ["a", "b", "c"])
    assert rows.where("a = 'order_date'").count() == 1
    assert {r.cause: r.n_rows for r in files.fault_counts(broken).collect()}["too few fields"] == 1


def test_sink_replaces_touched_months(spark, sales_frame, tmp_path):
    path = str(tmp_path / "clean")
    files.write_clean(sales_frame([("2024-01-05", 1.0), ("2024-01-06", 2.0), ("2024-02-01", 3.0)]), path, partition_by_month=True)
    files.write_clean(sales_frame([("2024-02-02", 4.0), ("2024-03-01", 5.0)]), path, partition_by_month=True, touched_only=True)
    assert sorted(r.amount for r in spark.read.parquet(path).collect()) == [1.0, 2.0, 4.0, 5.0]
    files.write_clean(sales_frame([("2024-02-02", 6.0)]), path, partition_by_month=True)
    assert [r.amount for r in spark.read.parquet(path).collect()] == [6.0]
    with pytest.raises(ValueError, match="touched_only"):
        files.write_clean(sales_frame([("2024-02-02", 6.0)]), path, touched_only=True)


def test_report_items(sales_frame):
    rows = [("2024-01-05", float(k), f"c{k}") for k in range(1, 7)]
    with bundles.build_metrics_bundle(sales_frame(rows, "date string, amount double, category string")) as found:
        for asked, shown in ((None, 3), (5, 5)):
            lines = report.report_section(found, "segments", **({} if asked is None else {"items": asked}))
            assert sum("c" in r.text and any(f"c{k}" in r.text for k in range(1, 7)) for r in lines.collect()) == shown
