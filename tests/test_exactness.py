"""Sums without noise, further date formats, keys of any type, embeddings computed once."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from salesloom.functions.parsing import parse_date
from salesloom.operators import documents, index, kpi
from salesloom.sources import index_table


def test_sums_do_not_depend_on_partitions(spark):
    rng = random.Random(7)
    values = [rng.randrange(1, 10 ** 11) / 10_000 for _ in range(20_000)]
    exact = sum(round(v * 10_000) for v in values) / 10_000
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    for parts in (1, 4, 200):
        assert rows.repartition(parts).agg(kpi.exact_sum(F.col("x"))).first()[0] == exact
    assert rows.where("x < 0").agg(kpi.exact_sum(F.col("x"))).first()[0] is None
    infinite = rows.limit(3).union(spark.createDataFrame([(float("inf"),)], "x double"))
    assert infinite.agg(kpi.exact_sum(F.col("x"))).first()[0] == float("inf")


def test_sums_of_fine_large_and_negative_values(spark):
    """What ten-thousandths in a long cannot hold is added as decimals, in the same sum."""
    values = ["0.0000001", "-1234.5678", "99999999999.25", "0.00005", "-0.0001", "1000000000000.5", "7"]
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    assert rows.repartition(3).agg(kpi.exact_sum(F.col("x"))).first()[0] == float(sum(map(Decimal, values)))
    assert rows.where("x IS NULL").agg(kpi.exact_sum(F.col("x"))).first()[0] is None


@pytest.mark.parametrize("fmt, texts", [
    ("%d %b %Y", ["03 Feb 2024", "31 DEC 1999", "30 Feb 2024", "3 Febr 2024"]),
    ("%B %d, %Y", ["February 03, 2024", "march 9, 2021", "Feb 3, 2024"]),
    ("%d/%m/%y", ["03/02/24", "01/01/69", "31/12/68", "1/1/2024"]),
    ("%Y-%m-%d %I:%M %p", ["2024-02-03 01:05 PM", "2024-02-03 12:00 am", "2024-02-03 13:00 PM"]),
    ("%Y-%m-%d %H:%M:%S.%f", ["2024-02-03 01:05:09.25", "2024-02-03 01:05:09.123456"]),
    ("%Y-%j", ["2024-366", "2023-365", "2024-5"]),
])
def test_date_formats_as_strptime(spark, fmt, texts):
    def expected(text):
        try:
            return dt.datetime.strptime(text, fmt)
        except ValueError:
            return None

    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    column = parse_date(F.col("t"), rows.schema["t"].dataType, fmt)
    got = {r.t: r.d for r in rows.select("t", column.alias("d")).collect()}
    assert got == {t: expected(t) for t in texts}


def test_day_366_needs_a_leap_year(spark):
    """``strptime`` would go on into the next year."""
    rows = spark.createDataFrame([("2023-366",)], "t string")
    assert rows.select(parse_date(F.col("t"), rows.schema["t"].dataType, "%Y-%j")).first()[0] is None


def test_documents_of_text_keys_and_without_a_key(spark, sales_frame):
    tx = sales_frame([("2024-01-01", 1.0, "ORD-0017"), ("2024-01-02", 2.0, "ORD-0018"),
                      ("2024-01-02", 2.0, "ORD-0018")], "date string, amount double, code string")
    found = documents.index_rows(tx, "code").collect()
    assert {r.id for r in found} == {"txn-ORD-0017", "txn-ORD-0018"}
    assert all(r.pos >= 0 and r.metadata.row_index == r.pos for r in found)
    unnamed = documents.index_rows(tx)
    assert unnamed.select("id").distinct().count() == 2
    assert index.latest_per_id(unnamed).count() == 2


def test_a_written_batch_is_embedded_once(spark, sales_frame, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def provider(texts: pd.Series) -> list[list[float]]:
        calls.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    tx = sales_frame([("2024-01-01", float(k), k) for k in range(40)], "date string, amount double, k long")
    index_table.write_index(documents.index_rows(tx.where("k < 30"), "k", provider), str(tmp_path), "i")
    index_table.write_index(documents.index_rows(tx.where("k >= 20"), "k", provider), str(tmp_path), "i")
    assert calls.value == 30 + 20
    assert index_table.read_index(spark, str(tmp_path), "i").count() == 40
