from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from salesloom.operators import bundle as bundles
from salesloom.operators import kpi

PANDAS_FREQ = {"day": "D", "week": "W", "month": "ME"}


def series(tx, granularity):
    return {str(r.period): r.revenue for r in kpi.revenue_time_series(tx, granularity).collect()}


def test_gaps_are_filled(sales_frame):
    tx = sales_frame([("2024-03-10 23:00:00", 1.0), ("2024-03-11", 2.0),
                      ("2024-03-31 12:00:00", 4.0), ("2024-05-01", 8.0)])
    assert series(tx, "month") == {"2024-03-31": 7.0, "2024-04-30": 0.0, "2024-05-31": 8.0}
    weeks = series(tx, "week")
    assert len(weeks) == 9 and weeks["2024-03-10"] == 1.0 and weeks["2024-03-17"] == 2.0
    days = series(tx, "day")
    assert len(days) == 53 and sum(days.values()) == 15.0
    with pytest.raises(ValueError, match="hour"):
        kpi.revenue_time_series(tx, "hour")


def test_trend_skips_months_without_revenue(sales_frame):
    tx = sales_frame([("2024-01-05", 10.0), ("2024-02-05", 5.0), ("2024-02-06", -5.0),
                      ("2024-04-02", 15.0)])
    row = kpi.monthly_trend(tx).first()
    assert (str(row.current_period), str(row.previous_period)) == ("2024-04-30", "2024-01-31")
    assert (row.direction, row.absolute_change, row.percent_change) == ("up", 5.0, 50.0)


def test_trend_needs_two_months(sales_frame):
    row = kpi.monthly_trend(sales_frame([("2024-01-05", 10.0)])).first()
    assert row.asDict() == {
        "has_enough_data": False, "direction": "insufficient_data", "current_period": None,
        "current_revenue": None, "previous_period": None, "previous_revenue": None,
        "absolute_change": None, "percent_change": None}


@pytest.mark.parametrize("amount", [10.0, 0.1, 10.3, 1234567.89])
def test_constant_days_are_normal(sales_frame, amount):
    tx = sales_frame([(f"2024-01-{d:02d}", amount) for d in range(1, 30)])
    row = kpi.revenue_anomaly_last_day(tx).first()
    assert (row.has_enough_history, row.status, row.z_score) == (True, "normal", None)
    assert (row.history_mean, row.history_std) == (pytest.approx(amount), 0.0)


@pytest.mark.parametrize("days, enough", [(5, False), (6, True)])
def test_history_of_five_days(sales_frame, days, enough):
    tx = sales_frame([(f"2024-01-{d:02d}", float(d)) for d in range(1, days + 1)])
    row = kpi.revenue_anomaly_last_day(tx).first()
    assert row.has_enough_history == enough
    assert row.current_revenue == float(days) and row.current_date is not None
    if enough:
        assert row.z_score == pytest.approx((6 - 3) / np.std([1, 2, 3, 4, 5]))
        assert row.status == "high"
    else:
        assert row.status == "insufficient_history" and row.history_mean is None


def test_null_keys_do_not_share(sales_frame):
    tx = sales_frame([("2024-01-01", 1.0, "a"), ("2024-01-02", 5.0, None),
                      ("2024-01-03", 1.0, "b"), ("2024-01-04", 2.0, "b")],
                     "date string, amount double, category string")
    rows = [(r["rank"], r.segment_value, r.revenue, r.order_count, r.revenue_share_pct)
            for r in kpi.segment_revenue(tx, "category").orderBy("rank").collect()]
    assert rows == [(1, "b", 3.0, 2, 75.0), (2, "a", 1.0, 1, 25.0)]
    every = kpi.segment_revenue(tx, "category", None).collect()
    assert {(r.segment_value, r.revenue_share_pct) for r in every} == {("b", 75.0), ("a", 25.0)}
    with pytest.raises(ValueError, match="product"):
        kpi.segment_revenue(tx, "product")


def test_negative_revenue_has_no_margin(sales_frame):
    tx = sales_frame([("2024-01-01", -3.0, 1.0, "a"), ("2024-01-02", 1.0, 1.0, "b")],
                     "date string, amount double, cost double, category string")
    row = kpi.overall_metrics(tx).first()
    assert (row.total_revenue, row.gross_profit, row.gross_margin_pct) == (-2.0, -4.0, None)
    found = kpi.segment_revenue(tx, "category").orderBy("rank").collect()
    assert [r.revenue_share_pct for r in found] == [0.0, 0.0]
    assert [r.gross_margin_pct for r in found] == [0.0, None]


def test_empty_input(sales_frame):
    tx = sales_frame([], "date string, amount double, category string")
    row = kpi.overall_metrics(tx).first()
    assert (row.total_revenue, row.n_transactions, row.avg_order_value) == (0.0, 0, None)
    assert kpi.revenue_time_series(tx, "day").count() == 0
    assert kpi.segment_revenue(tx, "category").count() == 0
    assert kpi.monthly_trend(tx).first().direction == "insufficient_data"
    found = kpi.revenue_anomaly_last_day(tx).first()
    assert (found.status, found.current_date) == ("insufficient_history", None)


def random_frame(seed: int) -> pd.DataFrame:
    rng = random.Random(seed)
    n = rng.choice([3, 40, 400])
    days = rng.choice([4, 60, 500])
    start = pd.Timestamp("2023-11-20")
    return pd.DataFrame({
        "date": [start + pd.Timedelta(minutes=rng.randrange(days * 1440)) for _ in range(n)],
        "amount": [round(rng.uniform(-20, 200), 2) for _ in range(n)],
        "cost": [round(rng.uniform(0, 100), 2) if rng.random() < 0.9 else None
                 for _ in range(n)],
        "category": [rng.choice(["a", "b", "c", None]) for _ in range(n)],
        "channel": [rng.choice(["web", "shop"]) for _ in range(n)],
    })


def close(a, b) -> bool:
    if a is None or b is None or a != a or b != b:
        return (a is None or a != a) and (b is None or b != b)
    return a == pytest.approx(b, rel=1e-9, abs=1e-7)


@pytest.mark.parametrize("seed", range(6))
def test_against_pandas(spark, seed):
    frame = random_frame(seed)
    tx = spark.createDataFrame(frame).withColumn(
        "date", F.col("date").cast("timestamp_ntz"))
    tx = tx.na.drop(subset=["amount"])
    indexed = frame.set_index("date").sort_index()
    for granularity, freq in PANDAS_FREQ.items():
        expected = indexed[["amount", "cost"]].resample(freq).sum()
        found = kpi.revenue_time_series(tx, granularity).orderBy("period").toPandas()
        assert [str(p) for p in found.period] == [str(p.date()) for p in expected.index]
        assert np.allclose(found.revenue, expected.amount, atol=1e-7)
        assert np.allclose(found.cost, expected.cost, atol=1e-7)
    daily = indexed.amount.resample("D").sum()
    last, history = daily.iloc[-1], daily.iloc[:-1].tail(30)
    row = kpi.revenue_anomaly_last_day(tx).first()
    assert close(row.current_revenue, last) and row.has_enough_history == (len(history) >= 5)
    if len(history) >= 5:
        assert close(row.history_mean, history.mean())
        assert close(row.history_std, history.std(ddof=0))
        std = history.std(ddof=0)
        assert close(row.z_score, (last - history.mean()) / std if std > 0 else None)
    groups = frame.groupby("category").agg(revenue=("amount", "sum"), n=("amount", "count"))
    share = groups.revenue / groups.revenue.sum() * 100
    for r in kpi.segment_revenue(tx, "category", 2).collect():
        assert close(r.revenue, groups.revenue[r.segment_value])
        assert r.order_count == groups.n[r.segment_value]
        assert close(r.revenue_share_pct, share[r.segment_value]
                     if groups.revenue.sum() > 0 else 0.0)


def test_ranking_is_exact_for_any_bucket_count(spark):
    rows = [(f"k{i}", float((i * 37) % 101)) for i in range(300)]
    values = spark.createDataFrame(rows, "segment_value string, revenue double").selectExpr(
        "'product' AS segment_type", "segment_value", "revenue", "1L AS order_count")
    expected = sorted(rows, key=lambda r: (-r[1], r[0]))[:7]
    total = sum(r[1] for r in rows)
    for buckets in (1, 3, 64):
        found = kpi.rank_segments(values, 7, buckets=buckets).orderBy("rank").collect()
        assert [(r.segment_value, r.revenue) for r in found] == expected
        assert all(close(r.revenue_share_pct, r.revenue / total * 100) for r in found)


def rows_of(df, order):
    return [tuple(round(v, 6) if isinstance(v, float) else v for v in r)
            for r in (df.orderBy(*order) if order else df).collect()]


@pytest.mark.parametrize("by", [(), ("channel",)])
def test_bundle_equals_the_single_operators(spark, by):
    tx = spark.createDataFrame(random_frame(11)).withColumn(
        "date", F.col("date").cast("timestamp_ntz"))
    with bundles.build_metrics_bundle(tx, by=by) as found:
        assert rows_of(found.overall, by) == rows_of(kpi.overall_metrics(tx, by), by)
        order = [*by, "period"]
        assert rows_of(found.time_series, order) == rows_of(
            kpi.revenue_time_series(tx, "month", by), order)
        assert rows_of(found.monthly_trend, by) == rows_of(kpi.monthly_trend(tx, by), by)
        assert rows_of(found.anomaly, by) == rows_of(kpi.revenue_anomaly_last_day(tx, by=by), by)
        order = [*by, "segment_type", "rank"]
        assert rows_of(found.segments.where("segment_type = 'category'"), order) == rows_of(
            kpi.segment_revenue(tx, "category", 5, by), order)
        assert found.segment_types == (("category",) if by else ("category", "channel"))


def test_groups_are_independent(spark):
    frame = random_frame(5)
    tx = spark.createDataFrame(frame).withColumn(
        "date", F.col("date").cast("timestamp_ntz"))
    grouped = {r.channel: r for r in kpi.monthly_trend(tx, ["channel"]).collect()}
    for channel in grouped:
        alone = kpi.monthly_trend(tx.where(tx.channel == channel)).first()
        assert close(alone.current_revenue, grouped[channel].current_revenue)
        assert alone.direction == grouped[channel].direction


def test_null_group_is_kept(sales_frame):
    tx = sales_frame([("2024-01-01", 1.0, None), ("2024-02-02", 2.0, None),
                      ("2024-01-03", 3.0, "x")], "date string, amount double, region string")
    with bundles.build_metrics_bundle(tx, by=["region"]) as found:
        rows = {r.region: r for r in bundles.digest(found).collect()}
    assert rows[None].overall.total_revenue == 3.0 and rows[None].trend.direction == "up"
    assert rows["x"].trend.direction == "insufficient_data"
    assert len(rows[None].recent) == 2 and len(rows["x"].recent) == 1


@pytest.mark.parametrize("seed", range(6))
def test_every_day_against_pandas(spark, seed):
    frame = random_frame(seed).dropna(subset=["amount"])
    tx = spark.createDataFrame(frame).withColumn("date", F.col("date").cast("timestamp_ntz"))
    daily = frame.set_index("date").sort_index().amount.resample("D").sum()
    found = kpi.revenue_anomalies(tx, lookback_days=7).orderBy("current_date").collect()
    assert [str(r.current_date) for r in found] == [str(d.date()) for d in daily.index]
    for at, row in enumerate(found):
        history = daily.iloc[max(0, at - 7):at]
        assert close(row.current_revenue, daily.iloc[at])
        assert row.has_enough_history == (len(history) >= 5)
        if len(history) < 5:
            assert (row.status, row.history_mean, row.z_score) == ("insufficient_history", None, None)
            continue
        assert close(row.history_mean, history.mean())
        assert close(row.history_std, history.std(ddof=0))
        if history.std(ddof=0) > 1e-6:
            z = (daily.iloc[at] - history.mean()) / history.std(ddof=0)
            assert close(row.z_score, z)
            assert row.status == ("high" if z > 2 else "low" if z < -2 else "normal")
    sold = {str(d.date()) for d in frame.date}
    few = kpi.revenue_anomalies(tx, lookback_days=7, empty_days=False)
    assert rows_of(few, ["current_date"]) == [
        r for r, raw in zip(rows_of(kpi.revenue_anomalies(tx, lookback_days=7), ["current_date"]), found)
        if str(raw.current_date) in sold]
    last = kpi.revenue_anomaly_last_day(tx, lookback_days=7).first()
    assert all(close(a, b) if isinstance(a, float) else a == b for a, b in zip(last, found[-1]))


def test_every_day_of_groups_and_of_nothing(spark, sales_frame):
    tx = spark.createDataFrame(random_frame(5)).withColumn("date", F.col("date").cast("timestamp_ntz"))
    every = rows_of(kpi.revenue_anomalies(tx, by=["channel"]), ["channel", "current_date"])
    for channel in ("web", "shop"):
        alone = rows_of(kpi.revenue_anomalies(tx.where(tx.channel == channel)), ["current_date"])
        assert [r[1:] for r in every if r[0] == channel] == alone
    assert kpi.revenue_anomalies(sales_frame([])).count() == 0
    constant = sales_frame([(f"2024-01-{d:02d}", 0.1) for d in range(1, 30)])
    assert {r.status for r in kpi.revenue_anomalies(constant).collect()} == {"insufficient_history", "normal"}
    assert all(r.z_score is None for r in kpi.revenue_anomalies(constant).collect())
