"""Properties of physical plans that decide how a query behaves on a large cluster."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from salesloom.operators import bundle as bundles
from salesloom.operators import cleaning, documents, index, kpi, similarity
from salesloom.plans import context, report
from salesloom.sources import tables
from tests.conftest import SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_projection_and_filter_reach_the_scan(spark):
    tx = tables.purchases(spark, SMALL)
    text = plan(kpi.overall_metrics(tx))
    assert "EqualTo(event_type,purchase)" in text
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>", text)
    trend = plan(kpi.monthly_trend(tables.sales(spark, SMALL)))
    assert "p_name" not in trend and "l_quantity" not in trend and "p_retailprice" not in trend


def test_bundle_reads_its_source_once(spark):
    with bundles.build_metrics_bundle(tables.sales(spark, SMALL)) as found:
        base = plan(found.base.select("*"))
        assert len(re.findall("FileScan parquet", base)) == 3  # lineitem, orders, part
        assert len(re.findall("Generate", base)) == 1
        assert "partial_sum" in base
        for part in (found.overall, found.time_series, found.segments, found.monthly_trend,
                     found.anomaly):
            assert "InMemoryTableScan" in plan(part)
        # Days are gathered once; nothing after that is shuffled again.
        tree = plan(found.monthly_trend).split("InMemoryRelation")[0]
        assert len(re.findall("Exchange", tree)) == 1


def test_combined_parts_of_a_bundle_read_only_what_is_persisted(spark):
    with bundles.build_metrics_bundle(tables.sales(spark, SMALL)) as found:
        for df in (bundles.metrics_long(found), report.full_report(found), context.context_summary(found)):
            text = df._jdf.queryExecution().withCachedData().toString()
            assert "InMemoryRelation" in text
            assert not re.findall(r"(?<!InMemory)Relation \[", text)


def test_clean_transactions_parse_once(spark):
    clean = cleaning.clean_transactions(tables.raw_orders(spark, SMALL))
    optimized = clean._jdf.queryExecution().optimizedPlan().toString()
    # Date, amount and cost; the text of a number stands twice in one expression, which
    # generated code evaluates once.
    assert len(re.findall("regexp_extract", optimized)) == 1 + 2 * 2


def test_series_needs_no_join(spark):
    text = plan(kpi.revenue_time_series(tables.orders_tx(spark, SMALL), "day"))
    assert "Join" not in text and len(re.findall("FileScan", text)) == 1


def test_top_segments_are_limited_before_they_meet(spark):
    values = kpi.segment_values(tables.orders_tx(spark, SMALL), "customer_id")
    text = plan(kpi.rank_segments(values, 5))
    assert "bucket" in text and len(re.findall("FileScan", text)) == 1


def test_equal_vectors_are_limited_on_the_map_side(spark):
    rows = documents.index_rows(tables.orders_tx(spark, SMALL), "order_key")
    text = plan(similarity.first_of_equal(rows.select("id", "pos", "embedding"), 5))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_upsert_does_not_shuffle_the_index(spark):
    orders = tables.orders_tx(spark, SMALL)
    old = documents.index_rows(orders, "order_key")
    new = documents.index_rows(orders.where(F.col("channel") == "O"), "order_key")
    text = plan(index.upsert(old, new))
    anti = re.search(r"BroadcastHashJoin \[id#\d+\], \[id#\d+\], LeftAnti", text)
    assert anti is not None
