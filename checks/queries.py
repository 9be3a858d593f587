"""Registered queries: one per operator, each over whole tables.

Results are rounded and dates are shown as text, so that they can be compared with the
SQL in ``checks.oracle`` value by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.functions import vectors as vec
from salesloom.functions.formatting import timestamp_text
from salesloom.operators import bundle as bundles
from salesloom.operators import cleaning, documents, index, kpi, retrieval, similarity
from salesloom.plans import context, prompts, report
from salesloom.session import checkpoint_dir
from salesloom.sources import files, index_table, tables
from salesloom.streaming import kpi_stream

Query = Callable[[SparkSession, str], DataFrame]
QUESTION_KEYS = ["conv_id", "turn"]

# Decimals that are compared, by column name; six for everything else.
MONEY = ("revenue", "cost", "gross_profit", "amount", "current_revenue", "previous_revenue",
         "absolute_change")
TOTALS = ("total_revenue", "total_cost")


def _comparable(df: DataFrame, decimals: Mapping[str, int] | None = None) -> DataFrame:
    columns = []
    for name, kind in df.dtypes:
        col = F.col(name)
        if kind == "double":
            digits = (decimals or {}).get(
                name, 4 if name in MONEY else 2 if name in TOTALS else 6)
            col = F.round(col, digits)
        elif kind == "date":
            col = col.cast("string")
        elif kind.startswith("timestamp"):
            col = timestamp_text(col)
        elif kind == "int":
            col = col.cast("bigint")
        columns.append(col.alias(name))
    return df.select(*columns)


# ---------------------------------------------------------------------------
# Cleaning
# ---------------------------------------------------------------------------


def validation_report(spark: SparkSession, folder: str) -> DataFrame:
    found = cleaning.validation_report(tables.raw_orders(spark, folder))
    return found.withColumn("missing_required_columns",
                            F.array_join("missing_required_columns", ","))


def cleaning_summary(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.cleaning_summary(tables.raw_orders(spark, folder))


def clean_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return _comparable(cleaning.clean_transactions(tables.raw_orders(spark, folder)))


def _new_folder(spark: SparkSession, kind: str) -> str:
    return f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def broken_csv_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as CSV files with damaged lines: what is read, and what is kept apart and why."""
    path = _new_folder(spark, "lines")
    tables.order_lines(spark, folder).write.text(path)
    rows, broken = files.read_checked(spark, path, tables.ORDER_LINE)
    line = F.split("record", ",")
    apart = broken.select(line[0].alias("order_key"), line[1].alias("order_date"),
                          line[2].alias("total_price"), "n_fields", "cause")
    return rows.unionByName(apart, allowMissingColumns=True)


def clean_sink_touched(spark: SparkSession, folder: str) -> DataFrame:
    """Clean rows are stored by month; those of 1997 come again at a changed amount."""
    path = _new_folder(spark, "clean")
    clean = cleaning.clean_transactions(tables.raw_orders(spark, folder))
    files.write_clean(clean, path, partition_by_month=True)
    again = clean.where(F.year("date") == 1997).withColumn("amount", F.col("amount") + 1)
    files.write_clean(again, path, partition_by_month=True, touched_only=True)
    return _comparable(spark.read.parquet(path).drop("month"))


# ---------------------------------------------------------------------------
# KPIs
# ---------------------------------------------------------------------------


def revenue_daily_streamed(spark: SparkSession, folder: str) -> DataFrame:
    """Daily sums of streamed orders. No order is late: the delay spans all their dates."""
    orders = tables.orders_tx(spark, folder, streamed=True)
    path = _new_folder(spark, "daily")
    kpi_stream.daily_stream(orders, f"{path}/table", f"{path}/state", ["order_key"],
                            delay="36500 days", once=True).awaitTermination()
    return _comparable(kpi.series_from(kpi_stream.read_days(spark, f"{path}/table"), "day"))



def overall_metrics(spark: SparkSession, folder: str) -> DataFrame:
    found = kpi.overall_metrics(tables.sales(spark, folder))
    return _comparable(found, {"gross_profit": 2})


def _series(granularity: str, source: Callable = tables.sales) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _comparable(kpi.revenue_time_series(source(spark, folder), granularity))
    return query


def _segment(name: str, top_n: int | None = 5) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _comparable(kpi.segment_revenue(tables.sales(spark, folder), name, top_n))
    return query


def _trend(source: Callable, by: Sequence[str] = ()) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _comparable(kpi.monthly_trend(source(spark, folder), by))
    return query


def _anomaly(source: Callable, by: Sequence[str] = ()) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _comparable(kpi.revenue_anomaly_last_day(source(spark, folder), by=by))
    return query


def _anomalies(source: Callable, by: Sequence[str] = (), empty_days: bool = True) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _comparable(kpi.revenue_anomalies(source(spark, folder), by=by, empty_days=empty_days))
    return query


def _bundle(spark: SparkSession, folder: str, by: Sequence[str] = ()
            ) -> bundles.MetricsBundle:
    return bundles.build_metrics_bundle(tables.sales(spark, folder), by=by)


def _metrics_long(by: Sequence[str] = ()) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        found = bundles.metrics_long(_bundle(spark, folder, by))
        money = F.col("metric").isin(*MONEY)
        total = F.col("metric").isin(*TOTALS) | (
            (F.col("section") == "overall") & (F.col("metric") == "gross_profit"))
        rounded = (F.when(total, F.round("value", 2)).when(money, F.round("value", 4))
                   .otherwise(F.round("value", 6)))
        return found.withColumn("value", rounded)
    return query


# ---------------------------------------------------------------------------
# Report and context
# ---------------------------------------------------------------------------


def _report_section(section: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _comparable(report.report_section(_bundle(spark, folder), section))
    return query


def _full_report(language: str, by: Sequence[str] = ()) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _comparable(report.full_report(_bundle(spark, folder, by), language))
    return query


def _context_lines(by: Sequence[str] = ()) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _comparable(context.context_lines(_bundle(spark, folder, by)))
    return query


def context_summary(spark: SparkSession, folder: str) -> DataFrame:
    return context.context_summary(_bundle(spark, folder))


# ---------------------------------------------------------------------------
# Documents, embeddings, similarity, index
# ---------------------------------------------------------------------------


def transaction_documents(spark: SparkSession, folder: str) -> DataFrame:
    found = documents.documents(tables.orders_tx(spark, folder), "order_key")
    return _comparable(found.select("id", "pos", "text", "metadata.*"))


def text_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    embedded = documents.embed(tables.table(spark, folder, "documents").select("doc_id", "text"))
    names = ("n_chars", "n_letters", "n_digits", "n_spaces")
    return embedded.select("doc_id", *[F.col("embedding")[i].cast("bigint").alias(name)
                                       for i, name in enumerate(names)])


def cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector against the one stored after it."""
    a = tables.vectors(spark, folder).select("pos", "embedding")
    b = a.select((F.col("pos") - 1).alias("pos"), F.col("embedding").alias("next"))
    return _comparable(a.join(b, "pos").select(
        "pos", vec.cosine(F.col("embedding"), F.col("next")).alias("cosine"),
        vec.distance_score(vec.squared_l2(F.col("embedding"), F.col("next")))
        .alias("distance_score")))


def label_centroids(stored: DataFrame) -> DataFrame:
    """Mean vector per label; the number of labels is small, every vector takes part."""
    means = (stored.select("label", F.posexplode("embedding").alias("at", "x"))
             .groupBy("label", "at").agg(F.avg("x").alias("x")))
    ordered = F.array_sort(F.collect_list(F.struct("at", "x")))
    return means.groupBy("label").agg(F.transform(ordered, lambda e: e["x"]).alias("embedding"))


def _similar(metric: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        stored = tables.vectors(spark, folder)
        return _comparable(similarity.top_k(stored, label_centroids(stored), 5, metric))
    return query


def _index(spark: SparkSession, folder: str) -> DataFrame:
    return documents.index_rows(tables.orders_tx(spark, folder), "order_key")


def _flat_index(rows: DataFrame) -> DataFrame:
    return _comparable(rows.select(
        "id", "pos", "text", F.col("metadata.amount").alias("amount"),
        *[F.col("embedding")[i].alias(f"e{i}") for i in range(4)], "norm"))


def index_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Open and finished orders are indexed; then open and pending ones arrive, at a
    changed amount."""
    orders = tables.orders_tx(spark, folder)
    old = orders.where(F.col("channel").isin("F", "O"))
    new = (orders.where(F.col("channel").isin("O", "P"))
           .withColumn("amount", F.col("amount") + 1))
    merged = index.upsert(documents.index_rows(old, "order_key"),
                          documents.index_rows(new, "order_key"))
    return _flat_index(merged)


def index_upsert_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The same merge into an index table, which rewrites the buckets of the new ids."""
    orders = tables.orders_tx(spark, folder)
    old = orders.where(F.col("channel").isin("F", "O"))
    new = (orders.where(F.col("channel").isin("O", "P"))
           .withColumn("amount", F.col("amount") + 1))
    path, name = checkpoint_dir(spark), f"index-{uuid.uuid4().hex}"
    index_table.write_index(documents.index_rows(old, "order_key"), path, name)
    index_table.write_index(documents.index_rows(new, "order_key"), path, name)
    return _flat_index(index_table.read_index(spark, path, name))


def index_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    """An index table is written, replaced by one of other rows, and read back."""
    orders = tables.orders_tx(spark, folder)
    old = orders.where(F.col("channel").isin("F", "O"))
    new = (orders.where(F.col("channel").isin("O", "P"))
           .withColumn("amount", F.col("amount") + 1))
    path, name = checkpoint_dir(spark), f"index-{uuid.uuid4().hex}"
    index_table.write_index(documents.index_rows(old, "order_key"), path, name)
    index_table.write_index(documents.index_rows(new, "order_key"), path, name, rebuild=True)
    return _flat_index(index_table.read_index(spark, path, name))


# ---------------------------------------------------------------------------
# Retrieval and prompts
# ---------------------------------------------------------------------------


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """Questions with their search text; the totals reach them as a scalar."""
    totals = kpi.overall_metrics(tables.orders_tx(spark, folder))
    known = kpi.attach(tables.questions(spark, folder), totals, (), "totals")
    return known.select(
        *QUESTION_KEYS, "question",
        context.question_query(F.col("question"), F.col("totals")).alias("query"),
        context.question_filters(F.col("totals")).alias("filters"))


def _retrieved(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    asked = _asked(spark, folder)
    matches = retrieval.search(asked, _index(spark, folder), "query", QUESTION_KEYS)
    return asked, retrieval.retrieved_rows(matches)


def retrieve_for_questions(spark: SparkSession, folder: str) -> DataFrame:
    _, rows = _retrieved(spark, folder)
    return _comparable(rows.drop("metadata"))


def retrieval_json(spark: SparkSession, folder: str) -> DataFrame:
    asked, rows = _retrieved(spark, folder)
    found = retrieval.contexts(asked, rows, QUESTION_KEYS, filters=F.col("filters"))
    return retrieval.context_json(found, QUESTION_KEYS)


def retrieval_documents(spark: SparkSession, folder: str) -> DataFrame:
    asked, rows = _retrieved(spark, folder)
    found = retrieval.retrieved_documents(rows, asked, QUESTION_KEYS)
    meta = F.col("metadata")
    return _comparable(found.select(
        *QUESTION_KEYS, "rank", "page_content",
        *[meta[c].alias(c) for c in ("id", "transaction_id", "score", "amount", "query",
                                     "language", "top_k")]))


def search_result_lines(spark: SparkSession, folder: str) -> DataFrame:
    _, rows = _retrieved(spark, folder)
    return _comparable(retrieval.result_lines(rows, QUESTION_KEYS))


def rag_context_block(spark: SparkSession, folder: str) -> DataFrame:
    _, rows = _retrieved(spark, folder)
    return retrieval.context_block(rows, QUESTION_KEYS)


def rag_context_block_id(spark: SparkSession, folder: str) -> DataFrame:
    _, rows = _retrieved(spark, folder)
    return retrieval.context_block(rows, QUESTION_KEYS, "id", "report", marker=True)


def _orders_bundle(spark: SparkSession, folder: str) -> bundles.MetricsBundle:
    return bundles.build_metrics_bundle(tables.orders_tx(spark, folder))


def report_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    found = prompts.report_search(_orders_bundle(spark, folder), _index(spark, folder))
    filters = F.col("filters")
    return _comparable(found.select(
        "query", filters["current_period"].alias("current_period"),
        filters["anomaly_date"].alias("anomaly_date"), "rank", "id", "score", "date",
        "amount", "category", "text"))


def _report_prompts(language: str, hybrid: bool) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return prompts.report_prompts(_orders_bundle(spark, folder), language, hybrid,
                                      _index(spark, folder))
    return query


def question_prompts(spark: SparkSession, folder: str) -> DataFrame:
    asked, rows = _retrieved(spark, folder)
    blocks = retrieval.context_block(rows, QUESTION_KEYS, marker=True)
    return prompts.question_prompts(asked, _orders_bundle(spark, folder), QUESTION_KEYS,
                                    blocks=blocks)


def question_prompts_id(spark: SparkSession, folder: str) -> DataFrame:
    """Indonesian, without retrieved rows, whole."""
    return prompts.question_prompts(
        tables.questions(spark, folder), _orders_bundle(spark, folder), QUESTION_KEYS,
        language="id", max_chars=None)


QUERIES: dict[str, Query] = {
    "validation_report": validation_report,
    "cleaning_summary": cleaning_summary,
    "clean_transactions": clean_transactions,
    "broken_csv_rows": broken_csv_rows,
    "clean_sink_touched": clean_sink_touched,
    "overall_metrics": overall_metrics,
    "revenue_daily": _series("day"),
    "revenue_weekly": _series("week"),
    "revenue_monthly": _series("month"),
    "revenue_daily_purchases": _series("day", tables.purchases),
    "revenue_daily_streamed": revenue_daily_streamed,
    "segment_category": _segment("category"),
    "segment_product": _segment("product"),
    "segment_customer": _segment("customer_id"),
    "segment_channel": _segment("channel"),
    "segment_all": _segment("customer_id", None),
    "monthly_trend": _trend(tables.sales),
    "anomaly_last_day": _anomaly(tables.orders_tx),
    "monthly_trend_by_channel": _trend(tables.sales, ["channel"]),
    "anomaly_by_channel": _anomaly(tables.sales, ["channel"]),
    "anomaly_every_day": _anomalies(tables.orders_tx),
    "anomaly_every_day_by_channel": _anomalies(tables.sales, ["channel"], empty_days=False),
    "metrics_bundle_long": _metrics_long(),
    "metrics_bundle_by_channel": _metrics_long(["channel"]),
    "report_overview": _report_section("overview"),
    "report_segments": _report_section("segments"),
    "report_trend": _report_section("trend"),
    "report_anomaly": _report_section("anomaly"),
    "full_report": _full_report("en"),
    "full_report_id": _full_report("id"),
    "full_report_by_channel": _full_report("en", ["channel"]),
    "context_lines": _context_lines(),
    "context_lines_by_channel": _context_lines(["channel"]),
    "context_summary": context_summary,
    "transaction_documents": transaction_documents,
    "text_embeddings": text_embeddings,
    "cosine_pairs": cosine_pairs,
    "similar_topk": _similar("cosine"),
    "similar_topk_l2": _similar("l2"),
    "index_upsert": index_upsert,
    "index_upsert_stored": index_upsert_stored,
    "index_rebuild": index_rebuild,
    "retrieve_for_questions": retrieve_for_questions,
    "retrieval_json": retrieval_json,
    "retrieval_documents": retrieval_documents,
    "search_result_lines": search_result_lines,
    "rag_context_block": rag_context_block,
    "rag_context_block_id": rag_context_block_id,
    "report_retrieval": report_retrieval,
    "report_prompts": _report_prompts("en", hybrid=False),
    "report_prompts_hybrid_id": _report_prompts("id", hybrid=True),
    "question_prompts": question_prompts,
    "question_prompts_id": question_prompts_id,
}
