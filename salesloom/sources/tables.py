"""Adapters from the star-schema tables to the transaction schema.

Each adapter returns ``date, amount`` and whichever of ``cost, category, product,
customer_id, channel`` the source has, plus key columns. Catalyst prunes what a query
does not use, so callers simply take the whole adapter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import na_to_null


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line, with part attributes.

    Plain equi-joins: the optimizer broadcasts a side only when its statistics are below
    the threshold, and adaptive execution splits skewed keys of the sort-merge joins.
    """
    line = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders")
    part = table(spark, folder, "part")
    joined = (line.join(orders, line.l_orderkey == orders.o_orderkey)
              .join(part, line.l_partkey == part.p_partkey))
    return joined.select(
        F.col("o_orderdate").alias("date"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"),
        (F.col("l_quantity") * F.col("p_retailprice")).alias("cost"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("product"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderpriority").alias("channel"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


def orders_tx(spark: SparkSession, folder: str, streamed: bool = False) -> DataFrame:
    """One row per order; no cost and no product. ``streamed`` reads the files as a stream."""
    orders = table(spark, folder, "orders")
    if streamed:
        # A pattern, since a stream takes a plain path for a folder, and the table can be a file.
        orders = spark.readStream.schema(orders.schema).parquet(f"{folder}/{{orders}}.parquet")
    return orders.select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("category"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderstatus").alias("channel"),
    )


def purchases(spark: SparkSession, folder: str) -> DataFrame:
    """Purchase events, with a time of day."""
    events = table(spark, folder, "events")
    return events.where(F.col("event_type") == "purchase").select(
        F.col("event_id"),
        F.col("ts").alias("date"),
        F.col("value").alias("amount"),
        F.col("user_id").cast("string").alias("customer_id"),
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """User turns of the conversations as a table of questions."""
    turns = table(spark, folder, "conversations")
    return turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Stored embeddings as an index: ``id``, ``pos``, ``embedding``, ``label``."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"),
        F.col("vec_id").alias("pos"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        "label",
    )


#: Columns of ``order_lines``.
ORDER_LINE = ("order_key", "order_date", "total_price", "status")


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as CSV lines, some with a field too few or too many (recipe in FIXTURES.md)."""
    k = F.col("o_orderkey")
    status = F.concat(F.lit('"'), "o_orderstatus", F.lit(', order"'))
    return table(spark, folder, "orders").select(F.concat_ws(
        ",", k.cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
        F.when(k % 53 != 0, status), F.when((k % 53 != 0) & (k % 47 == 0), F.lit("more"))).alias("value"))


def raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as text columns with deterministic damage (recipe in FIXTURES.md).

    The texts are what a CSV file would hold; missing-value tokens are then nulled as the
    file reader does.
    """
    k = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")

    def every(n: int) -> Column:
        return k % n == 0

    texts = table(spark, folder, "orders").select(
        k.cast("string").alias("order_key"),
        F.when(every(97), F.lit("not-a-date"))
        .when(every(89), F.lit("NA"))
        .when(every(83), F.date_format("o_orderdate", "y-M-d"))
        .when(every(101), F.lit("2024-02-30"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_date"),
        F.when(every(79), F.lit("1,234"))
        .when(every(73), F.lit(""))
        .when(every(67), F.lit("1d"))
        .when(every(61), F.concat(F.lit("  "), price, F.lit(" ")))
        .otherwise(price).alias("total_price"),
        F.when(every(71), F.lit("abc"))
        .otherwise(F.round(F.col("o_totalprice") * 0.6, 2).cast("decimal(18,2)")
                   .cast("string")).alias("cost"),
        F.when(~every(59), F.col("o_orderpriority")).alias("category"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderstatus").alias("sales_channel"),
    )
    return texts.select(*[na_to_null(F.col(c)).alias(c) for c in texts.columns])
