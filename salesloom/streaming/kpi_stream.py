"""Daily sums kept up to date from a stream of transactions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.kpi import add_up, measures
from ..sources.shared_files import names


def daily_stream(tx: DataFrame, path: str, checkpoint: str, unique: Sequence[str] = (),
                 delay: str = "7 days", by: Sequence[str] = (), once: bool = False
                 ) -> StreamingQuery:
    """Sums per day (and ``by``) of streamed transactions, as a Parquet table of one folder a month.

    Rows that repeat ``unique`` within the watermark count once. Rows of a day that ended more
    than ``delay`` before the latest date of earlier micro-batches are too late: they are left
    out and counted (see ``late_rows``). State holds the days and keys the watermark has not
    passed. A micro-batch rewrites the months of its days only, with whole sums, not increments,
    so one that is replayed after a failure changes nothing. Rows without a date have no day.
    ``once`` processes what is there and stops.
    """
    rows = (tx.where(F.col("date").isNotNull())
            .withColumn("at", F.col("date").cast("timestamp")).withWatermark("at", delay))
    if unique:
        rows = rows.dropDuplicatesWithinWatermark(list(unique))
    measured = measures(rows, [*by, "at"]).drop("day")
    summed = add_up(measured, *by, F.window("at", "1 day").alias("slot"))
    daily = summed.select(*by, F.to_date("slot.start").alias("day"),
                          *[c for c in summed.columns if c not in (*by, "slot")])

    def merge(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                _replace_days(batch, path, by)
        finally:
            batch.unpersist()

    writer = (daily.writeStream.outputMode("update").foreachBatch(merge)
              .option("checkpointLocation", checkpoint))
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _replace_days(days: DataFrame, path: str, by: Sequence[str]) -> None:
    """Write ``days`` over those of the table; months without any are not read."""
    days = days.withColumn("month", F.trunc("day", "MM"))
    merged, keys = days, [*by, "day"]
    if names(days.sparkSession, path):
        stored = days.sparkSession.read.schema(days.schema).parquet(path)
        touched = stored.join(days.select("month").distinct(), "month", "left_semi")
        same = reduce(lambda a, b: a & b, [touched[k].eqNullSafe(days[k]) for k in keys])
        kept = touched.join(days, same, "left_anti")
        merged = days.unionByName(kept.select(*days.columns))
    (merged.hint("rebalance", F.col("month")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path))


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """The stored sums, in the form ``kpi.series_from`` and ``kpi.overall_from`` take."""
    return spark.read.parquet(path).drop("month")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark in the micro-batches the query still reports."""
    return sum(state["numRowsDroppedByWatermark"]
               for progress in query.recentProgress for state in progress["stateOperators"])
