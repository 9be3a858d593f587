"""All KPIs of one table from a single pass over it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kpi


@dataclass
class MetricsBundle:
    """Five lazy results over one persisted aggregate. ``release()`` frees it."""

    overall: DataFrame
    time_series: DataFrame
    segments: DataFrame
    monthly_trend: DataFrame
    anomaly: DataFrame
    by: tuple[str, ...]
    segment_types: tuple[str, ...]
    top_n: int | None
    values: DataFrame
    base: DataFrame

    def release(self) -> None:
        self.base.unpersist()

    def __enter__(self) -> "MetricsBundle":
        return self

    def __exit__(self, *_: object) -> None:
        self.release()


def _one_pass(tx: DataFrame, by: tuple[str, ...], segments: Sequence[str]) -> DataFrame:
    """Sums per day and per value of each segment column, ``kind`` and ``key``: one scan.

    Every row gives one pair per kind. Partial aggregation runs before the shuffle, so days,
    categories and channels shuffle next to nothing and only distinct products and customers
    travel. (Grouping sets would do the same, but parts of a plan that hold them twice no longer
    match what is persisted.)
    """
    cost = [F.col("cost").cast("double").alias("cost")] if "cost" in tx.columns else []
    keys = {"day": F.to_date("date"), **{s: F.col(s) for s in segments}}
    pairs = [F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"))
             for kind, key in keys.items()]
    # Exact terms are made below the generator: once per row, not once per pair.
    rows = tx.select(*by, F.col("amount").cast("double").alias("revenue"), *cost, "date", *segments)
    names = ["revenue", *(["cost"] if cost else [])]
    terms = {c: (f"{c}_units", f"{c}_fine") for c in names}
    made = [term.alias(name) for c in names
            for term, name in zip(kpi.exact_terms(F.col(c)), terms[c])]
    rows = rows.select("*", *made).select(
        *by, *names, *[name for c in names for name in terms[c]], "date", F.inline(F.array(*pairs)))
    totals = [kpi.exact_sum(F.col(c), tuple(F.col(name) for name in terms[c])).alias(c) for c in names]
    return rows.groupBy(*by, "kind", "key").agg(
        *totals, F.count(F.lit(1)).alias("n_rows"), F.count("revenue").alias("order_count"),
        F.min("date").alias("date_min"), F.max("date").alias("date_max"))


def build_metrics_bundle(tx: DataFrame, granularity: str = "month", top_n: int | None = 5,
                         lookback_days: int = 30, sigma: float = 2.0,
                         by: Sequence[str] = ()) -> MetricsBundle:
    """Overall KPIs, time series, top segments, monthly trend and anomaly check.

    The aggregate that feeds all five is persisted (memory, spilling to disk); a lost
    executor only means recomputing its partitions.
    """
    by = tuple(by)
    kpi.require_columns(tx, "date", "amount", *by)
    types = [s for s in kpi.segment_types(tx) if s not in by]
    base = _one_pass(tx, by, types).persist(StorageLevel.MEMORY_AND_DISK)
    has_cost = ["cost"] if "cost" in tx.columns else []
    daily = kpi.gathered(base.where(F.col("kind") == "day").select(
        *by, F.col("key").cast("date").alias("day"), "revenue", *has_cost, "n_rows", "date_min",
        "date_max"), by)
    sums = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("revenue", *has_cost)]
    values = (
        base.where(F.col("kind") != "day")
        .select(*by, F.col("kind").alias("segment_type"), F.col("key").alias("segment_value"),
                *sums, "order_count")
        .where(F.col("segment_value").isNotNull())
    )
    if top_n is None:
        segments = kpi.all_segments(values, by)
    else:
        segments = kpi.rank_segments(values, top_n, by)
    return MetricsBundle(
        overall=kpi.overall_from(daily, by),
        time_series=kpi.series_from(daily, granularity, by),
        segments=segments,
        monthly_trend=kpi.trend_from(daily, by),
        anomaly=kpi.anomaly_from(daily, lookback_days, sigma, by),
        by=by, segment_types=tuple(types), top_n=top_n, values=values, base=base)


def metrics_long(bundle: MetricsBundle) -> DataFrame:
    """The bundle as one long table: a row per number or text.

    Columns: ``by``, ``section, period, segment_type, segment_value, metric, value, text``.
    """
    by = list(bundle.by)
    none = F.lit(None).cast("string")

    def unrolled(df: DataFrame, section: str, period: Column = none,
                 segment: tuple[Column, Column] = (none, none),
                 skip: Sequence[str] = ()) -> DataFrame:
        kinds = dict(df.dtypes)
        cells = []
        for c in df.columns:
            if c in by or c in skip:
                continue
            is_number = kinds[c] in ("double", "bigint", "int")
            cells.append(F.struct(
                F.lit(c).alias("metric"),
                (F.col(c).cast("double") if is_number else F.lit(None).cast("double"))
                .alias("value"),
                (none if is_number else F.col(c).cast("string")).alias("text")))
        return df.select(
            *by, F.lit(section).alias("section"), period.cast("string").alias("period"),
            segment[0].alias("segment_type"), segment[1].alias("segment_value"),
            F.inline(F.array(*cells)))

    return (
        unrolled(bundle.overall, "overall")
        .unionByName(unrolled(bundle.time_series, "time_series", F.col("period"),
                              skip=("period",)))
        .unionByName(unrolled(bundle.segments, "segments",
                              segment=(F.col("segment_type"), F.col("segment_value")),
                              skip=("segment_type", "segment_value")))
        .unionByName(unrolled(bundle.monthly_trend, "monthly_trend"))
        .unionByName(unrolled(bundle.anomaly, "anomaly"))
    )


def digest(bundle: MetricsBundle, recent_periods: int = 6, per_segment: int = 5) -> DataFrame:
    """One row per group with everything a report or a context text needs.

    ``overall``, ``trend`` and ``anomaly`` are structs; ``recent`` holds the last periods
    and ``segments`` the best values per type (no more than the bundle's ``top_n``), both
    of bounded length.
    """
    by = bundle.by
    if bundle.top_n is not None:
        per_segment = min(per_segment, bundle.top_n)
    newest = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("period")))
    series_columns = [c for c in bundle.time_series.columns if c not in by]
    recent = (
        bundle.time_series.withColumn("age", newest).where(F.col("age") <= recent_periods)
        .groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*series_columns)))
                          .alias("rows")))
    best = kpi.rank_segments(bundle.values, per_segment, by)
    item = F.struct("segment_type", "rank", "segment_value", "revenue", "order_count",
                    "revenue_share_pct")
    segments = best.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    row = bundle.overall.select(
        *by, F.struct(*[c for c in bundle.overall.columns if c not in by]).alias("overall"))
    row = kpi.attach(row, bundle.monthly_trend, by, "trend")
    row = kpi.attach(row, bundle.anomaly, by, "anomaly")
    row = kpi.attach(row, recent, by, "recent")
    row = kpi.attach(row, segments, by, "segments")
    empty = F.array().cast(dict(row.select("recent.rows").dtypes)["rows"])
    no_segments = F.array().cast(dict(row.select("segments.rows").dtypes)["rows"])
    return row.select(
        *by, "overall", "trend", "anomaly",
        F.coalesce("recent.rows", empty).alias("recent"),
        F.coalesce("segments.rows", no_segments).alias("segments"))
