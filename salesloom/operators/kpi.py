"""KPIs over clean transactions: totals, series, segments, trend and anomaly.

Every operator takes ``by``: columns that split the input into independent bundles
(``by=()`` is one bundle over everything). All of them first reduce the transactions to
additive measures, so the large table is only ever touched by one partial aggregation;
windows run on aggregated rows, whose number per window is bounded by the calendar or by
an explicit bucket count.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEGMENTS = ("category", "product", "customer_id", "channel")
MIN_HISTORY_DAYS = 5


def gathered(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bring each ``by`` group together once, so that all that follows needs no shuffle.

    Only for rows whose number per group is bounded: days of a calendar, or the best few
    of a fixed number of buckets.
    """
    return df.repartition(*by) if by else df.repartition(1)


def require_columns(tx: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in tx.columns]
    if missing:
        raise ValueError("Transactions lack the column(s): " + ", ".join(missing))


# ---------------------------------------------------------------------------
# Additive measures
# ---------------------------------------------------------------------------


def measures(tx: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Transactions as additive measures: ``by, day, revenue[, cost], n_rows, date_*``."""
    require_columns(tx, "date", "amount", *by)
    cost = [F.col("cost").cast("double").alias("cost")] if "cost" in tx.columns else []
    return tx.select(
        *by,
        F.to_date("date").alias("day"),
        F.col("amount").cast("double").alias("revenue"),
        *cost,
        F.lit(1).cast("bigint").alias("n_rows"),
        F.col("date").alias("date_min"),
        F.col("date").alias("date_max"),
    )


def exact_terms(value: Column) -> tuple[Column, Column]:
    """``value`` as ten-thousandths in a long, or else as a decimal of ten places.

    Money has up to four places, which a long holds; decimals are many times slower to make and
    to add. Of the two terms at most one is not NULL; infinities have neither.
    """
    scaled = value * 10_000
    units = F.rint(scaled)
    is_money = (F.abs(units) <= 1e12) & (F.abs(scaled - units) < 5e-7)
    return (F.when(is_money, units.cast("bigint")),
            F.when(~is_money, value.try_cast("decimal(30,10)")))


def exact_sum(value: Column, terms: tuple[Column, Column] | None = None) -> Column:
    """Sum as double that does not depend on the order of addition.

    Ten-thousandths are added as hundreds and what is left of them, so that 9e12 rows fit longs;
    other values as decimals of ten places. What fits no decimal (infinities) is added as it is.
    The sum of no values is NULL. ``terms`` is ``exact_terms(value)``, if known.
    """
    units, fine = terms or exact_terms(value)
    hundreds = F.sum((units / 1_000_000).cast("bigint")).cast("decimal(20,0)")
    rest = F.sum(units % 1_000_000).cast("decimal(20,0)")
    coarse = (hundreds * F.lit(Decimal(100)) + rest * F.lit(Decimal("0.0001"))).cast("decimal(38,10)")
    decimals = F.sum(fine)
    total = F.coalesce((coarse + decimals).cast("double"), coarse.cast("double"),
                       decimals.cast("double"))
    others = F.sum(F.when(units.isNull() & fine.isNull(), value))
    return F.coalesce(total + others, total, others)


def add_up(measured: DataFrame, *keys: str | Column) -> DataFrame:
    """Sum measures per key. Works on transactions and on rows summed before."""
    totals = [exact_sum(F.col("revenue")).alias("revenue")]
    if "cost" in measured.columns:
        totals.append(exact_sum(F.col("cost")).alias("cost"))
    totals += [F.sum("n_rows").alias("n_rows"), F.min("date_min").alias("date_min"),
               F.max("date_max").alias("date_max")]
    return measured.groupBy(*keys).agg(*totals)


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def _margin(profit: Column, revenue: Column) -> Column:
    return F.when(revenue > 0, profit / revenue * 100.0)


def _profit_columns(df: DataFrame) -> list[Column]:
    """``cost, gross_profit, gross_margin_pct`` next to ``revenue``, if cost is known."""
    if "cost" not in df.columns:
        return []
    profit = F.col("revenue") - F.col("cost")
    return [F.col("cost"), profit.alias("gross_profit"),
            _margin(profit, F.col("revenue")).alias("gross_margin_pct")]


# ---------------------------------------------------------------------------
# Overall
# ---------------------------------------------------------------------------


def overall_from(measured: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    summed = add_up(measured, *by)
    revenue, n = _or_zero("revenue"), F.coalesce(F.col("n_rows"), F.lit(0))
    out = [*by, revenue.alias("total_revenue")]
    if "cost" in measured.columns:
        cost = _or_zero("cost")
        out += [cost.alias("total_cost"), (revenue - cost).alias("gross_profit"),
                _margin(revenue - cost, revenue).alias("gross_margin_pct")]
    out += [n.alias("n_transactions"), F.when(n > 0, revenue / n).alias("avg_order_value"),
            "date_min", "date_max"]
    return summed.select(*out)


def overall_metrics(tx: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Revenue, cost, profit, margin, count, average order value and date range."""
    return overall_from(measures(tx, by), by)


# ---------------------------------------------------------------------------
# Time series
# ---------------------------------------------------------------------------


def _grid(granularity: str) -> tuple[Column, str, Column]:
    """(grid date of a day, step, label of a grid date) for day, week or month."""
    day, slot = F.col("day"), F.col("slot")
    if granularity == "day":
        return day, "interval 1 day", slot
    if granularity == "week":  # Monday to Sunday, labelled by the Sunday
        return F.next_day(F.date_sub(day, 1), "Sun"), "interval 7 days", slot
    if granularity == "month":  # labelled by the last day
        return F.trunc(day, "MM"), "interval 1 month", F.last_day(slot)
    raise ValueError(f"Unsupported granularity '{granularity}'; use day, week or month.")


def series_from(measured: DataFrame, granularity: str, by: Sequence[str] = ()) -> DataFrame:
    start, step, label = _grid(granularity)
    summed = add_up(
        measured.where(F.col("day").isNotNull()).withColumn("slot", start), *by, "slot")
    # Gaps: every row also emits the empty periods up to the next one, so no calendar
    # table, no join and no second scan are needed.
    following = F.lead("slot").over(Window.partitionBy(*by).orderBy("slot"))
    until = F.coalesce((following - F.expr(step)).cast("date"), F.col("slot"))
    filled = summed.withColumn("until", until).select(
        *by, "revenue", *(["cost"] if "cost" in measured.columns else []),
        F.posexplode(F.sequence("slot", "until", F.expr(step))).alias("gap", "slot"))

    def at_start(name: str) -> Column:
        return F.when(F.col("gap") == 0, _or_zero(name)).otherwise(0.0).alias(name)

    values = [at_start(c) for c in ("revenue", "cost") if c in filled.columns]
    zeroed = filled.select(*by, label.alias("period"), *values)
    return zeroed.select(*by, "period", "revenue", *_profit_columns(zeroed))


def revenue_time_series(tx: DataFrame, granularity: str = "month",
                        by: Sequence[str] = ()) -> DataFrame:
    """Revenue (and cost, profit, margin) per day, week or month, without gaps."""
    return series_from(measures(tx, by), granularity, by)


# ---------------------------------------------------------------------------
# Segments
# ---------------------------------------------------------------------------


def segment_types(tx: DataFrame) -> list[str]:
    return [s for s in SEGMENTS if s in tx.columns]


def segment_values(tx: DataFrame, segment: str, by: Sequence[str] = ()) -> DataFrame:
    """Sums per segment value: ``by, segment_type, segment_value, revenue[, cost],
    order_count``. Rows without a value are left out."""
    require_columns(tx, "amount", segment, *by)
    totals = [F.coalesce(exact_sum(F.col("amount").cast("double")), F.lit(0.0)).alias("revenue")]
    if "cost" in tx.columns:
        totals.append(F.coalesce(exact_sum(F.col("cost").cast("double")), F.lit(0.0))
                      .alias("cost"))
    return (
        tx.where(F.col(segment).isNotNull())
        .groupBy(*by, F.lit(segment).alias("segment_type"),
                 F.col(segment).cast("string").alias("segment_value"))
        .agg(*totals, F.count("amount").alias("order_count"))
    )


def _share(revenue: Column, total: Column) -> Column:
    return F.when(total > 0, revenue / total * 100.0).otherwise(0.0)


def rank_segments(values: DataFrame, top_n: int, by: Sequence[str] = (),
                  buckets: int | None = None) -> DataFrame:
    """The ``top_n`` values per segment type by revenue, with their share of all values.

    A type can have very many values (customers). They are first ranked and summed within
    hash buckets, at most ``top_n`` rows per bucket go on, and only those meet in one
    task. The result is exact: every bucket carries its whole revenue along.
    """
    group = [*by, "segment_type"]
    if buckets is None:
        buckets = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("revenue"), F.asc("segment_value")]
    in_bucket = Window.partitionBy(*group, "bucket")
    best = (
        values.withColumn("bucket", F.pmod(F.xxhash64("segment_value"), F.lit(buckets)))
        .withColumn("bucket_revenue", F.sum("revenue").over(in_bucket))
        .withColumn("place", F.row_number().over(in_bucket.orderBy(*order)))
        .where(F.col("place") <= max(top_n, 1))
    )
    overall = Window.partitionBy(*group)
    ranked = (
        gathered(best, by).withColumn("total", F.sum(F.when(F.col("place") == 1, F.col("bucket_revenue")))
                        .over(overall))
        .withColumn("rank", F.row_number().over(overall.orderBy(*order)))
        .where(F.col("rank") <= top_n)
    )
    return ranked.select(
        *group, "rank", "segment_value", "revenue", *_profit_columns(values), "order_count",
        _share(F.col("revenue"), F.col("total")).alias("revenue_share_pct"))


def all_segments(values: DataFrame, by: Sequence[str] = (),
                 one_type: bool = False) -> DataFrame:
    """Every value with its share. The total per type is a tiny table joined back, or a
    scalar where there is only one."""
    group = [*by, "segment_type"]
    if one_type and not by:
        total = values.agg(exact_sum(F.col("revenue")).alias("total")).scalar()
        joined = values.withColumn("total", total)
    else:
        totals = values.groupBy(*group).agg(exact_sum(F.col("revenue")).alias("total"))
        joined = null_safe_join(values, totals, group)
    return joined.select(
        *group, "segment_value", "revenue", *_profit_columns(values), "order_count",
        _share(F.col("revenue"), F.col("total")).alias("revenue_share_pct"))


def segment_revenue(tx: DataFrame, segment: str, top_n: int | None = 5,
                    by: Sequence[str] = ()) -> DataFrame:
    """Revenue per value of ``segment``; ``top_n=None`` keeps every value."""
    values = segment_values(tx, segment, by)
    if top_n is None:
        return all_segments(values, by, one_type=True)
    return rank_segments(values, top_n, by)


# ---------------------------------------------------------------------------
# Month-over-month trend
# ---------------------------------------------------------------------------


def trend_from(measured: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    monthly = add_up(
        measured.where(F.col("day").isNotNull()).withColumn("period", F.last_day("day")),
        *by, "period").select(*by, "period", "revenue")
    used = F.coalesce(F.col("revenue") != 0, F.lit(False))
    # Months without revenue sort last and never count; gap months need no filling here.
    place = F.row_number().over(
        Window.partitionBy(*by).orderBy(F.desc(used), F.desc("period")))
    last_two = monthly.withColumn("place", place).where(F.col("place") <= 2)

    def pick(name: str, n: int) -> Column:
        return F.max(F.when(used & (F.col("place") == n), F.col(name)))

    picked = last_two.groupBy(*by).agg(
        (F.count_if(used) == 2).alias("has_enough_data"),
        pick("period", 1).alias("current_period"), pick("revenue", 1).alias("current_revenue"),
        pick("period", 2).alias("previous_period"),
        pick("revenue", 2).alias("previous_revenue"))
    enough = F.col("has_enough_data")
    change = F.col("current_revenue") - F.col("previous_revenue")

    def if_enough(value: Column | str) -> Column:
        return F.when(enough, F.col(value) if isinstance(value, str) else value)

    return picked.select(
        *by, "has_enough_data",
        F.when(~enough, "insufficient_data").when(change > 0, "up")
        .when(change < 0, "down").otherwise("flat").alias("direction"),
        *[if_enough(c).alias(c) for c in ("current_period", "current_revenue",
                                          "previous_period", "previous_revenue")],
        if_enough(change).alias("absolute_change"),
        if_enough(change / F.col("previous_revenue") * 100.0).alias("percent_change"))


def monthly_trend(tx: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The last month with revenue against the one with revenue before it."""
    return trend_from(measures(tx, by), by)


# ---------------------------------------------------------------------------
# Last-day anomaly
# ---------------------------------------------------------------------------


def anomaly_from(measured: DataFrame, lookback_days: int = 30, sigma: float = 2.0,
                 by: Sequence[str] = ()) -> DataFrame:
    daily = (add_up(measured.where(F.col("day").isNotNull()), *by, "day")
             .select(*by, "day", _or_zero("revenue").alias("revenue")))
    group = Window.partitionBy(*by)
    recent = (
        daily.withColumn("first", F.min("day").over(group))
        .withColumn("last", F.max("day").over(group))
        .where(F.col("day") >= F.date_sub("last", lookback_days))
    )
    past = F.when(F.col("day") < F.col("last"), F.col("revenue"))
    stats = recent.groupBy(*by).agg(
        F.max("last").alias("current_date"),
        F.max(F.when(F.col("day") == F.col("last"), F.col("revenue")))
        .alias("current_revenue"),
        F.max(F.least(F.lit(lookback_days), F.date_diff("last", "first"))).alias("n"),
        F.count(past).alias("m"), F.coalesce(F.avg(past), F.lit(0.0)).alias("m_mean"),
        F.coalesce(F.var_pop(past), F.lit(0.0)).alias("m_var"))
    return _judged(stats, sigma, by)


def _judged(stats: DataFrame, sigma: float, by: Sequence[str]) -> DataFrame:
    """Status of days from the moments of their history: of ``n`` days, ``m`` with sales.

    Days without sales are zeros of the history: m days with data, n - m zeros. Mean and
    variance of both parts are merged instead of generating the empty days.
    """
    n, m = F.col("n"), F.col("m")
    # (No empty days: the mean is taken as it is, so constant history has a spread of 0.)
    mean = F.when(m == n, F.col("m_mean")).otherwise(m * F.col("m_mean") / n)
    shift = F.col("m_mean") - mean
    variance = (m * (F.col("m_var") + shift * shift) + (n - m) * mean * mean) / n
    enough = F.coalesce(n >= MIN_HISTORY_DAYS, F.lit(False))
    with_moments = stats.select(
        *by, enough.alias("has_enough_history"), "current_date", "current_revenue",
        F.when(enough, mean).alias("history_mean"),
        F.when(enough, F.sqrt(variance)).alias("history_std"))
    deviation = F.col("current_revenue") - F.col("history_mean")
    z = F.when(F.col("history_std") > 0, deviation / F.col("history_std"))
    return with_moments.select(
        *by, "has_enough_history",
        F.when(~F.col("has_enough_history"), "insufficient_history")
        .when(z > sigma, "high").when(z < -sigma, "low").otherwise("normal").alias("status"),
        "current_date", "current_revenue", "history_mean", "history_std", z.alias("z_score"))


def anomalies_from(measured: DataFrame, lookback_days: int = 30, sigma: float = 2.0,
                   by: Sequence[str] = (), empty_days: bool = True) -> DataFrame:
    daily = (add_up(measured.where(F.col("day").isNotNull()), *by, "day")
             .select(*by, "day", _or_zero("revenue").alias("revenue")))
    group = Window.partitionBy(*by)
    number = F.unix_date("day")
    past = group.orderBy(number).rangeBetween(-lookback_days, -1)
    days = daily.withColumn("sold", F.col("revenue"))
    if empty_days:  # every row also emits the empty days up to the next one
        until = F.coalesce(F.date_sub(F.lead("day").over(group.orderBy("day")), 1), F.col("day"))
        rows = daily.withColumn("until", until).select(
            *by, "revenue", F.posexplode(F.sequence("day", "until")).alias("gap", "day"))
        sold = F.when(F.col("gap") == 0, F.col("revenue"))
        days = rows.select(*by, "day", F.coalesce(sold, F.lit(0.0)).alias("revenue"), sold.alias("sold"))
    stats = days.select(
        *by, F.col("day").alias("current_date"), F.col("revenue").alias("current_revenue"),
        F.least(F.lit(lookback_days), F.date_diff("day", F.min("day").over(group))).alias("n"),
        F.count("sold").over(past).alias("m"),
        F.coalesce(F.avg("sold").over(past), F.lit(0.0)).alias("m_mean"),
        F.coalesce(F.var_pop("sold").over(past), F.lit(0.0)).alias("m_var"))
    return _judged(stats, sigma, by)


def revenue_anomalies(tx: DataFrame, lookback_days: int = 30, sigma: float = 2.0,
                      by: Sequence[str] = (), empty_days: bool = True) -> DataFrame:
    """Revenue of every day against the ``lookback_days`` days before it (z-score).

    The last day's row is that of :func:`revenue_anomaly_last_day`. Days without sales count
    as zeros of the history; they get rows of their own unless ``empty_days`` is false, in
    which case none are generated. Windows run over days, in one task per group.
    """
    return anomalies_from(measures(tx, by), lookback_days, sigma, by, empty_days)


def revenue_anomaly_last_day(tx: DataFrame, lookback_days: int = 30, sigma: float = 2.0,
                             by: Sequence[str] = ()) -> DataFrame:
    """Revenue of the last day against the days before it (z-score)."""
    return anomaly_from(measures(tx, by), lookback_days, sigma, by)


# ---------------------------------------------------------------------------
# Combining results per group
# ---------------------------------------------------------------------------


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "left") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the keys come from the left side."""
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_{k}"])
    return left.join(renamed, condition, how).drop(*[f"_{k}" for k in keys])


def attach(left: DataFrame, right: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Add the row of ``right`` that belongs to each ``by`` group as struct ``name``.

    Without ``by`` the right side is one row and becomes a scalar subquery.
    """
    packed = right.select(*by, F.struct(*[c for c in right.columns if c not in by])
                          .alias(name))
    if by:
        return null_safe_join(left, packed, by)
    return left.withColumn(name, packed.scalar())
