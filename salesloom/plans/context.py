"""KPI digests as compact context text, and the retrieval queries built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formatting import (cut, date_text, fixed, float_text, grouped_number, quoted,
                                    timestamp_text)
from ..operators.bundle import MetricsBundle, digest
from ..operators.kpi import SEGMENTS
from .report import _numbered, _tagged, best_values

MAX_CONTEXT_CHARS = 12_000
TRUNCATED = "\n\n[Context truncated for length]"

# Section headings and labels of the context text.
OVERALL_LABELS = (
    ("Total revenue", "total_revenue"),
    ("Total cost", "total_cost"),
    ("Gross profit", "gross_profit"),
    ("Gross margin %", "gross_margin_pct"),
    ("Number of transactions", "n_transactions"),
    ("Average order value", "avg_order_value"),
)
TREND_LABELS = (
    ("Current period", "current_period"),
    ("Current revenue", "current_revenue"),
    ("Previous period", "previous_period"),
    ("Previous revenue", "previous_revenue"),
    ("Absolute change", "absolute_change"),
    ("Percent change", "percent_change"),
)
ANOMALY_LABELS = (
    ("Status", "status"),
    ("Last date", "current_date"),
    ("Last revenue", "current_revenue"),
    ("Expected mean", "history_mean"),
    ("Expected std", "history_std"),
    ("Z-score", "z_score"),
)
SERIES_COLUMNS = ("revenue", "cost", "gross_profit", "gross_margin_pct")


def _fields(row: DataFrame, name: str) -> list[str]:
    dtype = row.schema[name].dataType
    return getattr(dtype, "elementType", dtype).fieldNames()


def _plain(value: Column, name: str) -> Column:
    """Unformatted value text. Doubles are rounded to six decimals first, so that the
    order in which a cluster added them up cannot show."""
    if name.endswith(("period", "date")):
        return timestamp_text(value)
    if name in ("status", "direction"):
        return value
    return float_text(F.round(value, 6))


def _labelled(struct: str, labels: Sequence[tuple[str, str]], text) -> list[Column]:
    # concat is NULL when the value is missing, and NULL lines are left out.
    return [F.concat(F.lit(f"- {shown}: "), text(F.col(struct).getField(name), name))
            for shown, name in labels]


def overall_section(row: DataFrame) -> Column:
    known = _fields(row, "overall")
    labels = [pair for pair in OVERALL_LABELS if pair[1] in known]
    low, high = (timestamp_text(F.col(f"overall.{c}")) for c in ("date_min", "date_max"))
    span = F.concat(F.lit("- Date range: "), F.coalesce(low, F.lit("None")), F.lit(" to "),
                    F.coalesce(high, F.lit("None")))
    return F.array_compact(F.array(
        F.lit("[Overall metrics]"),
        *_labelled("overall", labels, lambda value, _: grouped_number(value, 2)),
        F.when(low.isNotNull() | high.isNotNull(), span)))


def series_section(row: DataFrame) -> Column:
    shown = [c for c in SERIES_COLUMNS if c in _fields(row, "recent")]

    def cell(value: Column) -> Column:
        usable = ~F.isnan(value) & (F.abs(value) != float("inf"))
        return F.coalesce(F.when(usable, grouped_number(value, 2)), F.lit("-"))

    header = ["period", *shown]
    lines = F.concat(
        F.array(F.lit("[Revenue time series (last rows)]"), F.lit(" | ".join(header)),
                F.lit(" | ".join("-" * len(h) for h in header))),
        F.transform("recent", lambda r: F.concat_ws(
            " | ", date_text(r.period), *[cell(r[c]) for c in shown])))
    return F.when(F.size("recent") > 0, lines).otherwise(F.array().cast("array<string>"))


def _segment_item(kind: str):
    def item(s: Column) -> Column:
        return F.concat(F.lit(f"  • {kind}="), quoted(s.segment_value),
                        F.lit(", revenue="), grouped_number(s.revenue, 2),
                        F.lit(", share="), fixed(s.revenue_share_pct, 1), F.lit("%"))
    return item


def segments_section(segment_types: Sequence[str], per_segment: int = 5) -> Column:
    kinds = [s for s in SEGMENTS if s in segment_types]
    if not kinds:
        return F.array().cast("array<string>")
    parts = [F.array(F.lit("[Top segments]"))]
    for kind in kinds:
        best = best_values(kind, per_segment)
        items = F.transform(best, _segment_item(kind))
        parts.append(F.when(
            F.size(best) > 0, F.concat(F.array(F.lit(f"- Segment type: {kind}")), items)
        ).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)


def trend_section() -> Column:
    labels = (("Direction", "direction"), *TREND_LABELS)
    return F.array_compact(F.array(F.lit("[Monthly trend summary]"),
                                   *_labelled("trend", labels, _plain)))


def anomaly_section() -> Column:
    return F.array_compact(F.array(F.lit("[Recent anomaly check]"),
                                   *_labelled("anomaly", ANOMALY_LABELS, _plain)))


def context_sections(row: DataFrame, segment_types: Sequence[str],
                     per_segment: int = 5) -> dict[str, Column]:
    return {
        "overall": overall_section(row),
        "time_series": series_section(row),
        "segments": segments_section(segment_types, per_segment),
        "monthly_trend": trend_section(),
        "anomaly": anomaly_section(),
    }


def context_lines(bundle: MetricsBundle, recent_periods: int = 6,
                  per_segment: int = 5) -> DataFrame:
    """Context lines in order: ``by, section, line_no, text``."""
    row = digest(bundle, recent_periods, per_segment)
    parts = [_tagged(name, lines) for name, lines in
             context_sections(row, bundle.segment_types, per_segment).items()]
    return _numbered(row, bundle.by, F.concat(*parts))


def context_text(row: DataFrame, segment_types: Sequence[str], per_segment: int = 5,
                 max_chars: int = MAX_CONTEXT_CHARS) -> Column:
    """The whole context of a digest row: sections split by blank lines, bounded length."""
    sections = context_sections(row, segment_types, per_segment).values()
    texts = [F.when(F.size(lines) > 0, F.array_join(lines, "\n")) for lines in sections]
    return cut(F.concat_ws("\n\n", *texts), max_chars, TRUNCATED, strip=True)


def context_summary(bundle: MetricsBundle, recent_periods: int = 6, per_segment: int = 5,
                    max_chars: int = MAX_CONTEXT_CHARS) -> DataFrame:
    row = digest(bundle, recent_periods, per_segment)
    text = context_text(row, bundle.segment_types, per_segment, max_chars)
    return row.select(*bundle.by, text.alias("context"))


def _overall_hints(overall: Column) -> list[Column]:
    return [
        F.concat(F.lit("overall revenue around "), fixed(overall.total_revenue, 2)),
        F.concat(overall.n_transactions.cast("string"), F.lit(" transactions total")),
    ]


def report_query() -> Column:
    """Search text that describes a digest row: totals, trend months, anomaly."""
    trend, anomaly = F.col("trend"), F.col("anomaly")
    months = F.concat(F.lit("month-over-month trend for "),
                      timestamp_text(trend.current_period), F.lit(" vs "),
                      timestamp_text(trend.previous_period))
    odd_day = F.when(anomaly.status.isin("high", "low"), "recent daily revenue anomaly")
    hints = F.concat_ws("; ", *_overall_hints(F.col("overall")), months, odd_day)
    return F.concat(F.lit("transactions that best explain the following aspects of the data: "),
                    hints)


def report_filters() -> Column:
    """What the report query is about, kept next to its results (never applied)."""
    entries = F.array(
        F.struct(F.lit("current_period").alias("k"),
                 timestamp_text(F.col("trend.current_period")).alias("v")),
        F.struct(F.lit("anomaly_date").alias("k"),
                 timestamp_text(F.col("anomaly.current_date")).alias("v")))
    return F.map_from_entries(F.filter(entries, lambda e: e.v.isNotNull()))


def question_query(question: Column, overall: Column) -> Column:
    """Search text of a question, with the totals as a hint."""
    asked = F.when(F.length(question) > 0, F.btrim(question, F.lit(" \t\n\r\f\x0b")))
    return F.concat(
        F.lit("transactions that help answer the following business question: "),
        F.concat_ws("; ", asked, *_overall_hints(overall)))


def question_filters(overall: Column) -> Column:
    span = F.concat(timestamp_text(overall.date_min), F.lit(" to "),
                    timestamp_text(overall.date_max))
    entries = F.array(F.struct(F.lit("date_range").alias("k"), span.alias("v")))
    return F.map_from_entries(F.filter(entries, lambda e: e.v.isNotNull()))
