"""KPI digests rendered as localized report lines.

A digest is one row per group (see ``operators.bundle.digest``). Every function here maps
that row to an array of lines, so rendering is a projection that runs wherever the rows
are; nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formatting import (currency, date_text, fill, number, percent, title_label)
from ..functions.labels import label
from ..operators.bundle import MetricsBundle, digest
from ..operators.kpi import SEGMENTS

REPORT_ITEMS = 3
TEXT_ARRAY = "array<string>"


def _say(language: str, key: str, **values: Column) -> Column:
    return fill(label(f"report.{key}", language), **values)


def _lines(*lines: Column) -> Column:
    """Array of the lines that are not NULL."""
    return F.array_compact(F.array(*lines))


def overview_lines(row: DataFrame, language: str = "en") -> Column:
    fields = row.schema["overall"].dataType.fieldNames()
    get = F.col("overall").getField
    known = get("date_min").isNotNull() & get("date_max").isNotNull()
    date_range = F.when(
        known, F.concat(date_text(get("date_min")), F.lit(" to "), date_text(get("date_max")))
    ).otherwise(_say(language, "overview.unknown_period"))
    lines = [
        _say(language, "overview.heading", date_range=date_range),
        _say(language, "overview.total_revenue", total_revenue=currency(get("total_revenue")),
             n_transactions=number(get("n_transactions"), 0)),
        F.when(get("avg_order_value").isNotNull(),
               _say(language, "overview.avg_order_value",
                    avg_order_value=currency(get("avg_order_value")))),
    ]
    if "total_cost" in fields:
        lines += [
            _say(language, "overview.cost_and_profit", total_cost=currency(get("total_cost")),
                 gross_profit=currency(get("gross_profit"))),
            F.when(get("gross_margin_pct").isNotNull(),
                   _say(language, "overview.gross_margin",
                        gross_margin_pct=percent(get("gross_margin_pct")))),
        ]
    return _lines(*lines)


def best_values(kind: str, limit: int) -> Column:
    """The ``limit`` best values of one segment type in a digest row."""
    return F.filter("segments", lambda s: (s.segment_type == kind) & (s["rank"] <= limit))


def segment_lines(segment_types: Sequence[str], language: str = "en",
                  items: int = REPORT_ITEMS) -> Column:
    """The ``items`` best values of each type; a bundle holds its ``top_n`` at most."""
    total = F.col("overall.total_revenue")

    def item(s: Column) -> Column:
        # The report relates a value to all revenue, rows without a value included.
        share = F.when(total > 0, s.revenue / total * 100.0).otherwise(s.revenue_share_pct)
        return _say(language, "segments.item_line", label=s.segment_value,
                    revenue=currency(s.revenue), order_count=s.order_count,
                    share_str=percent(share))

    paragraphs = []
    for kind in [s for s in SEGMENTS if s in segment_types]:
        best = best_values(kind, items)
        header = _say(language, "segments.top_segment_header",
                      segment_label=F.lit(title_label(kind)))
        nothing = F.array(_say(language, "segments.no_data_for_segment",
                               segment_name=F.lit(kind)))
        described = F.concat(F.array(header), F.transform(best, item))
        if paragraphs:
            paragraphs.append(F.array(F.lit("")))
        paragraphs.append(F.when(F.size(best) > 0, described).otherwise(nothing))
    if not paragraphs:
        return F.array(_say(language, "segments.no_segment_insights"))
    return F.concat(*paragraphs)


def trend_lines(language: str = "en") -> Column:
    get = F.col("trend").getField
    direction, change = get("direction"), get("absolute_change")

    def word(group: str, name: str) -> Column:
        return F.lit(label(f"report.trend.{group}.{name}", language))

    direction_word = (
        F.when(direction == "up", word("direction_word", "up"))
        .when(direction == "down", word("direction_word", "down"))
        .when(direction == "flat", word("direction_word", "flat"))
        .otherwise(word("direction_word", "changed")))
    change_word = (
        F.when(change > 0, word("change_direction", "increase"))
        .when(change < 0, word("change_direction", "decrease"))
        .otherwise(word("change_direction", "no_change")))
    known = get("current_period").isNotNull() & get("previous_period").isNotNull()
    period = F.when(known, _say(
        language, "trend.period_range", previous_period=date_text(get("previous_period")),
        current_period=date_text(get("current_period")),
    )).otherwise(_say(language, "trend.period_latest_month"))
    lines = _lines(
        _say(language, "trend.heading", period_str=period),
        _say(language, "trend.revenue_change_line", direction_word=direction_word,
             previous_revenue=currency(get("previous_revenue")),
             current_revenue=currency(get("current_revenue"))),
        F.when(change.isNotNull(), _say(
            language, "trend.change_line", change_direction=change_word,
            absolute_change=currency(change), percent_change=percent(get("percent_change")))),
    )
    return F.when(get("has_enough_data"), lines).otherwise(
        F.array(_say(language, "trend.not_enough_data")))


def anomaly_lines(language: str = "en") -> Column:
    get = F.col("anomaly").getField
    verdict = F.when(get("status") == "high", _say(language, "anomaly.status.high"))
    verdict = verdict.when(get("status") == "low", _say(language, "anomaly.status.low"))
    lines = _lines(
        _say(language, "anomaly.heading", date=date_text(get("current_date"))),
        _say(language, "anomaly.line_revenue_vs_avg",
             current_revenue=currency(get("current_revenue")),
             mean=currency(get("history_mean")), std=currency(get("history_std"))),
        F.when(get("z_score").isNotNull(),
               _say(language, "anomaly.line_zscore", z_score=number(get("z_score")))),
        verdict.otherwise(_say(language, "anomaly.status.normal")),
    )
    return F.when(get("has_enough_history"), lines).otherwise(
        F.array(_say(language, "anomaly.not_enough_history")))


# Section names and the rule under each section heading.
SECTION_RULES = {
    "overview": "-----------",
    "segments": "---------------------",
    "trend": "-----------------",
    "anomaly": "----------------------",
}


def section_lines(row: DataFrame, segment_types: Sequence[str],
                  language: str = "en", items: int = REPORT_ITEMS) -> dict[str, Column]:
    return {
        "overview": overview_lines(row, language),
        "segments": segment_lines(segment_types, language, items),
        "trend": trend_lines(language),
        "anomaly": anomaly_lines(language),
    }


def _tagged(section: str, lines: Column) -> Column:
    return F.transform(lines.cast(TEXT_ARRAY),
                       lambda t: F.struct(F.lit(section).alias("section"), t.alias("text")))


def _numbered(row: DataFrame, by: Sequence[str], lines: Column) -> DataFrame:
    out = row.select(*by, F.posexplode(lines).alias("at", "line"))
    return out.select(*by, F.col("line.section").alias("section"),
                      (F.col("at") + 1).alias("line_no"), F.col("line.text").alias("text"))


def report_section(bundle: MetricsBundle, section: str, language: str = "en",
                   items: int = REPORT_ITEMS) -> DataFrame:
    """Lines of one section: ``by, section, line_no, text``."""
    row = digest(bundle)
    lines = section_lines(row, bundle.segment_types, language, items)[section]
    return _numbered(row, bundle.by, _tagged(section, lines))


def report_array(row: DataFrame, segment_types: Sequence[str], language: str = "en",
                 items: int = REPORT_ITEMS) -> Column:
    """The full report of a digest row as ``array<struct<section, text>>``."""
    blank = F.array(F.lit(""))
    parts = [_tagged("title", F.array(F.lit(label("report.title", language)),
                                      F.lit(label("report.underline", language))))]
    for section, lines in section_lines(row, segment_types, language, items).items():
        heading = F.array(F.lit(label(f"report.section.{section}", language)),
                          F.lit(SECTION_RULES[section]))
        parts.append(_tagged(section, F.concat(blank, heading, lines)))
    return F.concat(*parts)


def full_report(bundle: MetricsBundle, language: str = "en",
                items: int = REPORT_ITEMS) -> DataFrame:
    """All report lines in order: ``by, section, line_no, text``."""
    row = digest(bundle)
    return _numbered(row, bundle.by, report_array(row, bundle.segment_types, language, items))


def report_text_column(row: DataFrame, segment_types: Sequence[str],
                       language: str = "en", items: int = REPORT_ITEMS) -> Column:
    lines = report_array(row, segment_types, language, items)
    return F.array_join(F.transform(lines, lambda x: x.text), "\n")


def report_text(bundle: MetricsBundle, language: str = "en",
                items: int = REPORT_ITEMS) -> DataFrame:
    """The whole report as one text per group."""
    row = digest(bundle)
    return row.select(*bundle.by,
                      report_text_column(row, bundle.segment_types, language, items).alias("report"))
