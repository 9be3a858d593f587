"""Report labels in English and Indonesian.

A dotted key is looked up in the asked language, then in English; an unknown key is
returned as it is, so that a missing label stays visible.
"""

from __future__ import annotations

FALLBACK = "en"

# Report texts.
LABELS: dict[str, dict[str, str]] = {
    "en": {
        "report.title": "FINANCIAL INSIGHT REPORT",
        "report.underline": "========================",
        "report.section.overview": "1. Overview",
        "report.section.segments": "2. Segment Highlights",
        "report.section.trend": "3. Trend Analysis",
        "report.section.anomaly": "4. Daily Anomaly Check",
        "report.overview.unknown_period": "an unknown period",
        "report.overview.heading": "Overview for {date_range}:",
        "report.overview.total_revenue":
            "- Total revenue was {total_revenue} across {n_transactions} transactions.",
        "report.overview.avg_order_value": "- The average order value was {avg_order_value}.",
        "report.overview.cost_and_profit":
            "- Total cost was {total_cost}, resulting in gross profit of {gross_profit}.",
        "report.overview.gross_margin": "- Gross margin was {gross_margin_pct}.",
        "report.segments.no_data_for_segment": "No data available for {segment_name}.",
        "report.segments.top_segment_header": "Top {segment_label}:",
        "report.segments.item_line":
            "- {label}: {revenue} across {order_count} orders (approx. {share_str} of revenue).",
        "report.segments.no_segment_insights":
            "No segment-level insights available (no segment columns found).",
        "report.trend.not_enough_data":
            "There is not enough data to compute a reliable month-over-month trend.",
        "report.trend.heading": "Month-over-month trend ({period_str}):",
        "report.trend.period_latest_month": "the latest month",
        "report.trend.period_range": "{previous_period} to {current_period}",
        "report.trend.revenue_change_line":
            "- Revenue {direction_word} from {previous_revenue} to {current_revenue}.",
        "report.trend.change_line":
            "- This represents {change_direction} of {absolute_change} ({percent_change}).",
        "report.trend.direction_word.up": "increased",
        "report.trend.direction_word.down": "decreased",
        "report.trend.direction_word.flat": "remained roughly flat",
        "report.trend.direction_word.changed": "changed",
        "report.trend.change_direction.increase": "an increase",
        "report.trend.change_direction.decrease": "a decrease",
        "report.trend.change_direction.no_change": "no change",
        "report.anomaly.not_enough_history":
            "There is not enough recent daily history to perform anomaly detection.",
        "report.anomaly.heading": "Daily anomaly check for {date}:",
        "report.anomaly.line_revenue_vs_avg":
            "- Revenue was {current_revenue} compared to a recent average of {mean} "
            "(std dev {std}).",
        "report.anomaly.line_zscore": "- The z-score for this day is {z_score}.",
        "report.anomaly.status.high":
            "- This day appears unusually strong compared to recent history.",
        "report.anomaly.status.low":
            "- This day appears unusually weak compared to recent history.",
        "report.anomaly.status.normal": "- This day looks normal relative to recent history.",
    },
    "id": {
        "report.title": "LAPORAN INSIGHT KEUANGAN",
        "report.underline": "========================",
        "report.section.overview": "1. Gambaran Umum",
        "report.section.segments": "2. Sorotan Segmen",
        "report.section.trend": "3. Analisis Tren",
        "report.section.anomaly": "4. Pemeriksaan Anomali Harian",
        "report.overview.unknown_period": "periode yang tidak diketahui",
        "report.overview.heading": "Gambaran umum untuk {date_range}:",
        "report.overview.total_revenue":
            "- Total pendapatan sebesar {total_revenue} dari {n_transactions} transaksi.",
        "report.overview.avg_order_value":
            "- Nilai rata-rata pesanan sebesar {avg_order_value}.",
        "report.overview.cost_and_profit":
            "- Total biaya sebesar {total_cost}, menghasilkan laba kotor sebesar {gross_profit}.",
        "report.overview.gross_margin": "- Margin kotor sebesar {gross_margin_pct}.",
        "report.segments.no_data_for_segment":
            "Tidak ada data yang tersedia untuk {segment_name}.",
        "report.segments.top_segment_header": "Segmen {segment_label} teratas:",
        "report.segments.item_line":
            "- {label}: {revenue} dari {order_count} pesanan (sekitar {share_str} dari "
            "pendapatan).",
        "report.segments.no_segment_insights":
            "Tidak ada insight tingkat segmen (tidak ada kolom segmen yang ditemukan).",
        "report.trend.not_enough_data":
            "Data tidak cukup untuk menghitung tren pendapatan bulan-ke-bulan yang andal.",
        "report.trend.heading": "Tren bulan-ke-bulan ({period_str}):",
        "report.trend.period_latest_month": "bulan terbaru",
        "report.trend.period_range": "{previous_period} hingga {current_period}",
        "report.trend.revenue_change_line":
            "- Pendapatan {direction_word} dari {previous_revenue} menjadi {current_revenue}.",
        "report.trend.change_line":
            "- Ini menunjukkan {change_direction} sebesar {absolute_change} ({percent_change}).",
        "report.trend.direction_word.up": "meningkat",
        "report.trend.direction_word.down": "menurun",
        "report.trend.direction_word.flat": "relatif stabil",
        "report.trend.direction_word.changed": "berubah",
        "report.trend.change_direction.increase": "kenaikan",
        "report.trend.change_direction.decrease": "penurunan",
        "report.trend.change_direction.no_change": "tidak ada perubahan signifikan",
        "report.anomaly.not_enough_history":
            "Riwayat harian terbaru tidak cukup untuk melakukan deteksi anomali.",
        "report.anomaly.heading": "Pemeriksaan anomali harian untuk {date}:",
        "report.anomaly.line_revenue_vs_avg":
            "- Pendapatan sebesar {current_revenue} dibandingkan rata-rata terbaru {mean} "
            "(deviasi standar {std}).",
        "report.anomaly.line_zscore": "- Skor-z untuk hari ini adalah {z_score}.",
        "report.anomaly.status.high":
            "- Hari ini tampak jauh lebih kuat dibandingkan riwayat terbaru.",
        "report.anomaly.status.low":
            "- Hari ini tampak jauh lebih lemah dibandingkan riwayat terbaru.",
        "report.anomaly.status.normal":
            "- Hari ini terlihat normal dibandingkan riwayat terbaru.",
    },
}


def label(key: str, language: str | None = None) -> str:
    """Template text of ``key``: asked language, then English, then the key itself."""
    chosen = LABELS.get((language or FALLBACK).lower(), {})
    return chosen.get(key, LABELS[FALLBACK].get(key, key))
