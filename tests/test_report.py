from __future__ import annotations

import pytest

from salesloom.operators.bundle import build_metrics_bundle, digest, metrics_long
from salesloom.plans import context, prompts, report
from salesloom.sources import files

COLUMNS = "date string, amount double, cost double, category string, customer_id string"
ROWS = [("2024-01-10", 1200000.0, 700000.0, "Electronics", "c1"),
        ("2024-01-20", 80000.0, 50000.0, "Groceries", "c2"),
        ("2024-02-10 09:30:00", 500000.5, 250000.0, None, "c1")]

EN = """FINANCIAL INSIGHT REPORT
========================

1. Overview
-----------
Overview for 2024-01-10 to 2024-02-10:
- Total revenue was Rp1.780.000 across 3 transactions.
- The average order value was Rp593.334.
- Total cost was Rp1.000.000, resulting in gross profit of Rp780.000.
- Gross margin was 43.82%.

2. Segment Highlights
---------------------
Top Category:
- Electronics: Rp1.200.000 across 1 orders (approx. 67.42% of revenue).
- Groceries: Rp80.000 across 1 orders (approx. 4.49% of revenue).

Top Customer Id:
- c1: Rp1.700.000 across 2 orders (approx. 95.51% of revenue).
- c2: Rp80.000 across 1 orders (approx. 4.49% of revenue).

3. Trend Analysis
-----------------
Month-over-month trend (2024-01-31 to 2024-02-29):
- Revenue decreased from Rp1.280.000 to Rp500.000.
- This represents a decrease of Rp-780.000 (-60.94%).

4. Daily Anomaly Check
----------------------
Daily anomaly check for 2024-02-10:
- Revenue was Rp500.000 compared to a recent average of Rp2.667 (std dev Rp14.360).
- The z-score for this day is 34.63.
- This day appears unusually strong compared to recent history."""


@pytest.fixture
def bundle(sales_frame):
    with build_metrics_bundle(sales_frame(ROWS, COLUMNS)) as found:
        yield found


def test_full_report(bundle):
    assert report.report_text(bundle).first().report == EN
    lines = report.full_report(bundle).orderBy("line_no").collect()
    assert "\n".join(r.text for r in lines) == EN
    assert [r.line_no for r in lines] == list(range(1, len(lines) + 1))


def test_indonesian_report(bundle):
    text = report.report_text(bundle, "id").first().report
    assert text.startswith("LAPORAN INSIGHT KEUANGAN\n")
    assert "- Total pendapatan sebesar Rp1.780.000 dari 3 transaksi." in text
    assert "Gambaran umum untuk 2024-01-10 to 2024-02-10:" in text
    assert "(2024-01-31 hingga 2024-02-29)" in text


def test_report_of_nothing(sales_frame):
    with build_metrics_bundle(sales_frame([], COLUMNS)) as empty:
        text = report.report_text(empty).first().report
        summary = context.context_summary(empty).first().context
    assert "Overview for an unknown period:" in text
    assert "average order value" not in text and "Gross margin" not in text
    assert "No data available for category." in text
    assert "There is not enough data to compute" in text
    assert "There is not enough recent daily history" in text
    assert "[Revenue time series" not in summary and "Direction: insufficient_data" in summary


def test_report_without_segments_and_cost(sales_frame):
    with build_metrics_bundle(sales_frame([("2024-01-10", 5.0)])) as plain:
        text = report.report_text(plain).first().report
        summary = context.context_summary(plain).first().context
    assert "No segment-level insights available (no segment columns found)." in text
    assert "Total cost" not in text
    assert "[Top segments]" not in summary
    assert "period | revenue\n------ | -------\n2024-01-31 | 5.00" in summary


def test_report_sink(bundle, spark, tmp_path):
    files.write_report(report.full_report(bundle), str(tmp_path / "report"))
    parts = list((tmp_path / "report").glob("*.txt"))
    assert len(parts) == 1 and parts[0].read_text() == EN + "\n"


def test_metrics_sink(bundle, spark, tmp_path):
    files.write_metrics(metrics_long(bundle), str(tmp_path / "metrics"))
    back = spark.read.json(str(tmp_path / "metrics"))
    cell = back.where("section = 'segments' AND segment_value = 'c1' AND metric = 'revenue'")
    assert cell.first().value == 1700000.5


def test_context(bundle):
    text = context.context_summary(bundle).first().context
    assert text.startswith("[Overall metrics]\n- Total revenue: 1,780,000.50\n")
    assert "- Number of transactions: 3.00" in text
    assert "- Date range: 2024-01-10 00:00:00 to 2024-02-10 09:30:00" in text
    assert "  • category='Electronics', revenue=1,200,000.00, share=93.8%" in text
    assert "- Current period: 2024-02-29 00:00:00\n- Current revenue: 500000.5" in text
    assert "- Status: high" in text
    assert len(text.split("\n\n")) == 5


def test_context_is_cut(bundle):
    whole = context.context_summary(bundle).first().context
    cut = context.context_summary(bundle, max_chars=33).first().context
    assert cut == whole[:33].rstrip() + "\n\n[Context truncated for length]"


def test_context_shows_the_last_periods(sales_frame):
    rows = [(f"2023-{m:02d}-01", float(m)) for m in range(1, 13)]
    with build_metrics_bundle(sales_frame(rows)) as found:
        lines = context.context_lines(found, recent_periods=6).collect()
        series = [r.text for r in lines if r.section == "time_series"]
        assert len(series) == 3 + 6 and series[3].startswith("2023-07-31")
        assert digest(found, recent_periods=2).first().recent[0].revenue == 11.0


def test_report_prompt(bundle):
    row = prompts.report_prompts(bundle, "id", hybrid=True).first()
    assert row.system_prompt.startswith("Anda adalah asisten analis keuangan")
    assert "Structured metrics summary:\n[Overall metrics]" in row.user_prompt
    assert row.user_prompt.endswith("dibandingkan riwayat terbaru.")
    short = prompts.report_prompts(bundle, max_chars=50).first().user_prompt
    assert short.endswith("\n\n[Context truncated for length]") and len(short) < 100


def test_question_prompt(bundle, spark):
    questions = spark.createDataFrame([(1, "  What sold best?\n")], "q int, question string")
    text = prompts.question_prompts(questions, bundle, ["q"]).first().user_prompt
    assert text.endswith("User question:\nWhat sold best?")
    assert "- trend: trend in revenue over time" in text
    one = prompts.question_prompts(questions, bundle, ["q"], commands=["trend", "other"])
    assert "\n- trend: trend in revenue over time\n- other\n\n" in one.first().user_prompt
    none = prompts.question_prompts(questions, bundle, ["q"], commands=[], language="id")
    assert "Perintah CLI" not in none.first().user_prompt.split("Structured")[0].split("\n\n")[1]
    assert none.first().user_prompt.endswith("Pertanyaan pengguna:\nWhat sold best?")


def test_grouped_reports(sales_frame):
    rows = [(d, a, c, k, "n" if i % 2 else "s") for i, (d, a, c, k, _) in enumerate(ROWS * 2)]
    tx = sales_frame(rows, COLUMNS.replace("customer_id", "region"))
    with build_metrics_bundle(tx, by=["region"]) as found:
        texts = {r.region: r.report for r in report.report_text(found).collect()}
    for region, text in texts.items():
        with build_metrics_bundle(tx.where(tx.region == region).drop("region")) as alone:
            assert report.report_text(alone).first().report == text


def test_grouped_report_sink(sales_frame, tmp_path):
    rows = [(d, a, c, k, "n" if i % 2 else "s") for i, (d, a, c, k, _) in enumerate(ROWS * 2)]
    tx = sales_frame(rows, COLUMNS.replace("customer_id", "region"))
    with build_metrics_bundle(tx, by=["region"]) as found:
        files.write_report(report.full_report(found), str(tmp_path / "r"), ["region"])
        expected = {r.region: r.report for r in report.report_text(found).collect()}
    for region, text in expected.items():
        parts = list((tmp_path / "r" / f"region={region}").glob("*.txt"))
        assert [p.read_text() for p in parts] == [text + "\n"]


def test_report_shows_no_more_than_the_bundle_keeps(sales_frame):
    rows = [("2024-01-10", float(i), f"c{i}") for i in range(1, 8)]
    columns = "date string, amount double, category string"
    for top_n, shown, listed in ((1, 1, 1), (4, 3, 4), (None, 3, 5)):
        with build_metrics_bundle(sales_frame(rows, columns), top_n=top_n) as found:
            assert found.segments.count() == (top_n or 7)
            text = report.report_text(found).first().report
            assert text.count(" orders (approx.") == shown
            assert context.context_summary(found).first().context.count("• category=") == listed
