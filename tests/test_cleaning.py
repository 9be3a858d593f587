from __future__ import annotations

import pytest

from salesloom.operators import cleaning
from salesloom.plans.prepare import load_and_clean
from salesloom.sources import files

CSV = '''order_date,total_price,cost,category,product_name,customer_id,note
2024-01-05,10.5,4,Toys,"Ball, red",001,a
2024-1-6, 12 ,abc,NA,Car,002,b
2024-02-30,7,1,Toys,Car,003,c
,8,1,Toys,Car,004,d
2024-01-07,"1,234",1,Toys,Car,005,e
2024-01-08,,1,Toys,Car,006,f
2024-01-09,1d,1,Toys,"He said ""hi""",007,g
2024-01-10,inf,,Toys,Car,008,h
'''


@pytest.fixture
def raw(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(CSV)
    return files.read_transactions(spark, str(tmp_path / "raw.csv"))


def test_read_keeps_text_and_nulls_missing_tokens(raw):
    assert {kind for _, kind in raw.dtypes} == {"string"}
    rows = {r.customer_id: r for r in raw.collect()}
    assert rows["002"].category is None and rows["004"].order_date is None
    assert rows["001"].product_name == "Ball, red" and rows["007"].product_name == 'He said "hi"'


def test_validation_counts_only_new_missing_values(raw):
    report = cleaning.validation_report(raw).first()
    assert report.asDict() == {
        "n_rows": 8, "n_columns": 7, "missing_required_columns": [], "invalid_dates": 1,
        "invalid_amounts": 2, "invalid_costs": 1}
    no_cost = cleaning.validation_report(raw, {"date": "order_date", "amount": "total_price"})
    assert no_cost.first().invalid_costs == 0


def test_clean_keeps_rows_with_date_and_amount(raw):
    clean = cleaning.clean_transactions(raw)
    assert clean.columns == ["date", "amount", "cost", "category", "product", "customer_id",
                             "note"]
    rows = sorted((r.customer_id, r.amount, r.cost) for r in clean.collect())
    assert rows == [("001", 10.5, 4.0), ("002", 12.0, None), ("008", float("inf"), None)]
    summary = cleaning.cleaning_summary(raw).first().asDict()
    assert summary == {"original_rows": 8, "clean_rows": 3, "dropped_rows": 5,
                       "date_min": "2024-01-05T00:00:00", "date_max": "2024-01-10T00:00:00"}


def test_nothing_left(raw):
    summary = cleaning.cleaning_summary(raw.where("customer_id = '003'")).first()
    assert (summary.clean_rows, summary.date_min, summary.date_max) == (0, None, None)


def test_missing_required_columns_are_named(raw):
    with pytest.raises(ValueError, match="when, price"):
        cleaning.clean_transactions(raw, {"date": "when", "amount": "price"})


def test_dates_can_stay_as_they_are(raw):
    assert dict(cleaning.clean_transactions(raw, parse_dates=False).dtypes)["date"] == "string"


def test_unknown_sources(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_transactions(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="xlsx"):
        files.read_transactions(spark, str(tmp_path / "book.xlsx"))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
@pytest.mark.parametrize("by_month", [False, True])
def test_clean_sink(spark, raw, tmp_path, fmt, by_month):
    clean = cleaning.clean_transactions(raw)
    files.write_clean(clean, str(tmp_path / "clean"), fmt, by_month)
    back = spark.read.option("header", True).format(fmt).load(str(tmp_path / "clean"))
    assert back.count() == 3
    assert ("month" in back.columns) == by_month


def test_multiline_fields_and_preview(spark, tmp_path):
    (tmp_path / "m.csv").write_text('order_date,total_price,note\n2024-01-05,1,"two\nlines"\n')
    raw = files.read_transactions(spark, str(tmp_path / "m.csv"), multiline=True)
    assert raw.first().note == "two\nlines"
    assert files.preview(raw, 5).count() == 1


@pytest.mark.parametrize("fmt", [None, "parquet", "csv"])
def test_load_and_clean(spark, tmp_path, fmt):
    (tmp_path / "raw.csv").write_text(CSV)
    save_path = str(tmp_path / "out") if fmt else None
    clean, report = load_and_clean(spark, str(tmp_path / "raw.csv"), save_path=save_path,
                                   save_format=fmt or "parquet")
    assert clean.count() == 3 and dict(clean.dtypes)["date"] == "timestamp_ntz"
    assert (tmp_path / "out").exists() == bool(fmt)
    row = report.first()
    assert row.validation.invalid_amounts == 2 and row.validation.n_columns == 7
    assert row.cleaning.dropped_rows == 5 and row.cleaning.date_max == "2024-01-10T00:00:00"
