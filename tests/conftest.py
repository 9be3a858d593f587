from __future__ import annotations

import pytest

from salesloom.session import build_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4",
                            spark__ui__enabled="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def no_leftover_cache(spark):
    yield
    spark.catalog.clearCache()


@pytest.fixture
def sales_frame(spark):
    """Build a transaction table from ``(date text, amount, {other columns})`` rows."""
    def build(rows, columns="date string, amount double"):
        frame = spark.createDataFrame(rows, columns)
        return frame.withColumn("date", frame.date.cast("timestamp_ntz"))
    return build
