"""Every registered query against its SQL twin, on the smallest tables; and what no plan of
any of them may contain."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import differences, duck_tables
from checks.oracle import ORACLE_SQL
from checks.queries import QUERIES
from tests.conftest import SMALL


# Queries that score vectors; Python runs nowhere else.
SEARCHES = {"similar_topk", "similar_topk_l2", "report_retrieval", "report_prompts",
            "report_prompts_hybrid_id", "question_prompts"} | {
    q for q in QUERIES if q.startswith(("retriev", "search", "rag_context"))}


@pytest.fixture(scope="module")
def connection():
    return duck_tables(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(queries()) and set(ORACLE_SQL) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_result(spark, connection, name):
    def inspect(df):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
        python = re.findall(r"MapIn\w+|ArrowEval\w*|BatchEval\w*|FlatMap\w*", text)
        assert set(python) <= ({"MapInArrow"} if name in SEARCHES else set())

    found, rows = differences(spark, connection, SMALL, name, inspect)
    assert found == [] and rows > 0


def test_entry(spark):
    assert entry(spark).count() > 0
