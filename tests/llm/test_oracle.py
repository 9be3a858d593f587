"""The numbered queries that SQL can give, next to DuckDB over whole tables."""

from __future__ import annotations

import pytest

from checks.compare import canonical, duck_tables
from salesloom.llm import queries
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    ours = queries.QUERIES[name](spark, SMALL)
    cursor = duck_tables(SMALL).execute(queries.ORACLE_SQL[name])
    theirs = canonical([d[0] for d in cursor.description], cursor.fetchall())
    assert sorted(ours.columns) == sorted(d[0] for d in cursor.description)
    assert canonical(ours.columns, [tuple(r) for r in ours.collect()]) == theirs and theirs
