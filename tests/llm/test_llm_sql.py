"""The queries that have DuckDB SQL against it."""

import pytest

from lamella.llm.oracle import ORACLE_SQL
from lamella.llm.queries import QUERIES
from lamella.plans.compare import differences


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, small, key):
    assert differences(QUERIES[key](spark, small), ORACLE_SQL[key], small) == ""
