"""Every registered query against its SQL, as the driver compares them."""

import pytest

from lamella.plans import ORACLE_SQL, QUERIES
from lamella.plans.compare import differences


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, small, key):
    assert differences(QUERIES[key](spark, small), ORACLE_SQL[key], small) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["image_id", "n_raw", "n_band", "n_kept"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
