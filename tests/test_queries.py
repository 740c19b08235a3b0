"""Every query with SQL gives the rows of its SQL; every other one gives rows."""

import pytest
from oracle import compare

from quillon import load_queries, queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf, name):
    compare(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_rows(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
