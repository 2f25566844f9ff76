"""Every core query against its SQL on the smallest tables, and the rest for rows."""

import pytest

from siltstone.plans import core_queries, index_queries

from .helpers import same_as_sql

QUERIES = core_queries.QUERIES | index_queries.QUERIES
SQL = core_queries.SQL | index_queries.SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, sql, name):
    df = QUERIES[name](spark, small)
    if name in SQL:
        same_as_sql(df, sql, SQL[name])
    else:
        assert df.count() > 0


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"p1_found", "p4_found"} <= set(e.queries())
