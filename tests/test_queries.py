"""Every registered query against its SQL."""

import __spark_entry__ as e
import pytest
from compare import connect, differences

from foldcast.catalog import oracle, registry

SQL = oracle.oracle_sql()
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, folder, con):
    assert differences(spark, folder, QUERIES[name], SQL[name], con) is None


def test_entry(spark):
    assert e.entry(spark).columns == ["series_id", "dt", "pred", "true"]
