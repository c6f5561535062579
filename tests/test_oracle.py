import pytest

from prefscale.jobs import registry
from tests.compare import DATA, connection, same_rows


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, con, name):
    same_rows(registry.QUERIES[name](spark, DATA).toPandas(), con.sql(registry.SQL[name]).df())


def test_entry_has_every_query(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
