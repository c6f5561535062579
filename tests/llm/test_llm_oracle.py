import pytest

from prefscale.llm import queries
from tests.compare import DATA, connection, same_rows


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, DATA).toPandas(), connection().sql(queries.SQL[name]).df())


def test_all_are_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
