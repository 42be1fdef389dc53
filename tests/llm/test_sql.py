import pytest

from compare import connection, rows
from tessera.llm import queries as Q


@pytest.fixture(scope="module")
def duck(small):
    return connection(small)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_against_sql(spark, small, duck, name):
    assert rows(Q.QUERIES[name](spark, small).toPandas()) == rows(duck.sql(Q.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_query_without_sql_runs(spark, small, name):
    assert Q.QUERIES[name](spark, small).count() > 0
