import pytest

import __spark_entry__ as entry
from compare import connection, rows
from tessera.plans import problems, reference_queries

CORE = {**reference_queries.QUERIES, **problems.QUERIES}
SQL = {**reference_queries.ORACLE, **problems.ORACLE}


@pytest.fixture(scope="module")
def duck(small):
    return connection(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, small, duck, name):
    assert rows(CORE[name](spark, small).toPandas()) == rows(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_query_without_sql_runs(spark, small, name):
    assert CORE[name](spark, small).count() > 0


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(CORE) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_retrieval_plan_prunes_columns_and_joins_no_cartesian(spark, small):
    plan = CORE["tiered_retrieval"](spark, small)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    plan = CORE["failure_rates"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "postcode_area" not in plan
