import pytest

import __spark_entry__
from oracle import compare, connection
from vodlens.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, data, duck, name):
    compare(catalog.queries()[name](spark, data), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    df = catalog.queries()[name](spark, data)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["asof_reaction", "range_window_reaction", "nearest_event", "chat_context", "policy_audit", "interval_overlap"])
def test_no_cartesian_product(spark, data, name):
    plan = catalog.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
