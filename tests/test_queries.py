import pytest
from oracle import agrees

from millrace.plans import algebra, collections, inputs_outputs, pipeline

QUERIES = {**collections.QUERIES, **algebra.QUERIES, **inputs_outputs.QUERIES, **pipeline.QUERIES}
SQL = {**collections.SQL, **algebra.SQL, **inputs_outputs.SQL, **pipeline.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, data, name):
    agrees(spark, data, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
