import pytest
from oracle import agrees

from millrace.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, data, name):
    agrees(spark, data, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_shares_of_the_mix(spark, data):
    rows = QUERIES["p8_shares"](spark, data).collect()
    assert sum(r.actual_share for r in rows) == pytest.approx(1)
    assert all(r.most_times <= r.max_repeats for r in rows)
