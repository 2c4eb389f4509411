"""Queries that must see every row of their table."""

import math

import pytest
from oracle import agrees, connect

from millrace.plans.collections import QUERIES, SQL


def test_product_takes_all_rows(spark, data, tmp_path):
    agrees(spark, data, QUERIES["product_whole"], SQL["product_whole"])
    discounts = [r[0] for r in connect(data).execute("select l_discount from lineitem").fetchall()]
    got = QUERIES["product_whole"](spark, data).first().p
    assert got == pytest.approx(math.prod((1 + d) ** (100 / len(discounts)) for d in discounts), abs=1e-5) and got > 100
    spark.read.parquet(f"{data}/lineitem.parquet").limit(0).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert QUERIES["product_whole"](spark, str(tmp_path)).first().p == 1


def test_cogroup_takes_all_customers_and_unmatched_keys(spark, data):
    for name in ("cogroup_whole", "cogroup_unmatched"):
        agrees(spark, data, QUERIES[name], SQL[name])
    assert sum(r.left for r in QUERIES["cogroup_whole"](spark, data).collect()) == connect(data).execute("select count(*) from customer").fetchone()[0]
    got = QUERIES["cogroup_unmatched"](spark, data).collect()
    assert any(r.left == 0 for r in got) and any(r.right == 0 for r in got) and any(r.left and r.right for r in got)
