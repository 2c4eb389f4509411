from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators.skew import key_counts, key_states, skew_join

CLASH = "pid int, seq int, rows int, items int, spread int, slot int, cuts int, row_hash int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7, 8) for r in rows], "k bigint, i bigint, " + CLASH)


def want(rows):
    n, items = Counter(k for k, _ in rows), {}
    for k, i in rows:
        items.setdefault(k, set()).add(i)
    return {k: (n[k], len(items[k] - {None})) for k in n}


def test_counts_with_heavy_keys_nulls_and_copies(spark):
    rows = [(1, k % 400) for k in range(1500)] + [(2, 7)] * 800 + [(None, k) for k in range(50)] + [(3, None)] * 5 + [(k, k) for k in range(10, 60)]
    got = {r.key: (r.n_rows, r.n_items) for r in key_counts(frame(spark, rows), "k", "i", partitions=8).collect()}
    assert got == want(rows)


def test_heavy_key_is_split_even_if_all_copies(spark):
    states = key_states(frame(spark, [(2, 7)] * 4000), "k", "i", partitions=8).where("key = 2").collect()
    assert len(states) > 3
    assert max(s.rows for s in states) < 3000


def test_counts_of_nothing(spark):
    assert key_counts(frame(spark, []), "k", "i").count() == 0


def test_join_equals_plain_join(spark):
    left = frame(spark, [(1, k) for k in range(3000)] + [(2, 7)] * 500 + [(None, 1), (99, 2)] + [(k, k) for k in range(10, 40)])
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (15, None), (None, "n")], "k bigint, slot string")
    for how in ("inner", "left"):
        got = skew_join(left, right, "k", "k", how, slots=6)
        assert got.columns == [*left.columns, "k_1", "slot_1"]
        plain = left.join(right.toDF("k_1", "slot_1"), F.col("k") == F.col("k_1"), how)
        assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0
    assert skew_join(left.limit(0), right, "k", "k", "left").count() == 0
    assert skew_join(left, right.limit(0), "k", "k", "left").count() == left.count()


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_every_kind_of_join_is_that_of_the_engine(spark, how):
    left = spark.createDataFrame([(7 if k % 3 else k % 50, k) for k in range(900)] + [(None, 1), (None, 2)], "k int, v int")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(40, 60)] + [(7, "a"), (7, "b"), (None, "n")], "k int, w string")
    got = skew_join(left, right, "k", "k", how, slots=6)
    want = left.join(right.withColumnRenamed("k", "k_1"), F.col("k") == F.col("k_1"), how)
    assert got.columns == ["k", "v", "k_1", "w"] and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
