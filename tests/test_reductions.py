import functools
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import reductions as red

whole = st.integers(-1000, 1000)
VALUES = {
    "sum": whole, "digit sum": st.integers(0, 9), "product": whole, "exact product": whole, "digit product": st.integers(0, 9), "minimum": whole, "maximum": whole, "count": whole,
    "decimal sum": st.decimals(-1000, 1000, places=3), "first": whole, "last": whole, "first option": st.none() | whole, "last option": st.none() | whole, "or": st.booleans(), "and": st.booleans(),
    "string": st.text(max_size=5), "list": st.lists(whole, max_size=4), "set": st.frozensets(whole, max_size=4), "sorted set": st.lists(whole, max_size=4).map(lambda x: tuple(sorted(set(x)))), "map": st.dictionaries(whole, whole, max_size=4),
    "unit": st.none(), "comparison": st.sampled_from([-1, 0, 1]),
}


@pytest.mark.parametrize("name", sorted(VALUES))
@settings(max_examples=40, deadline=None)
@given(draw=st.data())
def test_associative(name, draw):
    v = VALUES[name]
    r = red.ALL[name]
    a, b, c = draw.draw(v), draw.draw(v), draw.draw(v)
    assert r.associative(a, b, c)
    assert r.dual().associative(a, b, c)
    assert r.zip(red.SUM).associative((a, 1), (b, 2), (c, 3))
    assert r.option().associative(None, b, c)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["left", "right"]), whole), min_size=3, max_size=3), st.integers())
def test_combinators_are_associative(tagged, x):
    for r in (red.SUM.left(red.MAXIMUM), red.SUM.right(red.MAXIMUM)):
        assert r.associative(*tagged)
    assert red.SUM.validation(red.MAXIMUM).associative(*[("ok" if t == "left" else "error", v) for t, v in tagged])
    fs = [lambda y, k=k: y * (k + 2) + k for k in range(3)]
    assert red.ENDO.associative(*fs, by=lambda f: f(x))
    assert red.SUM.pointwise().associative(*fs, by=lambda f: f(x))
    steps = [lambda s, k=k: (s + k, s * k) for k in range(3)]
    assert red.SUM.state().associative(*steps, by=lambda f: f(x))
    assert red.SUM.writer(red.STRING).associative(("a", 1), ("b", 2), ("c", 3))
    assert red.SUM.store().associative(*[(f, k) for k, f in enumerate(fs)], by=lambda p: (p[0](x), p[1]))
    compare = [lambda a, b: (a % 3 > b % 3) - (a % 3 < b % 3), lambda a, b: (a % 2 > b % 2) - (a % 2 < b % 2), lambda a, b: (a > b) - (a < b)]
    assert red.ORDERING.associative(*compare, by=lambda f: f(x, 5))
    wrapped = red.SUM.lift(lambda op, a, b: [op(p, q) for p in a for q in b])
    assert wrapped.associative([1, 2], [3], [4, 5])


def test_small_ones():
    assert red.SUM.pair()(4) == 8 and (~red.FIRST)(1, 2) == 2
    assert red.split1(len)([1, 2], "x") == 2 and red.split2(len)([1, 2], "x") == 1
    assert red.constant(7)(1, 2) == 7
    assert red.SUM.map_in(len)("ab", "c") == 3
    assert red.SUM.biject(Decimal, int)(1, 2) == 3
    assert red.SUM.map_out(str)(1, 2) == "3"
    assert red.SUM.fold([]) == 0
    with pytest.raises(ValueError):
        red.MINIMUM.fold([])
    assert functools.reduce(red.MAP, [{1: 2}, {1: 3, 4: 5}]) == {1: 3, 4: 5}


@pytest.mark.parametrize("values", [[3, 1, 2, 2], [7], [], [None, 4], [9, 5, 2, 8, 6]])
def test_column_forms_agree_with_operations(spark, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "o int, v bigint")
    there = [v for v in values if v is not None]
    row = df.agg(
        red.SUM.of("v").alias("s"), red.PRODUCT.of("v").alias("p"), red.SUM_DIGIT.of("v").alias("sd"), red.PRODUCT_DIGIT.of(F.coalesce("v", F.lit(1))).alias("pd"), red.MINIMUM.of("v").alias("lo"), red.MAXIMUM.of("v").alias("hi"),
        red.FIRST_OPTION.of("v", "o").alias("f"), red.LAST_OPTION.of("v", "o").alias("l"), red.COUNT.of("v").alias("n"), red.AND.of(F.col("v") > 1).alias("a"), red.OR.of(F.col("v") > 6).alias("r"), red.STRING.of(F.col("v").cast("string"), "o").alias("t"),
    ).first()
    assert row.s == red.SUM.fold(there) and row.p == red.PRODUCT.fold(there) and row.sd == red.SUM_DIGIT.fold(there) % 10 and row.pd == red.PRODUCT_DIGIT.fold(there) % 10
    assert (row.lo, row.hi) == ((min(there), max(there)) if there else (None, None))
    assert (row.f, row.l, row.n) == (there[0] if there else None, there[-1] if there else None, len(there))
    assert (row.a, row.r) == (all(v > 1 for v in there), any(v > 6 for v in there))
    assert row.t == "".join(map(str, there))


def test_collections(spark):
    df = spark.createDataFrame([(2, ["b", "a"], {"x": 1}), (1, ["a", "c"], {"x": 5, "y": 2}), (3, None, None)], "o int, a array<string>, m map<string,int>")
    row = df.agg(red.LIST.of("a", "o").alias("l"), red.SORTED_SET.of("a").alias("s"), red.MAP.of("m", "o").alias("m"), red.LIST.dual().of("a", "o").alias("d")).first()
    assert (row.l, row.s, row.m, row.d) == (["a", "c", "b", "a"], ["a", "b", "c"], {"x": 1, "y": 2}, ["b", "a", "a", "c"])


def test_biased_columns(spark):
    df = spark.createDataFrame([(1, (5, None)), (1, (None, 9)), (2, (None, 4)), (2, (None, 6))], "k int, v struct<left:int,right:int>")
    total = red.reduction(lambda a, b: a + b, F.sum)
    left = {r.k: tuple(r.x) for r in df.groupBy("k").agg(total.left(red.MAXIMUM).of("v").alias("x")).collect()}
    right = {r.k: tuple(r.x) for r in df.groupBy("k").agg(total.right(red.MAXIMUM).of("v").alias("x")).collect()}
    assert left == {1: (5, None), 2: (None, 6)} and right == {1: (None, 9), 2: (None, 6)}


def test_order_is_asked_for(spark):
    with pytest.raises(ValueError):
        red.FIRST.of("x")
    with pytest.raises(TypeError):
        red.ENDO.of("x")
