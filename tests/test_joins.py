import pytest
from pyspark.sql import functions as F

from millrace.operators import joins
from millrace.operators.bag import Bag

EMPLOYEES = [(31, "Rafferty"), (33, "Jones"), (33, "Steinberg"), (34, "Robinson"), (34, "Smith"), (-1, "John")]
DEPARTMENTS = [(31, "Sales"), (33, "Engineering"), (34, "Clerical"), (35, "Marketing")]


def kv(spark, rows):
    return Bag.of(spark, rows, "key int, value string")


@pytest.fixture
def sides(spark):
    return kv(spark, EMPLOYEES), kv(spark, DEPARTMENTS)


INNER = {(31, "Rafferty", "Sales"), (33, "Jones", "Engineering"), (33, "Steinberg", "Engineering"), (34, "Robinson", "Clerical"), (34, "Smith", "Clerical")}


def test_joins(sides):
    e, d = sides
    left, right = (-1, "John", None), (35, None, "Marketing")
    assert set(e.join(d).run()) == INNER
    assert set(e.join_left(d).run()) == INNER | {left} == set(e.outer_join(d).run())
    assert set(e.join_right(d).run()) == INNER | {right}
    assert set(e.join_full(d).run()) == INNER | {left, right}
    assert {r[1] for r in joins.semi(e, d).run()} == {x[1] for x in INNER}
    assert joins.anti(e, d).run() == [(-1, "John")]


@pytest.mark.parametrize("copies", [1, 3, 5])
def test_block_join_is_the_inner_join(sides, copies):
    e, d = sides
    assert sorted(e.block_join(d, copies=copies).run()) == sorted(INNER)
    assert sorted(d.replicate_by(copies)(e).run()) == sorted((k, b, a) for k, a, b in INNER)


def test_full_join_with_functions(sides):
    got = dict(sides[0].filter("key in (31, -1)").join_full_with(sides[1].filter("key in (31, 35)"), lambda k, a: F.concat(F.lit("l:"), a), lambda k, b: F.concat(F.lit("r:"), b), lambda k, a, b: F.concat(a, F.lit("+"), b)).run())
    assert got == {31: "Rafferty+Sales", -1: "l:John", 35: "r:Marketing"}


def test_null_values_are_not_missing_rows(spark):
    a, b = kv(spark, [(1, None), (2, "x")]), kv(spark, [(1, "y"), (None, "z")])
    got = dict(a.join_full_with(b, lambda k, x: F.lit("left"), lambda k, y: F.lit("right"), lambda k, x, y: F.lit("both")).run())
    assert got == {1: "both", 2: "left", None: "right"}


def test_null_keys(spark):
    a, b = kv(spark, [(None, "a"), (1, "b")]), kv(spark, [(None, "c"), (1, "d")])
    assert a.join(b).run() == [(1, "b", "d")]
    assert set(a.join(b, null_safe=True).run()) == {(None, "a", "c"), (1, "b", "d")}


def test_cogroup(spark):
    a, b = kv(spark, [(1, "a"), (1, None), (2, "b")]), kv(spark, [(1, "c"), (3, "d")])
    got = {k: (sorted(x, key=str), y) for k, x, y in a.cogroup(b).run()}
    assert got == {1: ([None, "a"], ["c"]), 2: (["b"], []), 3: ([], ["d"])}
    assert set(joins.cogroup_sizes(a, b).run()) == {(1, 2, 1), (2, 1, 0), (3, 0, 1)}


def test_empty_sides(spark, sides):
    none = kv(spark, [])
    assert none.join(sides[1]).run() == [] and none.join_left(sides[1]).run() == []
    assert len(none.join_full(sides[1]).run()) == 4 and none.cogroup(none).run() == []
