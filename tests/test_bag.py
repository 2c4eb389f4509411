import pytest
from pyspark.sql import functions as F

from millrace.operators import reductions as red
from millrace.operators.bag import Bag, DoFn, Scalar
from millrace.operators.grouping import Grouping
from millrace.sources.persisting import run


def ints(spark, *xs):
    return Bag.of(spark, xs, "value int")


def pairs(spark, rows, schema="key string, value int"):
    return Bag.of(spark, rows, schema)


def test_literals_and_empties(spark):
    assert ints(spark).run() == []
    assert ints(spark).length().run() == 0
    assert ints(spark).sum().run() == 0 and ints(spark).product().run() == 1
    for fails in (ints(spark).max(), ints(spark).min(), ints(spark).reduce(red.MAXIMUM), ints(spark).max_by("value"), ints(spark).head(), ints(spark).reduce(red.PRODUCT_EXACT)):
        with pytest.raises(ValueError):
            fails.run()
    assert ints(spark).reduce_option(red.MAXIMUM).run() is None and ints(spark).head_option().run() is None
    assert ints(spark).fold(red.SUM).run() == 0 and ints(spark).fold(red.PRODUCT_EXACT).run() == 1
    with pytest.raises(ValueError):
        Bag.concat([])
    assert ints(spark, 1, 2).filter("value > 5").group_by(F.col("value")).lists().group_by_key().lists().run() == []


def test_short_words(spark):
    words = ["oak"] * 5 + ["fir"] + ["alder"] * 2 + ["sycamore"] * 3
    b = Bag.of(spark, words, "value string").filter(F.length("value") <= 5).map(F.col("value").alias("key"), F.lit(1).alias("value"))
    assert sorted(b.group_by_key().combine(red.SUM).run()) == [("alder", 2), ("fir", 1), ("oak", 5)]


def test_filter_not_keeps_what_is_not_known(spark):
    assert sorted(ints(spark, 1, 5, None).filter_not("value > 3").run(), key=str) == [1, None]


def test_partition_and_strata_lose_and_repeat_nothing(spark):
    b = Bag.range(spark, 0, 500)
    yes, no = b.partition(F.col("value") % 3 == 0)
    assert sorted(yes.run() + no.run()) == list(range(500))
    assert [len(s.run()) for s in b.stratify(2, F.col("value") - 100)] == [1, 1]
    parts = [s.run() for s in b.stratify_weighted([1, 4, 5], seed=2)]
    assert sorted(sum(parts, [])) == list(range(500)) and all(parts)


def test_python_rows_have_a_life_cycle(spark):
    class Sums(DoFn):
        def setup(self, env):
            self.total = env

        def process(self, env, row):
            self.total += row["value"]
            return ()

        def cleanup(self, env):
            return [self.total]

    out = ints(spark, 1, 2, 3, 4)._with(ints(spark, 1, 2, 3, 4).df.coalesce(1)).parallel_do(Sums(), "total bigint", ints(spark, 7).head())
    assert out.run() == [17]
    assert sorted(ints(spark, 1, None).map_rows(lambda r: -1 if r["value"] is None else r["value"] * 2, "x int").run()) == [-1, 2]
    assert sorted(ints(spark, 2, 3).flat_map_rows(lambda r: range(r["value"]), "x int").run()) == [0, 0, 1, 1, 2]


def test_counters(spark):
    b, c = pairs(spark, [("tin", 7), ("tin", 7), ("lead", None), (None, 1)]).counted("metals", "seen")
    b.run()
    assert c.value == 4


def test_groups(spark):
    b = pairs(spark, [("a", 1), ("a", 2), ("b", 3), (None, 4), ("a", None)])
    got = {k: sorted(v, key=str) for k, v in b.group_by_key().lists().run()}
    assert got == {"a": [1, 2, None], "b": [3], None: [4]}
    assert dict(pairs(spark, [("p", 4), ("q", -1), ("p", 9), ("q", 1), ("p", 0)]).group_by_key().reduce_values(lambda a, x: a + x).run()) == {"p": 13, "q": 0}
    assert sorted(b.group_by_key().keys().run(), key=str) == [None, "a", "b"]


def test_secondary_sort(spark):
    rivers = [("north", "Wend"), ("south", "Arle"), ("north", "Isk"), ("east", "Mure"), ("north", "Isk"), ("south", "Quoy"), ("west", "Tarn"), ("south", "Brae"), ("east", "Dove")]
    b = pairs(spark, rivers, "key string, value string")
    got = dict(b.group_by_key(Grouping().secondary_sort("value")).map_values(lambda a: F.array_join(a, ",")).run())
    assert got == {"east": "Dove,Mure", "north": "Isk,Isk,Wend", "south": "Arle,Brae,Quoy", "west": "Tarn"}


def test_grouping_that_equates_keys_gives_the_least(spark):
    b = pairs(spark, [("B", 1), ("b", 2), ("a", 3)])
    assert sorted(b.group_by_key(Grouping().contramap(F.lower)).combine(red.SUM).run()) == [("B", 3), ("a", 3)]
    assert sorted(b.group_by_key(Grouping().contramap(F.lower)).combine(red.PRODUCT_EXACT).df.select("value").toPandas().value.tolist()) == [2, 3]


def test_combine_with_a_python_reduction(spark):
    rows = [(f"k{i % 7}", i % 5 + 1) for i in range(70)] + [(None, 3), (None, 4)]
    want = {}
    for k, v in rows:
        want[k] = want.get(k, 1) * v
    assert dict(Bag.of(spark, rows, "key string, value bigint").group_by_key().combine(red.PRODUCT_EXACT).run()) == want


def test_bag_and_set_difference_and_equality(spark):
    a, b = ints(spark, 1, 1, 2, 3, None), ints(spark, 1, 3, 3, None)
    assert sorted(a.diff(b).run()) == [1, 2]
    assert a.distinct_diff(b).run() == [2]
    assert a.is_equal(a.shuffle(1)).run() is True and a.is_equal(b).run() is False and a.is_equal(a.distinct()).run() is False
    assert ints(spark).is_equal(ints(spark)).run() is True


def test_indexes(spark):
    b = Bag.range(spark, 0, 1000).map((999 - F.col("value")).alias("value"))
    assert sorted(i for _, i in b.zip_with_index().run()) == list(range(1000))
    assert all(v == i for v, i in b.zip_with_index([F.col("value").asc()]).run())
    assert sorted(b.shuffle(4).run()) == list(range(1000))


def test_scalars(spark):
    b = ints(spark, *range(1, 11))
    mean = b.sum().zip(b.size()).map(F.expr("_1 div _2").alias("mean"))
    assert sorted(mean.join(b).filter("value > mean").map("value").run()) == [6, 7, 8, 9, 10]
    assert Scalar.of(spark, 5).to_bag().run() == [5]
    assert Scalar.of(spark, [10, 7, 5], "value array<int>").elements().run() == [10, 7, 5]
    assert sorted(ints(spark, 3, 4).materialise().run()) == [3, 4]
    assert Scalar.of(spark, 2).zip(Scalar.of(spark, "x"), Scalar.of(spark, 3.0)).run() == (2, "x", 3.0)


def test_shared_lists_are_computed_once(spark):
    b, seen = ints(spark, 1, 2).counted("shared", "seen")
    cached = b.cached()
    even = cached.filter("value % 2 = 0")
    both = even + cached.filter("value % 2 = 1")
    rows, total = run(both, cached.sum(), shared=(cached,))
    assert sorted(rows) == [1, 2] and total == 3 and seen.value == 2


def test_many_unions(spark):
    b = ints(spark, 1)
    assert b.union(*[b] * 200).length().run() == 201


def test_lazy_list_is_not_touched_before_it_runs(spark):
    def fails():
        raise RuntimeError("run")

    Bag.lazy(spark, fails, "value int")
    Scalar.lazy(spark, fails, "value int")
    assert Scalar.lazy(spark, lambda: 42, "value int").run() == 42
    assert Bag.lazy(spark, lambda: [(1, "a"), (2, None)], "k int, v string").run() == [(1, "a"), (2, None)]


def test_iterate(spark):
    assert sorted(Bag.range(spark, 0, 20).iterate()) == list(range(20))
