import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from millrace.operators import joins
from millrace.operators import reductions as red
from millrace.operators.bag import Bag, Counters, DoFn, GroupFn, Scalar
from millrace.operators.grouping import ALL, Grouping
from millrace.plans import inputs_outputs
from millrace.session import steady
from millrace.sources import persisting, text

BIG = 2**53 + 1


def pairs(spark, rows, schema="key string, value bigint"):
    return Bag.of(spark, rows, schema)


def test_values_come_as_they_are(spark):
    schema = "n bigint, a array<int>, s struct<x:int,y:string>, m map<string,array<int>>, d decimal(5,2), b binary, t string"
    rows = [(BIG, [1, None], (1, "z"), {"k": [1]}, None, b"\x00", "é"), (None,) * 7]
    seen = Bag.of(spark, rows, schema).map_rows(lambda r: (repr(r["n"]), repr(r["a"]), repr(r["s"]), repr(r["m"]), repr(r["b"])), "n string, a string, s string, m string, b string").run()
    assert seen == [(str(BIG), "[1, None]", "{'x': 1, 'y': 'z'}", "{'k': [1]}", repr(b"\x00")), ("None",) * 5]
    back = Bag.of(spark, rows, schema).map_rows(lambda r: (r["n"], r["a"], r["m"] and list(r["m"].items()), r["s"]), "n bigint, a array<int>, m map<string,array<int>>, s struct<x:int,y:string>").df.collect()
    assert (back[0].n, back[0].a, back[0].m, tuple(back[0].s)) == (BIG, [1, None], {"k": [1]}, (1, "z"))


def test_python_reductions_of_arrays_and_whole_numbers(spark):
    lists = Bag.of(spark, [("a", [1, 2]), ("a", [3]), ("b", []), (None, [4])], "key string, value array<int>")
    assert {k: sorted(v) for k, v in lists.group_by_key().combine(red.BAGS).run()} == {"a": [1, 2, 3], "b": [], None: [4]}
    numbers = pairs(spark, [("a", BIG), ("a", None), ("b", None), ("a", 3)])
    assert dict(numbers.group_by_key().combine(red.reduction(max).option()).run()) == {"a": BIG, "b": None}
    assert pairs(spark, []).group_by_key().combine(red.PRODUCT_EXACT).run() == []


def env_fn():
    class Env(DoFn):  # made here, so that workers get it by value
        def setup(self, env):
            self.n = 0

        def process(self, env, row):
            self.n += 1
            yield (row["value"], env)

        def cleanup(self, env):
            if self.n:
                yield (-self.n, env)

    return Env()


def test_the_environment_is_computed_when_the_list_runs(spark):
    calls = []

    def fails():
        raise RuntimeError("ran")

    late = Bag.range(spark, 0, 10).parallel_do(env_fn(), "v bigint, e bigint", env=Scalar.lazy(spark, fails, "value bigint"))
    with pytest.raises(Exception, match="ran"):
        late.run()
    rows = Bag(spark.range(0, 100, 1, 7).withColumnRenamed("id", "value")).parallel_do(env_fn(), "v bigint, e bigint", env=Bag.range(spark, 0, 5).sum("value")).run()
    assert sorted(v for v, _ in rows if v >= 0) == list(range(100)) and {e for _, e in rows} == {10} and sum(-v for v, _ in rows if v < 0) == 100
    assert calls == [] and Bag.range(spark, 0, 0).parallel_do(env_fn(), "v bigint, e bigint", env=Scalar.of(spark, 1)).run() == []
    structs = Bag.range(spark, 0, 3).parallel_do(env_fn(), "v bigint, e struct<a:int,b:string>", env=Scalar(spark.createDataFrame([(1, "x")], "a int, b string"))).df.where("v >= 0").collect()
    assert {tuple(r.e) for r in structs} == {(1, "x")}


def first_fn():
    class First(GroupFn):
        def process(self, env, key, values):
            first = next(values)  # the rest is left unread
            self.context.count("keys", "seen")
            yield (key, first, env)

    return First()


def test_group_functions_see_groups_in_order_and_may_leave_values(spark):
    rows = [(f"k{i % 40}", i) for i in range(4000)] + [(None, 7), (None, 3), ("z", None)]
    counters = Counters(spark)
    g = Grouping().secondary_sort(-F.col("value"))
    got = pairs(spark, rows).group_by_key(g).parallel_do(first_fn(), "key string, first bigint, env int", env=Scalar.of(spark, 9), counters=counters).run()
    assert dict((k, v) for k, v, _ in got) == {**{f"k{i}": 3960 + i for i in range(40)}, None: 7, "z": None} and {e for _, _, e in got} == {9}
    assert counters.value("keys", "seen") == 42 and sum(counters.group("rows by task").values()) == 4003
    assert counters.value("keys", "none") == 0
    again = pairs(spark, rows[:5]).group_by_key(g).parallel_do(first_fn(), "key string, first bigint, env int", counters=counters)
    again.run()
    assert counters.value("keys", "seen") == 47


def test_one_group_of_all_and_partitions_of_ones_own(spark):
    rows = [(f"k{i}", i) for i in range(50)]
    [(_, first, _)] = pairs(spark, rows).group_by_key(Grouping(ALL.keys, (F.col("value"),))).parallel_do(first_fn(), "key string, first bigint, env int").run()
    assert first == 0

    class Where(GroupFn):
        def process(self, env, key, values):
            yield (key, self.context.partition)

    g = Grouping().partitioned(lambda k, n: F.length(k)).sorted(lambda k: [k.desc()])
    got = pairs(spark, rows).group_by_key(g).parallel_do(Where(), "key string, part int").run()
    assert {(len(k) % 5, p) for k, p in got} == {(2, 2), (3, 3)}
    assert [k for k, p in got if p == 3] == sorted((k for k, _ in rows if len(k) == 3), reverse=True)
    assert dict(Bag.of(spark, [("A", 1), ("a", 2)], "key string, value bigint").group_by_key(g.contramap(F.lower)).parallel_do(first_fn(), "key string, first bigint, env int").df.groupBy().count().collect()[0].asDict()) == {"count": 1}


def test_scalars_keep_their_own_rule(spark):
    none, some = Bag.range(spark, 0, 0), Bag.range(spark, 0, 4)
    with pytest.raises(ValueError):
        none.max("value").zip(some.length()).run()
    with pytest.raises(ValueError):
        some.length().zip(none.head()).run()
    assert some.length().zip(none.head_option(), none.sum("value"), none.fold(red.SUM)).run() == (4, None, 0, 0)
    nulls = Bag.of(spark, [None, None], "value bigint")
    assert nulls.head().run() is None and nulls.max().run() is None and nulls.reduce(red.MAXIMUM).run() is None and nulls.reduce(red.reduction(max).option()).run() is None
    assert sorted(some.materialise().zip(Scalar.of(spark, "x")).run()[0]) == [0, 1, 2, 3]
    with pytest.raises(Exception, match="empty"):
        none.max("value").join(some).run()
    assert none.head_option().join(some).df.columns == ["scalar_value", "value"] and {r[0] for r in none.head_option().join(some).run()} == {None}


def test_equality_by_a_grouping(spark):
    a, b = Bag.of(spark, ["x", "Y", "Y"], "value string"), Bag.of(spark, ["X", "y", "y"], "value string")
    lower = Grouping().contramap(F.lower)
    assert a.is_equal(b, lower).run() is True and a.is_equal(b).run() is False
    assert a.is_equal(Bag.of(spark, ["x", "y"], "value string"), lower).run() is False


def test_rows_out_of_a_shuffle_are_checkpointed_before_they_are_dealt(spark):
    files = spark.range(10).selectExpr("id as key", "id as value").where("key > 2")
    assert steady(files) is files
    shuffled = files.distinct()
    assert steady(shuffled) is not shuffled
    got = joins.block_join(Bag(files), Bag(shuffled), copies=3).run()
    assert sorted(got) == [(k, k, k) for k in range(3, 10)]


def test_common_parts_run_once(spark, tmp_path):
    class Count(DoFn):
        def process(self, env, row):
            self.context.count("r", "seen")
            yield (row["value"],)

    c = Counters(spark)
    base = Bag.range(spark, 0, 100).parallel_do(Count(), "value bigint", counters=c)
    a, b = text.to_text(base.filter("value < 50"), f"{tmp_path}/a"), text.to_text(base.filter("value >= 50"), f"{tmp_path}/b")
    persisting.persist(a, b)
    assert c.value("r", "seen") == 100
    got = persisting.run(base.sum("value"), base.length(), base.filter("value = 3"))
    assert got == [4950, 100, [3]] and c.value("r", "seen") == 200
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_lists_that_are_written_do_not_come_to_the_driver(spark, data, tmp_path, monkeypatch):
    class Count(DoFn):
        def process(self, env, row):
            self.context.count("r", "seen")
            yield (row["value"],)

    brought, collect = [], DataFrame.collect

    def watched(df):
        rows = collect(df)
        brought.append(len(rows))
        return rows

    monkeypatch.setattr(DataFrame, "collect", watched)
    n = spark.read.parquet(f"{data}/orders.parquet").count()
    got = inputs_outputs.joint_execution(spark, data).first()
    assert got.seen == got.total == got.even + got.odd == n > 1 and max(brought) == 1

    c = Counters(spark)
    base = Bag.range(spark, 0, 100).parallel_do(Count(), "value bigint", counters=c)
    two = text.to_text(text.to_text(base.filter("value < 50"), f"{tmp_path}/a"), f"{tmp_path}/b")
    assert persisting.persist(base.sum("value"), two, base.length()) == [4950, 100] and c.value("r", "seen") == 100
    assert [text.from_text(spark, f"{tmp_path}/{x}").length().run() for x in "ab"] == [50, 50] and max(brought) == 1
    assert persisting.persist(base.filter("value = 3").materialise()) == [[3]]
    with pytest.raises(ValueError):
        persisting.persist(text.to_text(base, f"{tmp_path}/c"), base.filter("false").max())
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_checked_and_kept_sinks(spark, tmp_path):
    rows, out = Bag.of(spark, ["a", "b"], "value string"), f"{tmp_path}/t"
    kept = persisting.kept(text.to_text(rows, out))
    persisting.persist(kept)
    persisting.persist(persisting.kept(text.to_text(rows.filter("false"), out)))
    assert sorted(text.from_text(spark, out).run()) == ["a", "b"]
    with pytest.raises(FileExistsError):
        persisting.persist(persisting.checked(text.to_text(rows, out, overwrite=True), lambda df: (_ for _ in ()).throw(FileExistsError())))
    persisting.persist(persisting.unchecked(text.to_text(rows, out)))
    assert text.from_text(spark, out).length().run() == 4


def test_maps_with_many_entries(spark):
    df = spark.range(2000).selectExpr("id as o", "map(cast(id % 700 as string), id, 'all', id) as m")
    got = df.agg(red.MAP.of("m", "o").alias("m")).first().m
    want = {"all": 1999}
    for i in range(2000):
        want[str(i % 700)] = i
    assert got == want
