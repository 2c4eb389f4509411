"""Queries of reductions, groupings, scalars, Python functions and array functions over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal

from pyspark.sql import functions as F

from millrace.functions import nonempty as ne
from millrace.operators import joins
from millrace.operators import reductions as red
from millrace.operators.bag import Bag, Counters, DoFn, GroupFn, Scalar
from millrace.operators.grouping import Grouping
from millrace.operators.matrix import Vector
from millrace.plans.collections import bag, keyed, registry
from millrace.plans.pipeline import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registry(QUERIES, SQL)


# --- Python functions of rows and groups: whole numbers, nulls and arrays as they are


@query("select l_orderkey, l_linenumber, case when l_linenumber % 2 = 0 then 9007199254740993 + l_orderkey end as big, case when l_linenumber % 2 = 0 then 9007199254740994 + l_orderkey else -1 end as next from lineitem")
def python_rows_keep_whole_numbers(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.lit(9007199254740993) + F.col("l_orderkey")).alias("big"))
    return Bag(rows).map_rows(lambda r: (r["l_orderkey"], r["l_linenumber"], r["big"], -1 if r["big"] is None else r["big"] + 1), "l_orderkey bigint, l_linenumber int, big bigint, next bigint").df


@query("""select custkey as "key", array_to_string(list_sort(list(o_orderkey)), ',') as value from (select o_custkey as custkey, o_orderkey from orders) group by 1""")
def python_reduction_of_arrays(spark, folder):
    """Lists put one behind the other by a Python reduction; + on them must not add element by element."""
    rows = Bag(table(spark, folder, "orders").select(F.col("o_custkey").alias("key"), F.array("o_orderkey").alias("value")))
    return rows.group_by_key().combine(red.BAGS).map_values(lambda a: F.array_join(F.array_sort(a), ",")).df


@query("""select o_orderpriority as "key", max(case when o_orderkey % 3 > 0 then 9007199254740993 + o_orderkey end) as value from orders group by 1""")
def python_reduction_of_nullable_numbers(spark, folder):
    rows = Bag(table(spark, folder, "orders").select(F.col("o_orderpriority").alias("key"), F.when(F.col("o_orderkey") % 3 > 0, F.lit(9007199254740993) + F.col("o_orderkey")).alias("value")))
    return rows.group_by_key().combine(red.reduction(max).option()).df


class CountedTypes(DoFn):
    """Hands on clicks and counts what it sees."""

    def process(self, env, row) -> Iterable:
        self.context.count("events", "seen")
        self.context.count("types", row["event_type"])
        self.context.tick()
        if row["event_type"] == "click":
            yield (row["event_id"],)


@query("select count(*) as seen, count(*) filter (where event_type = 'click') as clicks, count(*) filter (where event_type = 'click') as handed_on, count(*) as by_tasks from events")
def counters_in_rows(spark, folder):
    counters = Counters(spark)
    out = bag(spark, folder, "events", "event_id", "event_type").parallel_do(CountedTypes(), "event_id bigint", counters=counters)
    n = out.length().run()
    return spark.createDataFrame([(counters.value("events", "seen"), counters.value("types", "click"), n, sum(counters.group("rows by task").values()))], "seen bigint, clicks bigint, handed_on bigint, by_tasks bigint")


class Spread(GroupFn):
    """Highest less lowest value of a group, without holding it; counts groups and values."""

    def process(self, env, key, values: Iterator) -> Iterable:
        low = high = next(values)
        n = 1
        for v in values:
            low, high, n = min(low, v), max(high, v), n + 1
        self.context.count("groups", "keys")
        self.context.count("groups", "values", n)
        yield (key, high - low, env)


@query("""select o_custkey as "key", max(o_orderkey) - min(o_orderkey) as spread, (select count(*) from region) as env from orders group by 1""")
def group_function(spark, folder):
    rows = keyed(spark, folder, "orders", "o_custkey", "o_orderkey")
    return rows.group_by_key().parallel_do(Spread(), "key bigint, spread bigint, env bigint", env=bag(spark, folder, "region").length()).df


@query("select count(distinct o_custkey) as keys, count(*) as n, count(*) as mapped, count(*) as reduced from orders")
def counters_in_groups_and_over_jobs(spark, folder):
    counters = Counters(spark)

    class Same(DoFn):
        def process(self, env, row) -> Iterable:
            self.context.count("rows", "mapped")
            yield (row["key"], row["value"])

    rows = keyed(spark, folder, "orders", "o_custkey", "o_orderkey").parallel_do(Same(), "key bigint, value bigint", counters=counters)
    rows.group_by_key().parallel_do(Spread(), "key bigint, spread bigint, env bigint", counters=counters).length().run()
    reduced = sum(v for k, v in counters.group("rows by task").items() if k.startswith("reduce"))
    return spark.createDataFrame([(counters.value("groups", "keys"), counters.value("groups", "values"), counters.value("rows", "mapped"), reduced)], "keys bigint, n bigint, mapped bigint, reduced bigint")


class First(GroupFn):
    """The place of each group in its partition, with its first value."""

    def setup(self, env) -> None:
        self.place = 0

    def process(self, env, key, values) -> Iterable:
        yield (key, self.context.partition, self.place, next(values))
        self.place += 1


@query("""select o_custkey as "key", cast(o_custkey % 4 as integer) as part, cast(row_number() over (partition by o_custkey % 4 order by o_custkey desc) - 1 as integer) as place, min(o_orderkey) as first from orders group by 1""")
def grouping_with_own_partitions(spark, folder):
    """Keys by remainder into partitions, in descending order in each, their values in ascending order."""
    g = Grouping().partitioned(lambda k, n: k % 4).sorted(lambda k: [k.desc()]).secondary_sort("value")
    return keyed(spark, folder, "orders", "o_custkey", "o_orderkey").group_by_key(g).parallel_do(First(), "key bigint, part int, place int, first bigint").df


# --- lists


@query("select c_custkey as value from customer union all select s_suppkey from supplier")
def flatten(spark, folder):
    whole = Bag(table(spark, folder, "customer").agg(F.collect_list("c_custkey").alias("value")).union(table(spark, folder, "supplier").agg(F.collect_list("s_suppkey"))))
    return whole.flatten().df


@query("select n_nationkey as x, 'key' as side from nation union all select n_regionkey, 'value' from nation")
def keys_and_values(spark, folder):
    n = keyed(spark, folder, "nation", "n_nationkey", "n_regionkey")
    return (n.keys().map(F.col("key").alias("x"), F.lit("key").alias("side")) + n.values().map(F.col("value").alias("x"), F.lit("value").alias("side"))).df


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def top(spark, folder):
    return bag(spark, folder, "orders", "o_orderkey", "o_totalprice").top(10, F.col("o_totalprice").desc(), F.col("o_orderkey").asc()).df


@query("select distinct dept_id, name is null as unnamed from employees")
def distinct_by_columns(spark, folder):
    return bag(spark, folder, "employees", "dept_id", "name").map("dept_id", F.col("name").isNull().alias("unnamed"), "name").distinct("dept_id", "unnamed").map("dept_id", "unnamed").df


@query("select true as by_letters, false as plain, (select count(*) from employees) = (select count(distinct (emp_id, dept_id)) from employees) as without_copies, true as shuffled")
def is_equal_by_grouping(spark, folder):
    """Lists of names that differ in case are equal under a grouping that ignores it."""
    names = bag(spark, folder, "employees", "name")
    loud = names.map((F.concat(F.upper("name"), F.lit("X"))).alias("name"))
    soft = names.map((F.concat(F.lower("name"), F.lit("x"))).alias("name"))
    e = bag(spark, folder, "employees", "emp_id", "dept_id")
    parts = loud.is_equal(soft, Grouping().contramap(F.lower)), loud.is_equal(soft), e.is_equal(e.distinct()), e.is_equal(e.shuffle(3))
    return parts[0].zip(*parts[1:]).map(*[F.col(f"_{k + 1}").alias(c) for k, c in enumerate(("by_letters", "plain", "without_copies", "shuffled"))]).df


@query("select c_custkey, c_mktsegment, 1 as parts from customer")
def stratify_weighted_parts(spark, folder):
    """A split into three parts by weight: each customer is in one part, and no part is off its weight by more than a tenth of all customers."""
    parts = bag(spark, folder, "customer", "c_custkey", "c_mktsegment").stratify_weighted([1.0, 2.0, 3.0], seed=5)
    tagged = Bag.concat([p.map("c_custkey", "c_mktsegment", F.lit(k + 1).alias("w")) for k, p in enumerate(parts)]).df
    n = tagged.count()
    held = {r.w: r["count"] for r in tagged.groupBy("w").count().collect()}
    if any(abs(held.get(w, 0) / max(n, 1) - w / 6) > 0.1 for w in (1, 2, 3)):
        tagged = tagged.limit(0)
    return tagged.groupBy("c_custkey", "c_mktsegment").agg(F.count_distinct("w").cast("int").alias("parts"))


@query("select l_orderkey, l_linenumber, n from (select l_orderkey, l_linenumber, 1 as n from lineitem)")
def zip_with_any_index_pairs(spark, folder):
    """Every line with an index of its own: each index from 0 on belongs to one line."""
    z = bag(spark, folder, "lineitem", "l_orderkey", "l_linenumber").zip_with_index().df
    n = z.count()
    good = z.where(F.col("index").between(0, n - 1))
    return good.join(good.groupBy(F.col("index").alias("i")).agg(F.count(F.lit(1)).cast("int").alias("n")), F.col("index") == F.col("i")).select("l_orderkey", "l_linenumber", "n")


@query("select emp_id, dept_id, count(*) as n, true as moved from employees group by 1, 2")
def shuffle_moves_rows(spark, folder):
    e = table(spark, folder, "employees").select("emp_id", "dept_id")
    order = lambda d: [r[0] for r in Bag(d).df.select("emp_id").collect()]
    moved = order(e) != order(Bag(e).shuffle(11).df)
    return Bag(e).shuffle(11).df.groupBy("emp_id", "dept_id").agg(F.count(F.lit(1)).alias("n")).withColumn("moved", F.lit(moved))


# --- groups


@query("select o_custkey as \"key\", array_to_string(list_sort(list(o_orderkey)), ',') as orders from orders group by 1")
def group_by_key(spark, folder):
    return keyed(spark, folder, "orders", "o_custkey", "o_orderkey").group_by_key().lists().map("key", F.array_join(F.array_sort("value"), ",").alias("orders")).df


@query("select min(struct_pack(_1 := lower(c_mktsegment), _2 := c_nationkey % 5))._2 as part, count(*) as n from customer group by lower(c_mktsegment), c_nationkey % 5")
def grouping_zip(spark, folder):
    """Pairs as keys: the first place without regard to case, the second one by its remainder."""
    key = F.struct(F.lower("c_mktsegment").alias("_1"), (F.col("c_nationkey") % 5).alias("_2"))
    g = Grouping().contramap(F.lower).zip(Grouping().contramap(lambda k: k % 5))
    rows = Bag(table(spark, folder, "customer").select(key.alias("key"), F.lit(1).alias("value")))
    return rows.group_by_key(g).agg(F.count(F.lit(1)).alias("n")).map(F.col("key._2").alias("part"), "n").df


@query("""select n_regionkey * 10 as "key", string_agg(lower(n_name), ',' order by n_name) as names, count(*) as n, n_regionkey as plain from nation group by n_regionkey""")
def grouped_maps(spark, folder):
    g = bag(spark, folder, "nation", key="n_regionkey", value="n_name").group_by_key(Grouping().secondary_sort("n_name"))
    out = g.bimap(lambda k: k * 10, lambda a: F.array_join(F.transform(a, F.lower), ",")).df.toDF("key", "names")
    sizes = g.map_values(F.size).df.toDF("k", "n")
    each = g.map_each(F.lower).values()
    assert each.df.columns == ["n_name"]
    keys = g.keys().df.toDF("plain")
    return out.join(sizes, out["key"] == F.col("k") * 10).join(keys, F.col("k") == F.col("plain")).select("key", "names", F.col("n").cast("bigint").alias("n"), "plain")


@query("select n_regionkey, upper(n_name) as n_name from nation")
def grouped_flat_values(spark, folder):
    return bag(spark, folder, "nation", "n_regionkey", "n_name", key="n_regionkey", value="n_name").group_by_key().flat_values(lambda a: F.transform(a, F.upper)).df


@query("select n_regionkey || ':' || count(*) as value from nation group by n_regionkey")
def grouped_map_pairs(spark, folder):
    return bag(spark, folder, "nation", key="n_regionkey", value="n_name").group_by_key().map_groups(lambda k, a: F.concat_ws(":", k.cast("string"), F.size(a).cast("string"))).df


_NAMES = "(select n_regionkey as k, list(n_name order by n_name) as v from nation group by 1)"


@query(f"""select k, v[1] as first, len(v) as n, list_filter(v, lambda x: x like '%A%')[1] as found, len(list_filter(v, lambda x: x like 'I%')) > 0 as some, len(list_filter(v, lambda x: len(x) > 3)) = len(v) as all_long,
    k + 1 as moved, array_to_string(list_transform(v, lambda x: lower(x)), ',') as low, array_to_string(list_transform(v, lambda x: lower(x)) || list_transform(v, lambda x: left(x, 1)), ',') as both,
    array_to_string(list_prepend('-', v[2:]), ',') as other, len(v) * len(v) as pairs, array_to_string(list_transform(v, lambda x: x || x), ',') as twice from {_NAMES}""")
def associations(spark, folder):
    """A key with its values: maps, lenses, searches, products."""
    v = bag(spark, folder, "nation", key="n_regionkey", value="n_name").group_by_key(Grouping().secondary_sort("n_name")).lists().df
    a = ne.association(F.col("n_regionkey"), F.col("n_name"))
    joined = lambda x: F.array_join(x["values"], ",")
    key, with_key = ne.key_lens(a)
    first, with_first = ne.first_value_lens(a)
    values, with_values = ne.values_lens(a)
    zipped = ne.zip_associations(a, a)["values"]
    return v.select(
        key.alias("k"), first.alias("first"), ne.n_values(a).cast("bigint").alias("n"), ne.find_value(a, lambda x: x.like("%A%")).alias("found"), ne.exists_value(a, lambda x: x.like("I%")).alias("some"), ne.for_all_values(a, lambda x: F.length(x) > 3).alias("all_long"),
        ne.map_key(with_key(key + 1), lambda k: k)["key"].alias("moved"), joined(ne.map_values(a, F.lower)).alias("low"), joined(ne.ap_associations([F.lower, lambda x: F.left(x, F.lit(1))], a)).alias("both"), joined(with_first(F.lit("-"))).alias("other"),
        F.size(ne.product_key(a, with_values(values))["values"]).cast("bigint").alias("pairs"), F.array_join(F.transform(zipped, lambda z: F.concat(z["_1"], z["_2"])), ",").alias("twice"),
    )


# --- reductions


@query("""select o_custkey as "key", cast(sum(cast(cast(round(o_totalprice * 100) as bigint) as decimal(38, 12))) as decimal(38, 12)) as exact, count(*) as n from orders group by 1""")
def reduction_decimal_sum(spark, folder):
    out = bag(spark, folder, "orders", key="o_custkey").group_by_key().agg(red.decimal_sum(12).of(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("exact"), red.COUNT.of("o_orderkey").alias("n"))
    return out.df.withColumnRenamed("o_custkey", "key")


@query("""select "user" as "key", cast(product(rating % 3 + 1) as bigint) as value from (select "user", rating, row_number() over (partition by "user" order by movie, rating, loaded_at, rated_at) as r from ratings where "user" is not null and rating is not null and movie is not null) where r <= 30 group by 1""")
def reduction_exact_product(spark, folder):
    """Products of whole numbers of each user's first thirty ratings (as long as they fit into a bigint), exact by a Python reduction."""
    from pyspark.sql import Window

    w = Window.partitionBy("user").orderBy("movie", "rating", "loaded_at", "rated_at")
    rows = table(spark, folder, "ratings").where("user is not null and rating is not null and movie is not null").withColumn("r", F.row_number().over(w)).where("r <= 30")
    return Bag(rows.select(F.col("user").alias("key"), (F.col("rating") % 3 + 1).cast("bigint").alias("value"))).group_by_key().combine(red.PRODUCT_EXACT).df


@query("""select p_size as "key", cast(case when bool_or(p_partkey % 10 = 0) then 0 when bool_or(p_partkey % 10 = 5) and bool_or(p_partkey % 2 = 0) then 0
    else (case when bool_or(p_partkey % 10 = 5) then 5 else list_reduce(list_prepend(cast(1 as bigint), list(p_partkey % 10)), lambda a, x: a * x % 10) end) end as integer) as value from part group by 1""")
def reduction_digit_product(spark, folder):
    """Last digits of products, with groups that end in each digit."""
    odd = bag(spark, folder, "part", key="p_size").group_by_key()
    return odd.agg(red.PRODUCT_DIGIT.of("p_partkey").cast("int").alias("value")).df.withColumnRenamed("p_size", "key")


@query("""select p_partkey as "key", cast((p_partkey % 10) * (p_partkey // 10 % 10) * (p_partkey // 100 % 10) % 10 as integer) as value from part""")
def reduction_digit_product_of_digits(spark, folder):
    """The last digit of the product of each key's last three digits: every digit occurs as a result."""
    digits = F.array(*[F.floor(F.col("p_partkey") / 10**k).cast("bigint") % 10 for k in range(3)])
    rows = Bag(table(spark, folder, "part").select(F.col("p_partkey").alias("key"), F.explode(digits).alias("value")))
    return rows.group_by_key().combine(red.PRODUCT_DIGIT).map("key", F.col("value").cast("int").alias("value")).df


@query("""select "user" as "key", arg_max(rating, (rated_at, movie, loaded_at)) filter (where rating is not null) as last_rating from ratings where "user" is not null and rated_at is not null and movie is not null group by 1""")
def reduction_last_option(spark, folder):
    r = table(spark, folder, "ratings").where("user is not null and rated_at is not null and movie is not null")
    return Bag(r, key="user").group_by_key().agg(red.LAST_OPTION.of("rating", F.struct("rated_at", "movie", "loaded_at")).alias("last_rating")).df.withColumnRenamed("user", "key")


@query("""select o_custkey as "key", array_to_string(list(o_orderkey order by o_orderkey), ',') as there, array_to_string(list(o_orderkey order by o_orderkey desc), ',') as back, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') as kinds,
    array_to_string(list('<o>' || o_orderkey || '</o>' order by o_orderkey), '') as nodes from orders group by 1""")
def reduction_collections(spark, folder):
    rows = bag(spark, folder, "orders", key="o_custkey").group_by_key()
    one = F.array("o_orderkey")
    node = F.array(F.concat(F.lit("<o>"), F.col("o_orderkey").cast("string"), F.lit("</o>")))
    out = rows.agg(red.LIST.of(one, "o_orderkey").alias("there"), (~red.LIST).of(one, "o_orderkey").alias("back"), red.SET.of(F.array("o_orderpriority")).alias("kinds"), red.NODES.of(node, "o_orderkey").alias("nodes"))
    text = lambda c, by=",": F.array_join(c, by)
    return out.map(F.col("o_custkey").alias("key"), text("there").alias("there"), text("back").alias("back"), text(F.array_sort("kinds")).alias("kinds"), text("nodes", "").alias("nodes")).df


@query("""select o_custkey as "key", string_agg(p || '=' || n, ',' order by p) as last from (select o_custkey, o_orderpriority as p, max(o_orderkey) as n from orders group by 1, 2) group by 1""")
def reduction_map_last_wins(spark, folder):
    """Maps of several entries with keys in common: of each key the last map's value stays."""
    m = F.create_map("o_orderpriority", "o_orderkey")
    out = bag(spark, folder, "orders", key="o_custkey").group_by_key().agg(red.MAP.of(m, "o_orderkey").alias("m"))
    entries = F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return out.map(F.col("o_custkey").alias("key"), F.array_join(entries, ",").alias("last")).df


@query("""select o_orderpriority as "key", 7 as seven, cast(null as integer) as unit, count(*) as n, cast(sum(length(o_orderstatus)) as bigint) as letters, 'n=' || count(*) as told, -max(-o_orderkey) as least_id, min(o_orderkey) as both_min, max(o_orderkey) as both_max from orders group by 1""")
def reduction_images(spark, folder):
    """Constant, unit, on, out, carried over to another type, and pairs."""
    rows = bag(spark, folder, "orders", key="o_orderpriority").group_by_key()
    letters = red.SUM.map_in(len, F.length)
    told = red.COUNT.map_out(lambda n: f"n={n}", lambda c: F.concat(F.lit("n="), c.cast("string")))
    least = red.MAXIMUM.biject(lambda x: -x, lambda x: -x, lambda c: -c, lambda c: -c)
    both = red.MINIMUM.compose(red.MAXIMUM)
    pair = F.struct(F.col("o_orderkey").alias("_1"), F.col("o_orderkey").alias("_2"))
    out = rows.agg(red.constant(7).of("o_orderkey").alias("seven"), red.UNIT.of("o_orderkey").cast("int").alias("unit"), red.COUNT.of("o_orderkey").alias("n"), letters.of("o_orderstatus").alias("letters"), told.of("o_orderkey").alias("told"), least.of("o_orderkey").alias("least_id"), both.of(pair).alias("b"))
    return out.map(F.col("o_orderpriority").alias("key"), "seven", "unit", "n", "letters", "told", "least_id", F.col("b._1").alias("both_min"), F.col("b._2").alias("both_max")).df


@query("""select symbol as "key", sum(price) filter (where price >= 100) is null as none_left, round(sum(price) filter (where price >= 100), 4) as l, round(case when sum(price) filter (where price >= 100) is null then max(price) filter (where price < 100) end, 4) as l_other,
    round(max(price) filter (where price < 100), 4) as r, round(sum(price), 4) as o from ticks where symbol is not null group by 1""")
def reduction_biased(spark, folder):
    """Prices from 100 on are lefts, others rights: lefts win, or rights do; nulls are nothing."""
    high, low = F.when(F.col("price") >= 100, F.col("price")), F.when(F.col("price") < 100, F.col("price"))
    total = red.reduction(lambda a, b: a + b, F.sum)
    rows = Bag(table(spark, folder, "ticks").where("symbol is not null").select(F.col("symbol").alias("key"), F.struct(high.alias("left"), low.alias("right")).alias("value"), "price")).group_by_key()
    out = rows.agg(total.left(red.MAXIMUM).of("value").alias("a"), total.right(red.MAXIMUM).of("value").alias("b"), total.option().of("price").alias("o"))
    return out.map("key", F.col("a.left").isNull().alias("none_left"), F.round("a.left", 4).alias("l"), F.round("a.right", 4).alias("l_other"), F.round("b.right", 4).alias("r"), F.round("o", 4).alias("o")).df


def _algebra(row: dict) -> tuple:
    """Reductions that have no column form, on two numbers of a row."""
    x, y = row["n_nationkey"], row["n_regionkey"]
    plus, times = (lambda k: lambda v: v + k), (lambda k: lambda v: v * k)
    compare = lambda m: lambda a, b: (a % m > b % m) - (a % m < b % m)
    state = red.SUM.state()(lambda s: (s + x, s), lambda s: (s + y, s * 2))(1)
    log, value = red.SUM.writer(red.LIST)(([x], x), ([y], y))
    f, at = red.SUM.store()((plus(x), 1), (plus(y), 2))
    return (
        x, y, (~red.FIRST)(x, y), red.SUM.pair()(x), red.split1(plus(1))(x, y), red.split2(plus(1))(x, y), red.split1_by(red.SUM, times(2))(x, y), red.split2_by(red.SUM, times(2))(x, y), red.ENDO(plus(x), times(2))(y),
        red.ORDERING(compare(2), compare(7))(x, y), red.COMPARISON((x > y) - (x < y), 5), red.EQUAL(lambda a, b: a % 2 == b % 2, lambda a, b: a % 3 == b % 3)(x, y), red.UNEQUAL(lambda a, b: a % 2 != b % 2, lambda a, b: a % 3 != b % 3)(x, y),
        red.SUM.pointwise()(plus(x), times(y))(3), red.SUM.pointwise(2)(lambda a, b: a * b + x, lambda a, b: a - b)(5, y), sum(red.SUM.pointwise_lifted(lambda op, a, b: [op(p, q) for p in a for q in b])(lambda v: [v, x], lambda v: [v, y])(1)),
        red.SUM.pointwise_from(lambda w: w[0])(plus(x), times(2))((y, 9)), sum(red.SUM.lift(lambda op, a, b: [op(p, q) for p in a for q in b])([x, 1], [y])), state[0], state[1], log[0] * 100 + log[1], value, f(10), at,
        red.minimum_by(lambda v: v % 7)(x, y), red.maximum_by(lambda v: v % 7)(x, y), int(red.SUM.zip(red.MAXIMUM, red.MINIMUM)((x, x, x), (y, y, y))[1]), red.SUM.fold([x, y, 1]), red.SUM.associative(x, y, 3), int(red.SUM_DECIMAL(Decimal(x), Decimal(y))),
        red.SUM.validation(red.MAXIMUM)(("ok", x), ("error", y))[1], red.SUM.left(red.MAXIMUM)(("right", x), ("left", y))[1], red.SUM.right(red.MAXIMUM)(("right", x), ("left", y))[1],
    )


_COLUMNS = (
    "x int, y int, dual int, pair int, split_left int, split_right int, half_left int, half_right int, endo int, ordering int, comparison int, equal boolean, unequal boolean, pointwise int, pointwise2 int, kleisli int, cokleisli int, lifted int, "
    "state int, state_value int, log int, value int, store int, store_at int, min_by int, max_by int, zip3 int, folded int, law boolean, decimal int, valid int, left_wins int, right_wins int"
)


@query("""select x, y, y as dual, 2 * x as pair, x + 1 as split_left, y + 1 as split_right, 2 * x + y as half_left, x + 2 * y as half_right, 2 * y + x as endo,
    case when x % 2 <> y % 2 then (case when x % 2 > y % 2 then 1 else -1 end) when x % 7 <> y % 7 then (case when x % 7 > y % 7 then 1 else -1 end) else 0 end as ordering, case when x > y then 1 when x < y then -1 else 5 end as comparison,
    x % 2 = y % 2 and x % 3 = y % 3 as equal, x % 2 <> y % 2 or x % 3 <> y % 3 as unequal, 3 + x + 3 * y as pointwise, 5 * y + x + 5 - y as pointwise2, 2 * (1 + x) + 2 * (1 + y) as kleisli, y + x + 2 * y as cokleisli, x + 2 * y + 1 as lifted,
    1 + x + y as state, 1 + (1 + x) * 2 as state_value, x * 100 + y as log, x + y as value, 20 + x + y as store, 2 as store_at, case when y % 7 < x % 7 then y else x end as min_by, case when y % 7 > x % 7 then y else x end as max_by, greatest(x, y) as zip3,
    x + y + 1 as folded, true as law, x + y as decimal, x as valid, y as left_wins, x as right_wins from (select n_nationkey as x, n_regionkey as y from nation)""")
def reduction_algebra(spark, folder):
    return bag(spark, folder, "nation", "n_nationkey", "n_regionkey").map_rows(_algebra, _COLUMNS).df


@query("select o_custkey, array_to_string(list(o_orderkey order by o_orderpriority, o_orderkey desc), ',') as ordered from orders group by 1")
def ordering_of_columns(spark, folder):
    """An order by one criterion after the other, as an expression."""
    order = red.by_criteria(red.ascending(lambda x: x["p"]), red.descending(lambda x: x["k"]))
    boxed = F.collect_list(F.struct(F.col("o_orderpriority").alias("p"), F.col("o_orderkey").alias("k")))
    out = bag(spark, folder, "orders", key="o_custkey").group_by_key().agg(F.array_sort(boxed, order).alias("a"))
    return out.map("o_custkey", F.array_join(F.transform("a", lambda x: x["k"]), ",").alias("ordered")).df


@query("""select o_custkey as "key", case when max(k) > 1 then cast(sum(o_orderkey) as bigint) else min(o_orderkey) end as value from (select *, row_number() over (partition by o_custkey order by o_orderkey) as k from orders) group by 1""")
def reduce_values_option(spark, folder):
    return keyed(spark, folder, "orders", "o_custkey", "o_orderkey").group_by_key().reduce_values_option(lambda a, x: a + x).df


@query("select cast(sum(o_orderkey) as bigint) as total, max(o_orderkey) as most, cast(null as bigint) as nothing, -1 as instead, cast(null as bigint) as all_null, cast(null as double) as null_max, count(*) as n from orders")
def reduce_and_options(spark, folder):
    """Reductions of a whole list and of none; a null is a value, and no value is another thing."""
    o = bag(spark, folder, "orders", "o_orderkey")
    none = o.filter("o_orderkey < 0")
    nulls = o.map(F.lit(None).cast("bigint").alias("o_orderkey"), F.lit(None).cast("double").alias("x"))
    instead = Scalar(none.df.select(F.col("o_orderkey").cast("int")).limit(1), ("value", -1))
    parts = o.reduce(red.SUM, "o_orderkey"), o.reduce(red.reduction(max), "o_orderkey"), none.reduce_option(red.MAXIMUM, "o_orderkey"), instead, nulls.map("o_orderkey").head(), nulls.max("x"), o.length()
    return parts[0].zip(*parts[1:]).map(*[F.col(f"_{k + 1}").alias(c) for k, c in enumerate(("total", "most", "nothing", "instead", "all_null", "null_max", "n"))]).df


@query("select 'raised' as both, 'raised' as joined, cast(null as bigint) as head_of_null, true as head_is_there, 42 as lazy")
def scalar_policies(spark, folder):
    """A zip raises if one of its values does; running a value that is null gives None."""
    r = bag(spark, folder, "region", "r_regionkey")
    none = r.filter("r_regionkey < 0")

    def outcome(f) -> str:
        try:
            f()
        except ValueError:
            return "raised"
        return "went on"

    head = r.map(F.lit(None).cast("bigint").alias("x")).head().run()
    row = (outcome(lambda: none.max("r_regionkey").zip(r.length()).run()), outcome(lambda: r.length().zip(none.head()).run()), head, r.head_option().run() in range(5), Scalar.lazy(spark, lambda: 42, "value int").run())
    return spark.createDataFrame([row], "both string, joined string, head_of_null bigint, head_is_there boolean, lazy int")


@query("select count(*) as n, sum(cast(x as bigint)) as total from (select unnest(range(0, 5000)) as x)")
def materialised(spark, folder):
    whole = Bag.range(spark, 0, 5000).materialise()
    return whole.elements().length().zip(whole.elements().sum("value")).map(F.col("_1").alias("n"), F.col("_2").alias("total")).df


# --- joins of larger tables


def _orders(spark, folder):
    return keyed(spark, folder, "customer", "c_custkey", "c_name"), keyed(spark, folder, "orders", "o_custkey", "o_orderkey")


@query('select c_custkey as "key", c_name as "left", o_orderkey as "right" from customer join orders on c_custkey = o_custkey')
def orders_join_inner(spark, folder):
    return joins.join(*_orders(spark, folder)).df


@query('select c_custkey as "key", c_name as "left", o_orderkey as "right" from customer left join orders on c_custkey = o_custkey')
def orders_outer_join(spark, folder):
    c, o = _orders(spark, folder)
    return c.outer_join(o).df


@query('select o_custkey as "key", c_name as "left", o_orderkey as "right" from customer right join orders on c_custkey = o_custkey')
def orders_join_right(spark, folder):
    return joins.join_right(*_orders(spark, folder)).df


@query('select coalesce(c_custkey, o_custkey) as "key", c_name as "left", o_orderkey as "right" from customer full join orders on c_custkey = o_custkey')
def orders_join_full(spark, folder):
    return joins.join_full(*_orders(spark, folder)).df


@query('select c_custkey as "key", c_name as "left", o_orderkey as "right" from customer join orders on c_custkey = o_custkey')
def orders_block_join(spark, folder):
    """The right side comes out of a shuffle, so its rows are dealt from a checkpoint."""
    c, o = _orders(spark, folder)
    return c.block_join(o.distinct(), copies=3).df


@query('select c_custkey as "key", c_name as value from customer where c_custkey in (select o_custkey from orders)')
def orders_semi(spark, folder):
    return joins.semi(*_orders(spark, folder)).df


@query('select c_custkey as "key", c_name as value from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)')
def orders_anti(spark, folder):
    return joins.anti(*_orders(spark, folder)).df


@query("""select coalesce(c_custkey, k) as "key", coalesce(c_name, '') as "left", coalesce(v, '') as "right" from customer full join (select o_custkey as k, array_to_string(list_sort(list(o_orderkey)), ',') as v from orders group by 1) on c_custkey = k""")
def cogroup_values(spark, folder):
    out = joins.cogroup(*_orders(spark, folder))
    return out.map("key", F.array_join(F.array_sort("left"), ",").alias("left"), F.array_join(F.array_sort("right"), ",").alias("right")).df


@query("select cast(i as bigint) as idx, cast(case when i % 3 = 0 then i * 2 else 0 end as bigint) as value from range(100) t(i)")
def dense_vector(spark, folder):
    v = Vector(spark.range(100).where("id % 3 = 0").select(F.col("id").alias("idx"), (F.col("id") * 2).alias("value")))
    return v.dense().df


# --- array functions


_E = "(select vec_id, list_transform(embedding[1:6], lambda x: cast(round(x * 1000) as integer)) as a from embeddings)"


def _j(expr: str) -> str:
    return f"array_to_string({expr}, ',')"


@query(f"""select vec_id, {_j("list_transform(a, lambda x: x * 2) || list_transform(a, lambda x: x + 1)")} as ap, {_j("flatten(list_transform(a, lambda x: [x, -x]))")} as flat, {_j("a || a")} as twice, {_j("list_prepend(7, a)")} as seven,
    {_j("a[2:]")} as tail, {_j("a[:5]")} as init, {_j("list_filter(a, lambda x: x > 0)")} as pos, {_j("list_filter(a, lambda x: not x > 0)")} as neg, list_filter(a, lambda x: x > 0)[1] as find, -list_filter(a, lambda x: x > 0)[1] as collect_first,
    {_j("list_transform(list_filter(a, lambda x: x > 0), lambda x: -x)")} as collected, len(list_filter(a, lambda x: x < 2000)) = 6 as all_small, len(list_filter(a, lambda x: x > 2000)) > 0 as some_large, list_contains(a, a[3]) as has, list_position(a, a[3]) - 1 as at,
    cast(list_sum(a) + 5 as integer) as folded, {_j("[5, 5 + a[1], 5 + a[1] + a[2], 5 + a[1] + a[2] + a[3], 5 + a[1] + a[2] + a[3] + a[4], 5 + a[1] + a[2] + a[3] + a[4] + a[5], 5 + a[1] + a[2] + a[3] + a[4] + a[5] + a[6]]")} as scanned,
    {_j("[a[1], a[1] + a[2], a[1] + a[2] + a[3], a[1] + a[2] + a[3] + a[4], a[1] + a[2] + a[3] + a[4] + a[5], a[1] + a[2] + a[3] + a[4] + a[5] + a[6]]")} as scanned1,
    {_j("a[:2]")} as taken, {_j("a[3:]")} as dropped, {_j("a[2:4]")} as sliced, {_j("a || [0, 0]")} as padded, len(a) as size, false as other, true as same, {_j("list_transform(range(6), lambda i: i * 10 + 1 - 1 + a[i + 1] * 0 + i)")} as numbered, {_j("[a[1] + a[1], a[2] + a[2]]")} as zipped,
    {_j("[a[1] + 1, a[2] - 1]")} as zipped_all, {_j("[3, 4, 5]")} as counted, {_j("[1, 2, 4, 8]")} as iterated, {_j("[a[1]]")} as single from {_E}""")
def array_operations(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 6), lambda x: F.round(x * 1000).cast("int")).alias("a"))
    a, text, one = F.col("a"), lambda c: F.array_join(c, ","), F.lit
    two, first2 = F.array(one(1), one(-1)), F.slice(F.col("a"), 1, 2)
    add = lambda x, y: x + y
    pos = lambda x: x > 0
    third = F.element_at(a, 3)
    return rows.select(
        "vec_id", text(ne.ap(a, lambda x: x * 2, lambda x: x + 1)).alias("ap"), text(ne.flat_map(a, lambda x: F.array(x, -x))).alias("flat"), text(ne.append(a, a)).alias("twice"), text(ne.prepend(one(7), a)).alias("seven"), text(ne.tail(a)).alias("tail"), text(ne.init(a)).alias("init"),
        text(ne.partition(a, pos)["_1"]).alias("pos"), text(ne.filter_not(a, pos)).alias("neg"), ne.find(a, pos).alias("find"), ne.collect_first(a, pos, lambda x: -x).alias("collect_first"), text(ne.collect(a, pos, lambda x: -x)).alias("collected"),
        ne.for_all(a, lambda x: x < 2000).alias("all_small"), ne.exists(a, lambda x: x > 2000).alias("some_large"), ne.contains(a, third).alias("has"), ne.index_of(a, third).cast("int").alias("at"), ne.fold_left(a, one(5), add).alias("folded"), text(ne.scan_left(a, one(5), add)).alias("scanned"), text(ne.scan_left1(a, add)).alias("scanned1"),
        text(ne.take(a, one(2))).alias("taken"), text(ne.drop(a, one(2))).alias("dropped"), text(ne.slice_(a, one(1), one(4))).alias("sliced"), text(ne.pad_to(a, one(8), one(0))).alias("padded"), F.size(a).cast("bigint").alias("size"), ne.same_elements(a, ne.tail(a)).alias("other"), ne.same_elements(a, a).alias("same"),
        text(F.transform(ne.zip_with_index(a), lambda z: z["_2"] * 10 + z["_2"])).alias("numbered"), text(F.transform(ne.zip_(first2, a), lambda z: z["_1"] + z["_2"])).alias("zipped"), text(F.transform(ne.zip_all(first2, two, one(0), one(0)), lambda z: z["_1"] + z["_2"])).alias("zipped_all"),
        text(ne.counted_from(one(3), one(3))).alias("counted"), text(ne.iterate(one(1), lambda x: x * 2, 4)).alias("iterated"), text(ne.single(F.element_at(a, 1))).alias("single"),
    )


@query("""select p_partkey, array_to_string(list_filter(range(1, 9), lambda i: i < p_size), ',') as leading, array_to_string(list_filter(range(1, 9), lambda i: i >= p_size), ',') as rest, len(list_filter(range(1, 9), lambda i: i < p_size)) as n from part""")
def array_spans(spark, folder):
    a = F.array(*[F.lit(k) for k in range(1, 9)])
    small = lambda x: x < F.col("p_size")
    s = ne.span(a, small)
    return table(spark, folder, "part").select("p_partkey", F.array_join(s["_1"], ",").alias("leading"), F.array_join(ne.drop_while(a, small), ",").alias("rest"), F.size(ne.take_while(a, small)).cast("bigint").alias("n"))
