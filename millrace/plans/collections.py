"""Queries of the collection operators over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import nonempty as ne
from millrace.functions.text import a_long, field, fields
from millrace.operators import joins
from millrace.operators import reductions as red
from millrace.operators.bag import Bag, DoFn, Scalar
from millrace.operators.grouping import ALL, Grouping
from millrace.operators.matrix import Matrix, Vector
from millrace.plans.pipeline import table
from millrace.plans.programs import page_rank, shortest_paths, similarity
from millrace.session import cut, ensure_checkpoint_dir
from millrace.sources import persisting, records, sequence, text
from millrace.sources.files import Files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def registry(queries: dict, sqls: dict[str, str]):
    """A decorator that registers functions of (spark, folder) under their names, with the SQL that says the same."""

    def query(sql: str | None = None):
        def keep(f):
            queries[f.__name__] = f
            if sql is not None:
                sqls[f.__name__] = sql
            return f

        return keep

    return query


query = registry(QUERIES, SQL)


def bag(spark: SparkSession, folder: str, name: str, *cols: str, key: str = "key", value: str = "value") -> Bag:
    df = table(spark, folder, name)
    return Bag(df.select(*cols) if cols else df, key, value)


def scratch(spark: SparkSession) -> str:
    """A new folder where all executors can write."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4()}"


def kept_from(df: DataFrame, folder: str) -> DataFrame:
    """What is read from a scratch folder, checkpointed, and the folder gone."""
    out = cut(df)
    Files(df.sparkSession, folder).delete()
    return out


def keyed(spark: SparkSession, folder: str, name: str, key: str, value: str) -> Bag:
    return Bag(table(spark, folder, name).select(F.col(key).alias("key"), F.col(value).alias("value")))


# --- row by row


@query("select word, count(*) as n from (select unnest(string_split(text, ' ')) as word from documents) where word <> '' group by 1")
def word_count(spark, folder):
    words = bag(spark, folder, "documents").map_flatten(F.split("text", " "), "word").filter("word <> ''")
    return words.map(F.col("word").alias("key"), F.lit(1).alias("value")).group_by_key().combine(red.SUM).df.toDF("word", "n")


@query("select o_orderkey, o_totalprice from orders where not coalesce(o_totalprice > 150000, false)")
def filter_not(spark, folder):
    return bag(spark, folder, "orders", "o_orderkey", "o_totalprice").filter_not(F.col("o_totalprice") > 150000).df


@query("select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as net from lineitem where l_returnflag = 'R'")
def collect_partial(spark, folder):
    return bag(spark, folder, "lineitem").collect(F.col("l_returnflag") == "R", "l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net")).df


@query("select upper(trim(name)) as \"key\", dept_id * 2 as value from employees")
def map_keys_and_values(spark, folder):
    return keyed(spark, folder, "employees", "name", "dept_id").map_keys(lambda k: F.upper(F.trim(k))).map_values(lambda v: v * 2).df


@query("select vec_id, i - 1 as at, cast(embedding[i] as double) as x from (select vec_id, embedding, unnest(generate_series(1, len(embedding))) as i from embeddings)")
def flatten_embeddings(spark, folder):
    return bag(spark, folder, "embeddings").map("vec_id", F.posexplode("embedding").alias("at", "x")).map("vec_id", F.col("at").cast("bigint"), F.col("x").cast("double")).df


@query("select cell_type, count(*) as n from (select unnest(cells).cell_type as cell_type from documents) group by 1")
def map_flatten_cells(spark, folder):
    cells = bag(spark, folder, "documents").map_flatten("cells").map(F.col("value.cell_type").alias("key"), F.lit(1).alias("value"))
    return cells.group_by_key().combine(red.SUM).df.toDF("cell_type", "n")


@query("select event_id, case when event_type = 'purchase' then 'match' else 'rest' end as part from events")
def partition_events(spark, folder):
    hit, rest = bag(spark, folder, "events", "event_id", "event_type").partition(F.col("event_type") == "purchase")
    return (hit.map("event_id", F.lit("match").alias("part")) + rest.map("event_id", F.lit("rest").alias("part"))).df


@query("select o_orderkey, cast(case o_orderstatus when 'F' then 0 when 'O' then 1 end as integer) as stratum from orders where o_orderstatus in ('F', 'O')")
def stratify_orders(spark, folder):
    number = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(-1)
    parts = bag(spark, folder, "orders", "o_orderkey", "o_orderstatus").stratify(2, number)
    return Bag.concat([p.map("o_orderkey", F.lit(k).alias("stratum")) for k, p in enumerate(parts)]).df


@query("select c_custkey, c_mktsegment from customer")
def stratify_weighted(spark, folder):
    return Bag.concat(bag(spark, folder, "customer", "c_custkey", "c_mktsegment").stratify_weighted([1.0, 2.0, 3.0], seed=5)).df


class NextKey(DoFn):
    """Adds an offset from the environment to keys; the number of partitions seen so far plays no part in the result."""

    def setup(self, env):
        self.step = 1 if env is None else env

    def process(self, env, row) -> Iterable:
        yield (row["o_orderkey"], row["o_orderkey"] + self.step)


@query("select o_orderkey, o_orderkey + (select count(*) from region) as next_key from orders")
def parallel_do(spark, folder):
    step = bag(spark, folder, "region").length()
    return bag(spark, folder, "orders", "o_orderkey").parallel_do(NextKey(), "o_orderkey bigint, next_key bigint", step).df


@query("select count(*) as seen, count(*) filter (where event_type = 'click') as clicks from events")
def counters(spark, folder):
    seen, one = bag(spark, folder, "events", "event_id", "event_type").counted("events", "seen")
    clicks, two = seen.counted("events", "clicks", F.col("event_type") == "click")
    clicks.group_by(F.col("event_type")).agg(F.count(F.lit(1)).alias("value")).run()
    return spark.createDataFrame([(one.value, two.value)], "seen bigint, clicks bigint")


@query("select p_partkey as \"key\", p_name as value from part where p_size > 10")
def by_key_and_values(spark, folder):
    return bag(spark, folder, "part", "p_partkey", "p_name", "p_size").filter("p_size > 10").by("p_partkey").map_values(lambda v: v["p_name"]).df


# --- sources made in place


@query("select cast(i * i as bigint) as value from range(1000) t(i) union all select cast(7 as bigint) from range(10) t(i)")
def tabulate_and_fill(spark, folder):
    return (Bag.tabulate(spark, 1000, lambda i: i * i) + Bag.fill(spark, 10, 7)).df


@query("select * from (values (1, 'one'), (2, 'two'), (3, null)) t(k, v)")
def literal_list(spark, folder):
    return Bag.of(spark, [(1, "one"), (2, "two"), (3, None)], "k int, v string").df


@query("select cast(i * i as bigint) as value from range(2500) t(i)")
def lazy_list(spark, folder):
    return Bag.lazy(spark, lambda: (i * i for i in range(2500)), "value bigint").df


@query("select cast(i as bigint) as n from range(300) t(i)")
def own_source(spark, folder):
    def read(split: tuple) -> Iterator[tuple]:
        return ((i,) for i in range(*split))

    return records.from_source(spark, records.own_source("numbers_in_parts", "n bigint", lambda: [(0, 100), (100, 300)], read)).df


# --- bags and sets


@query("select n_name as name from nation union all select r_name from region union all select s_name from supplier")
def concat_union(spark, folder):
    return Bag.concat([bag(spark, folder, t, c).map(F.col(c).alias("name")) for t, c in (("nation", "n_name"), ("region", "r_name"), ("supplier", "s_name"))]).df


@query("select distinct c_mktsegment from customer")
def distinct_mktsegment(spark, folder):
    return bag(spark, folder, "customer", "c_mktsegment").distinct().df


@query("select dept_id from employees except all select id from departments")
def diff_bag(spark, folder):
    return bag(spark, folder, "employees", "dept_id").diff(bag(spark, folder, "departments", "id")).df


@query("select dept_id from employees except select id from departments")
def diff_set(spark, folder):
    return bag(spark, folder, "employees", "dept_id").distinct_diff(bag(spark, folder, "departments", "id")).df


@query("select true as same, false as other")
def is_equal(spark, folder):
    e = bag(spark, folder, "employees", "emp_id", "dept_id")
    a, b = e.is_equal(e.shuffle(3)), e.is_equal(e.distinct())
    return a.zip(b).map(F.col("_1").alias("same"), F.col("_2").alias("other")).df


# --- reductions of a whole list


@query("select cast(coalesce(sum(rating), 0) as bigint) as total, cast(0 as bigint) as nothing from ratings")
def sum_and_empty(spark, folder):
    r = bag(spark, folder, "ratings", "rating")
    return r.sum("rating").zip(r.filter("rating < 0").sum("rating")).map(F.col("_1").alias("total"), F.col("_2").alias("nothing")).df


@query("select round(coalesce(exp(100 * avg(ln(1 + l_discount))), 1), 6) as p from lineitem")
def product_whole(spark, folder):
    """The product over all rows, each factor raised to 100 / n so that it stays finite at any size."""
    rows = bag(spark, folder, "lineitem", "l_discount")
    powers = rows.count("l_discount is not null").map(F.col("value").alias("n")).join(rows).filter("l_discount is not null")
    return powers.map(F.pow(1 + F.col("l_discount"), 100 / F.col("n")).alias("value")).product().map(F.round("value", 6).alias("p")).df


@query("select count(*) as n, count(*) filter (where rating >= 9) as high from ratings")
def length_and_count(spark, folder):
    r = bag(spark, folder, "ratings", "rating")
    return r.length().zip(r.count("rating >= 9")).map(F.col("_1").alias("n"), F.col("_2").alias("high")).df


@query("select max(price) as top, min(price) as low from ticks")
def max_and_min(spark, folder):
    t = bag(spark, folder, "ticks", "price")
    return t.max("price").zip(t.min("price")).map(F.col("_1").alias("top"), F.col("_2").alias("low")).df


@query("select (select p_partkey from part order by p_retailprice desc, p_partkey desc limit 1) as dearest, (select p_partkey from part order by p_retailprice, p_partkey limit 1) as cheapest")
def max_by_min_by(spark, folder):
    p = bag(spark, folder, "part", "p_partkey", "p_retailprice")
    return p.max_by("p_retailprice").map("value.p_partkey").zip(p.min_by("p_retailprice").map("value.p_partkey")).map(F.col("_1").alias("dearest"), F.col("_2").alias("cheapest")).df


@query("select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) from orders)")
def bounded_filter(spark, folder):
    o = bag(spark, folder, "orders", "o_orderkey", "o_totalprice")
    mean = Scalar(o.df.agg(F.sum("o_totalprice").alias("s"), F.count(F.lit(1)).alias("n"))).map((F.col("s") / F.col("n")).alias("mean"))
    return mean.join(o).filter("o_totalprice > mean").map("o_orderkey").df


@query("select cast(sum(rating) % 10 as bigint) as digit, cast(count(*) as bigint) as n from ratings where rating is not null")
def fold_map_digit(spark, folder):
    r = Bag(table(spark, folder, "ratings").where("rating is not null").select(F.col("rating").alias("value")))
    return r.fold_map(lambda v: v.cast("bigint"), red.SUM_DIGIT).zip(r.length()).map(F.col("_1").alias("digit"), F.col("_2").alias("n")).df


@query("select cast(unnest([10, 7, 5]) as integer) as value")
def scalar_elements(spark, folder):
    return Scalar.of(spark, [10, 7, 5], "value array<int>").elements().df


# --- reductions by key


@query("select l_returnflag, count(*) as n, round(sum(l_quantity), 2) as qty, min(l_shipdate)::date as first_day, max(l_discount) as top from lineitem group by 1")
def combine_zip(spark, folder):
    zipped = red.COUNT.zip(red.SUM, red.MINIMUM, red.MAXIMUM)
    rows = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("key"), F.struct(F.lit(1).alias("_1"), F.col("l_quantity").alias("_2"), F.to_date("l_shipdate").alias("_3"), F.col("l_discount").alias("_4")).alias("value"))
    return Bag(rows).group_by_key().combine(zipped).map(F.col("key").alias("l_returnflag"), F.col("value._1").alias("n"), F.round("value._2", 2).alias("qty"), F.col("value._3").alias("first_day"), F.col("value._4").alias("top")).df


@query("select symbol as \"key\", max(price) as value from ticks where symbol is not null and price is not null group by 1")
def combine_python(spark, folder):
    ticks = keyed(spark, folder, "ticks", "symbol", "price").filter("key is not null and value is not null")
    return ticks.group_by_key().combine(red.reduction(lambda a, b: max(a, b))).df


@query("select \"user\" as \"key\", bool_and(rating >= 3) as always, bool_or(rating = 10) as ever from ratings where rating is not null group by 1")
def reduction_bool(spark, folder):
    r = table(spark, folder, "ratings").where("rating is not null")
    return Bag(r, key="user").group_by_key().agg(red.AND.of(F.col("rating") >= 3).alias("always"), red.OR.of(F.col("rating") == 10).alias("ever")).df.withColumnRenamed("user", "key")


@query("select o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as last_order from orders group by 1")
def reduction_first_last(spark, folder):
    order = F.struct("o_orderdate", "o_orderkey")
    return bag(spark, folder, "orders", key="o_custkey").group_by_key().agg(red.FIRST.of("o_orderkey", order).alias("first_order"), red.LAST.of("o_orderkey", order).alias("last_order")).df


@query("select \"user\" as \"key\", arg_min(rating, (rated_at, movie, loaded_at)) filter (where rating is not null and rated_at is not null and movie is not null) as first_rating from ratings where \"user\" is not null and rated_at is not null and movie is not null group by 1")
def reduction_first_option(spark, folder):
    r = table(spark, folder, "ratings").where("user is not null and rated_at is not null and movie is not null")
    return Bag(r, key="user").group_by_key().agg(red.FIRST_OPTION.of("rating", F.struct("rated_at", "movie", "loaded_at")).alias("first_rating")).df.withColumnRenamed("user", "key")


@query("select cast(n_regionkey as integer) as n_regionkey, string_agg(n_name, '' order by n_name) as names from nation group by 1")
def reduction_string(spark, folder):
    return bag(spark, folder, "nation", key="n_regionkey", value="n_name").group_by_key().agg(red.STRING.of("n_name", "n_name").alias("names")).df


@query("select o_orderpriority, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') as states from orders group by 1")
def reduction_set(spark, folder):
    rows = Bag(table(spark, folder, "orders").select(F.col("o_orderpriority").alias("key"), F.array("o_orderstatus").alias("value")))
    return rows.group_by_key().combine(red.SORTED_SET).map(F.col("key").alias("o_orderpriority"), F.array_join("value", ",").alias("states")).df


@query("""with d as (select cast(l_linenumber as bigint) as x, l_shipmode from (select l_linenumber, l_returnflag as l_shipmode from lineitem)),
    c as (select l_shipmode, x % 10 as d, count(*) as n from d group by 1, 2)
    select l_shipmode as "key", cast(sum(n * d) % 10 as bigint) as total, case when bool_or(d in (2, 4, 6)) and bool_or(d = 5) then 0 end as prod from c group by 1""")
def reduction_digits(spark, folder):
    rows = bag(spark, folder, "lineitem", key="l_returnflag").group_by_key()
    x = F.col("l_linenumber").cast("bigint")
    return rows.agg(red.SUM_DIGIT.of(x).alias("total"), red.PRODUCT_DIGIT.of(x).cast("int").alias("prod")).df.withColumnRenamed("l_returnflag", "key")


@query("select symbol as \"key\", count(price) as n_ok, case when count(price) = 0 then count(*) end as n_error from ticks where symbol is not null group by 1")
def reduction_validation(spark, folder):
    ok, error = F.when(F.col("price").isNotNull(), 1), F.when(F.col("price").isNull(), 1)
    total = red.reduction(lambda a, b: a + b, F.sum)
    rows = Bag(table(spark, folder, "ticks").where("symbol is not null").select(F.col("symbol").alias("key"), F.struct(ok.alias("ok"), error.alias("error")).alias("value")))
    out = rows.group_by_key().combine(total.validation(total))
    return out.map("key", F.coalesce("value.ok", F.lit(0)).alias("n_ok"), F.col("value.error").alias("n_error")).df


@query("""select source as "key", string_agg(lang || '=' || n, ',' order by lang) as last_docs from
    (select source, lang, max(doc_id) as n from documents where source is not null and lang is not null group by 1, 2) group by 1""")
def reduction_map(spark, folder):
    d = table(spark, folder, "documents").where("source is not null and lang is not null")
    rows = Bag(d.groupBy("source", "lang").agg(F.max("doc_id").alias("doc_id")).select(F.col("source").alias("key"), F.create_map("lang", "doc_id").alias("m"), "doc_id"))
    out = rows.group_by_key().agg(red.MAP.of("m", "doc_id").alias("value"))
    entries = F.array_sort(F.transform(F.map_entries("value"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    return out.map("key", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("last_docs")).df


@query("select o_custkey, cast(sum(cast(floor(o_totalprice) as bigint)) as bigint) as units from orders group by 1")
def reduce_values(spark, folder):
    rows = Bag(table(spark, folder, "orders").select(F.col("o_custkey").alias("key"), F.floor("o_totalprice").alias("value")))
    return rows.group_by_key().reduce_values(lambda a, x: a + x).df.toDF("o_custkey", "units")


@query("select o_custkey, count(distinct o_orderpriority) as kinds from orders group by 1")
def combine_do(spark, folder):
    rows = keyed(spark, folder, "orders", "o_custkey", "o_orderpriority")
    return rows.group_by_key().combine_do(lambda a: F.size(F.array_distinct(a)).cast("bigint")).df.toDF("o_custkey", "kinds")


@query("select c_mktsegment, cast(sum(trunc(c_acctbal)) as bigint) // count(*) as mean from customer group by 1")
def integer_average(spark, folder):
    rows = bag(spark, folder, "customer", key="c_mktsegment").group_by_key()
    return rows.agg(F.sum(F.col("c_acctbal").cast("bigint")).alias("s"), F.count(F.lit(1)).alias("n")).map("c_mktsegment", F.expr("s div n").alias("mean")).df


# --- grouping


@query("select n_regionkey, string_agg(n_name, ',' order by n_nationkey desc) as names from nation group by 1")
def secondary_sort(spark, folder):
    g = Grouping().secondary_sort(-F.col("n_nationkey"))
    out = bag(spark, folder, "nation", key="n_regionkey", value="n_name").group_by_key(g).map_values(lambda a: F.array_join(a, ","))
    return out.map("n_regionkey", F.col("n_name").alias("names")).df


@query("select year(o_orderdate) as y, count(*) as n from orders group by 1")
def group_by_derived_key(spark, folder):
    return bag(spark, folder, "orders", "o_orderdate").group_by(F.year("o_orderdate").cast("bigint")).agg(F.count(F.lit(1)).alias("n")).df.toDF("y", "n")


@query("select min(name) as name, count(*) as n from employees where name is not null group by lower(trim(name))")
def grouping_contramap(spark, folder):
    g = Grouping().contramap(lambda k: F.lower(F.trim(k)))
    return bag(spark, folder, "employees", key="name").filter("name is not null").group_by_key(g).agg(F.count(F.lit(1)).alias("n")).map("name", "n").df


@query("select min(dept_id) as dept_id, count(*) as n from employees where dept_id is not null group by dept_id % 7, dept_id // 100")
def grouping_refine(spark, folder):
    g = Grouping().contramap(lambda k: k % 7).refine(Grouping().contramap(lambda k: F.floor(k / 100)))
    return bag(spark, folder, "employees", key="dept_id").filter("dept_id is not null").group_by_key(g).agg(F.count(F.lit(1)).alias("n")).df


@query("select min(p_size) as p_size, count(*) as n from part")
def grouping_all(spark, folder):
    return bag(spark, folder, "part", key="p_size").group_by_key(ALL).agg(F.count(F.lit(1)).alias("n")).df


# --- order and chance


@query("select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as index from orders")
def zip_with_index(spark, folder):
    return bag(spark, folder, "orders", "o_orderkey", "o_orderdate").zip_with_index([F.col("o_orderdate").asc(), F.col("o_orderkey").asc()]).map("o_orderkey", "index").df


@query("select count(*) as n, count(*) as different, cast(0 as bigint) as low, count(*) - 1 as high from lineitem")
def zip_with_any_index(spark, folder):
    z = bag(spark, folder, "lineitem", "l_orderkey").zip_with_index()
    return z.df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("index").alias("different"), F.min("index").alias("low"), F.max("index").alias("high"))


@query("select emp_id, dept_id from employees")
def shuffle(spark, folder):
    return bag(spark, folder, "employees", "emp_id", "dept_id").shuffle(11).df


# --- joins


def _staff(spark: SparkSession, folder: str) -> tuple[Bag, Bag]:
    return keyed(spark, folder, "employees", "dept_id", "emp_id"), keyed(spark, folder, "departments", "id", "name")


@query('select d.id as "key", e.emp_id as "left", d.name as "right" from employees e join departments d on e.dept_id = d.id')
def join_inner(spark, folder):
    return joins.join(*_staff(spark, folder)).df


@query('select e.dept_id as "key", e.emp_id as "left", d.name as "right" from employees e left join departments d on e.dept_id = d.id')
def join_left(spark, folder):
    return joins.join_left(*_staff(spark, folder)).df


@query('select d.id as "key", e.emp_id as "left", d.name as "right" from employees e right join departments d on e.dept_id = d.id')
def join_right(spark, folder):
    return joins.join_right(*_staff(spark, folder)).df


@query('select coalesce(e.dept_id, d.id) as "key", e.emp_id as "left", d.name as "right" from employees e full join departments d on e.dept_id = d.id')
def join_full(spark, folder):
    return joins.join_full(*_staff(spark, folder)).df


@query("""select coalesce(e.dept_id, d.id) as "key", case when e.emp_id is not null and d.id is not null then 'both ' || coalesce(d.name, '?') when d.id is null then 'left ' || e.emp_id else 'right ' || coalesce(d.name, '?') end as value
    from employees e full join departments d on e.dept_id = d.id""")
def join_full_with(spark, folder):
    named = lambda n: F.coalesce(n, F.lit("?"))
    return joins.join_full_with(*_staff(spark, folder), lambda k, a: F.concat(F.lit("left "), a.cast("string")), lambda k, b: F.concat(F.lit("right "), named(b)), lambda k, a, b: F.concat(F.lit("both "), named(b))).df


@query('select a.name as "key", a.emp_id as "left", b.id as "right" from (select name, max(emp_id) as emp_id from employees group by 1) a join departments b on a.name is not distinct from b.name')
def join_null_safe(spark, folder):
    e = Bag(table(spark, folder, "employees").groupBy(F.col("name").alias("key")).agg(F.max("emp_id").alias("value")))
    return joins.join(e, keyed(spark, folder, "departments", "name", "id"), null_safe=True).df


def _group_sizes(pair: Bag) -> DataFrame:
    return pair.map("key", F.size("left").cast("bigint").alias("left"), F.size("right").cast("bigint").alias("right")).df


@query("""select coalesce(c.k, s.k) as "key", coalesce(c.n, 0) as "left", coalesce(s.n, 0) as "right" from (select c_nationkey as k, count(*) as n from customer group by 1) c
    full join (select s_nationkey as k, count(*) as n from supplier group by 1) s on c.k = s.k""")
def cogroup_whole(spark, folder):
    return _group_sizes(joins.cogroup(keyed(spark, folder, "customer", "c_nationkey", "c_custkey"), keyed(spark, folder, "supplier", "s_nationkey", "s_suppkey")))


@query("""select coalesce(e.k, d.k) as "key", coalesce(e.n, 0) as "left", coalesce(d.n, 0) as "right" from (select dept_id as k, count(*) as n from employees group by 1) e
    full join (select id as k, count(*) as n from departments group by 1) d on e.k = d.k""")
def cogroup_unmatched(spark, folder):
    """Employees with departments: either side has keys that the other one lacks."""
    return _group_sizes(joins.cogroup(*_staff(spark, folder)))


@query('select coalesce(e.k, d.k) as "key", coalesce(e.n, 0) as "left", coalesce(d.n, 0) as "right" from (select dept_id as k, count(*) as n from employees group by 1) e full join (select id as k, count(*) as n from departments group by 1) d on e.k = d.k')
def cogroup_sizes(spark, folder):
    return joins.cogroup_sizes(*_staff(spark, folder)).df


@query('select d.id as "key", d.name as "left", e.emp_id as "right" from employees e join departments d on e.dept_id = d.id')
def block_join(spark, folder):
    staff, departments = _staff(spark, folder)
    return departments.replicate_by(5)(staff).df


@query('select dept_id as "key", emp_id as value from employees where dept_id in (select id from departments)')
def join_semi(spark, folder):
    return joins.semi(*_staff(spark, folder)).df


@query('select e.dept_id as "key", e.emp_id as value from employees e where not exists (select 1 from departments d where d.id = e.dept_id)')
def join_anti(spark, folder):
    return joins.anti(*_staff(spark, folder)).df


@query("select s_suppkey, s_acctbal, (select avg(s_acctbal) from supplier) as mean from supplier")
def scalar_join(spark, folder):
    s = bag(spark, folder, "supplier", "s_suppkey", "s_acctbal")
    return Scalar(s.df.agg(F.avg("s_acctbal").alias("mean"))).join(s).map("s_suppkey", "s_acctbal", "mean").df


# --- matrices: entries of all embeddings, row vec_id and col place in the vector


def _matrix(spark: SparkSession, folder: str) -> Matrix:
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "value"))
    return Matrix(e.select("row", F.col("col").cast("bigint").alias("col"), F.col("value").cast("double").alias("value")))


_M = "m as (select vec_id as r, i - 1 as c, cast(embedding[i] as double) as v from (select vec_id, embedding, unnest(generate_series(1, len(embedding))) as i from embeddings))"


@query(f"with {_M} select a.c as row, b.c as col, round(sum(a.v * b.v), 4) as value from m a join m b on a.r = b.r group by 1, 2")
def matmul(spark, folder):
    m = _matrix(spark, folder)
    return m.transpose().by_matrix(m).df.withColumn("value", F.round("value", 4))


@query(f"with {_M} select r as idx, round(sum(v * (c + 1)), 4) as value from m group by 1")
def mat_vec(spark, folder):
    m = _matrix(spark, folder)
    v = Vector(m.df.select(F.col("col").alias("idx")).distinct().withColumn("value", F.col("idx") + 1.0)).in_memory()
    return m.by_vector(v).df.withColumn("value", F.round("value", 4))


@query(f"with {_M} select r as idx, round(coalesce(sum(v * 2) filter (where c = 0 and v > 0), 0), 4) as value from m group by 1")
def mat_dense_vec(spark, folder):
    m = _matrix(spark, folder)
    positive = Matrix(m.df.where("value > 0 or col > 0").union(m.df.where("col = 0").withColumn("col", F.lit(-1).cast("bigint"))))
    v = Vector(spark.createDataFrame([(0, 2.0)], "idx bigint, value double"))
    return positive.by_dense_vector(v, 0.0).df.withColumn("value", F.round("value", 4))


@query(f"with {_M} select c as idx, round(sum(v), 4) as value from m group by 1")
def vec_mat(spark, folder):
    m = _matrix(spark, folder)
    ones = Vector(m.df.select(F.col("row").alias("idx")).distinct().withColumn("value", F.lit(1.0)))
    return ones.by_matrix(m).df.withColumn("value", F.round("value", 4))


@query(f"with {_M} select c as row, r as col, v as value from m")
def transpose(spark, folder):
    return _matrix(spark, folder).transpose().df


@query(f"with {_M} select r as row, cast(j as bigint) as col, round(sum(v * (c + j)), 4) as value from m, range(2) t(j) group by 1, 2")
def mat_function(spark, folder):
    two = lambda i: F.array(*[F.struct(F.lit(j).cast("bigint").alias("c"), (i + float(j)).alias("v")) for j in range(2)])
    return _matrix(spark, folder).by_function(two).df.withColumn("value", F.round("value", 4))


@query(f"with {_M} select a.c as row, b.c as col, round(min(a.v + b.v), 6) as value from m a join m b on a.r = b.r group by 1, 2")
def mat_min_plus(spark, folder):
    m = _matrix(spark, folder)
    return m.transpose().by_matrix(m, lambda a, b: a + b, red.MINIMUM).df.withColumn("value", F.round("value", 6))


# --- text and files


@query("""select event_id, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events where regexp_matches(props, '[0-9]+')""")
def delimited_extract(spark, folder):
    folder_out = scratch(spark)
    lines = bag(spark, folder, "events", "event_id", "props").map("event_id", F.regexp_extract("props", "([0-9]+)", 1).alias("k"))
    persisting.persist(text.to_delimited(lines, folder_out, ";"))
    return kept_from(text.from_delimited(spark, {"event_id": (0, a_long), "k": (1, a_long)}, folder_out, separator=";").df, folder_out)


@query("select c_name as value from customer")
def text_roundtrip(spark, folder):
    out = scratch(spark)
    persisting.persist(text.compressed(text.to_text(bag(spark, folder, "customer", "c_name"), out)))
    return kept_from(text.from_text(spark, out).df, out)


@query("select n_regionkey as region, n_name as value from nation")
def partitioned_roundtrip(spark, folder):
    out = scratch(spark)
    rows = bag(spark, folder, "nation", "n_name", "n_regionkey").map("n_name", F.col("n_regionkey").alias("region"))
    persisting.persist(text.to_partitioned_text(rows, out, ["region"]))
    return kept_from(spark.read.text(out).select(F.col("region").cast("int"), "value"), out)


@query('select s_suppkey as "key", s_name as value from supplier')
def sequence_roundtrip(spark, folder):
    out = scratch(spark)
    persisting.persist(sequence.to_sequence(keyed(spark, folder, "supplier", "s_suppkey", "s_name"), out))
    return kept_from(sequence.from_sequence(spark, T.LongType(), T.StringType(), out).df, out)


@query("select o_orderpriority, count(*) as n from orders group by 1")
def checkpoint_reuse(spark, folder):
    out = scratch(spark)
    make = lambda: bag(spark, folder, "orders").df.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    persisting.checkpointed(spark, out, make)
    return kept_from(persisting.checkpointed(spark, out, lambda: 1 / 0).df, out)


@query("select n_name, string_split(n_name, 'A')[1] as head from nation")
def split_fields(spark, folder):
    return bag(spark, folder, "nation").map("n_name", field(fields(F.col("n_name"), "A"), 0).alias("head")).df


# --- array functions


@query("""select vec_id, round(cast(embedding[1] as double), 6) as first, round(cast(embedding[-1] as double), 6) as last, cast(len(list_filter(embedding, lambda x: x > 0)) as integer) as positive,
    cast(coalesce(list_position(list_transform(embedding, lambda x: x < 0), true) - 1, -1) as integer) as first_negative, round(list_max(list_transform(embedding, lambda x: cast(x as double))), 6) as top from embeddings""")
def array_functions(spark, folder):
    e = F.col("embedding")
    top = ne.reduce_left(F.transform(e, lambda x: x.cast("double")), lambda a, b: F.greatest(a, b))
    return bag(spark, folder, "embeddings").map("vec_id", F.round(ne.first(e).cast("double"), 6).alias("first"), F.round(ne.last(e).cast("double"), 6).alias("last"), ne.count(e, lambda x: x > 0).alias("positive"), ne.index_where(e, lambda x: x < 0).alias("first_negative"), F.round(top, 6).alias("top")).df


# --- programs


def _links(spark: SparkSession, folder: str) -> DataFrame:
    """Parts and their suppliers, both ways."""
    one = table(spark, folder, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst")).distinct()
    return one.union(one.select("dst", "src"))


_LINKS = "e as (select distinct 'p' || l_partkey as src, 's' || l_suppkey as dst from lineitem), l as (select src, dst from e union all select dst, src from e), g as (select src, count(*) as n from l group by 1), v as (select distinct src as id from l)"


@query(f"""with {_LINKS}, r0 as (select id, 1.0::double as rank from v),
    r1 as (select v.id, 0.5 + 0.5 * coalesce(x.got, 0) as rank from v left join (select l.dst, sum(r.rank / g.n) as got from l join r0 r on l.src = r.id join g on g.src = l.src group by 1) x on x.dst = v.id),
    r2 as (select v.id, 0.5 + 0.5 * coalesce(x.got, 0) as rank from v left join (select l.dst, sum(r.rank / g.n) as got from l join r1 r on l.src = r.id join g on g.src = l.src group by 1) x on x.dst = v.id),
    r3 as (select v.id, 0.5 + 0.5 * coalesce(x.got, 0) as rank from v left join (select l.dst, sum(r.rank / g.n) as got from l join r2 r on l.src = r.id join g on g.src = l.src group by 1) x on x.dst = v.id)
    select id, round(rank, 6) as rank from r3""")
def page_ranks(spark, folder):
    return page_rank(_links(spark, folder), rounds=3).withColumn("rank", F.round("rank", 6))


@query(f"""with {_LINKS}, d0 as (select 's1' as id), d1 as (select distinct dst as id from l where src in (select id from d0)), d2 as (select distinct dst as id from l where src in (select id from d1)),
    d3 as (select distinct dst as id from l where src in (select id from d2)), d4 as (select distinct dst as id from l where src in (select id from d3))
    select id, min(d) as distance from (select id, 0 as d from d0 union all select id, 1 from d1 union all select id, 2 from d2 union all select id, 3 from d3 union all select id, 4 from d4) group by 1""")
def shortest_path(spark, folder):
    return shortest_paths(_links(spark, folder), spark.createDataFrame([("s1",)], "id string"), most=4)


@query("""with p as (select a.l_returnflag as f, b.l_returnflag as g, a.l_quantity as x, b.l_quantity as y from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber),
    s as (select f, g, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * y) as sxy, sum(x * x) as sxx, sum(y * y) as syy, max(x) as max_x, max(y) as max_y from p group by 1, 2)
    select f, g, n, max_x, max_y, round((n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)), 6) as correlation, round(sxy / (sqrt(sxx) * sqrt(syy)), 6) as cosine from s""")
def rating_similarity(spark, folder):
    """Paired lines of an order (seven at most), by their flags."""
    a = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("f"), F.col("l_quantity").alias("x"))
    b = a.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("m"), F.col("f").alias("g"), F.col("x").alias("y"))
    pairs = a.join(b, (F.col("l_orderkey") == F.col("o")) & (F.col("l_linenumber") < F.col("m")))
    return similarity(pairs, "f", "g").withColumns({"correlation": F.round("correlation", 6), "cosine": F.round("cosine", 6)})


@query("select n_chars // 1000 as bucket, count(*) as n from documents where n_chars is not null group by 1")
def length_histogram(spark, folder):
    d: Column = F.floor(F.col("n_chars") / 1000)
    return bag(spark, folder, "documents", "n_chars").filter("n_chars is not null").group_by(d).agg(F.count(F.lit(1)).alias("n")).df.toDF("bucket", "n")
