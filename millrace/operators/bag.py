"""Lazily evaluated distributed lists, grouped lists and scalars on DataFrames.

A Bag holds one DataFrame; every method returns a new Bag and only says what is wanted. Arguments are Column expressions first, so that Catalyst sees through them; Python functions
are taken by the methods that say so, and run over Arrow batches.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.grouping import BY_KEY, Grouping
from millrace.operators.ordered import chain, edges, fresh, numbered, with_offsets
from millrace.operators.reductions import Reduction
from millrace.operators.rows import Counters, DoFn, GroupFn, batches_of, each_group, each_row, folded, reduced, schema_of
from millrace.session import cut, shuffle_partitions

__all__ = ["Bag", "Counter", "Counters", "DoFn", "GroupFn", "Grouped", "Scalar"]

Expr = Column | str


def _col(e: Expr) -> Column:
    return F.col(e) if isinstance(e, str) else e


@dataclass(frozen=True)
class Bag:
    """An unordered distributed list that keeps duplicates. key and value name the columns of a keyed list."""

    df: DataFrame
    key: str = "key"
    value: str = "value"
    sinks: tuple = field(default=(), compare=False)

    # --- making

    @staticmethod
    def of(spark: SparkSession, elements: Iterable, schema: T.StructType | str) -> Bag:
        """A literal list; the schema is always given, so an empty list has one too. Elements that aren't tuples go to a single column."""
        rows = [e if isinstance(e, (tuple, list, dict)) else (e,) for e in elements]
        return Bag(spark.createDataFrame(rows, schema))

    @staticmethod
    def range(spark: SparkSession, start: int, stop: int) -> Bag:
        return Bag(spark.range(start, stop).withColumnRenamed("id", "value"))

    @staticmethod
    def tabulate(spark: SparkSession, n: int, f: Callable[[Column], Column]) -> Bag:
        """f(0), ..., f(n - 1), made where they are needed."""
        return Bag(spark.range(n).select(f(F.col("id")).alias("value")))

    @staticmethod
    def fill(spark: SparkSession, n: int, value: Any) -> Bag:
        return Bag.tabulate(spark, n, lambda _: F.lit(value))

    @staticmethod
    def lazy(spark: SparkSession, thunk: Callable[[], Iterable], schema: T.StructType | str) -> Bag:
        """Elements that are computed only when the list is run (in one task, once per run)."""
        wanted = schema_of(spark, schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                pass
            yield from batches_of((e if isinstance(e, (tuple, list)) else (e,) for e in thunk()), wanted)

        return Bag(spark.range(0, 1, 1, 1).mapInArrow(run, wanted))

    @staticmethod
    def concat(bags: list[Bag]) -> Bag:
        """All lists one behind the other; ValueError for no list, as there would be no schema."""
        if not bags:
            raise ValueError("concat of no lists")
        return bags[0].union(*bags[1:])

    def _with(self, df: DataFrame, **names: str) -> Bag:
        return replace(self, df=df, sinks=(), **names)

    # --- row by row

    def map(self, *exprs: Expr) -> Bag:
        return self._with(self.df.select(*exprs))

    def map_rows(self, f: Callable[[dict], Any], schema: T.StructType | str) -> Bag:
        """map with a Python function of a row; adjacent Python steps are best put into one function."""
        return self.flat_map_rows(lambda row: (f(row),), schema)

    def flat_map_rows(self, f: Callable[[dict], Iterable], schema: T.StructType | str) -> Bag:
        class Each(DoFn):
            def process(self, env: Any, row: dict) -> Iterable:
                return f(row)

        return self.parallel_do(Each(), schema)

    def map_flatten(self, array: Expr, name: str = "value") -> Bag:
        """One element for each element of an array expression; null and empty arrays give none."""
        return self._with(self.df.select(F.explode(_col(array)).alias(name)))

    def flatten(self) -> Bag:
        return self.map_flatten(self.value, self.value)

    def filter(self, condition: Expr) -> Bag:
        return self._with(self.df.where(condition))

    with_filter = filter

    def filter_not(self, condition: Expr) -> Bag:
        """Elements for which the condition does not hold; where it is null it does not hold."""
        c = F.expr(condition) if isinstance(condition, str) else condition
        return self._with(self.df.where(~F.coalesce(c, F.lit(False))))

    def collect(self, guard: Expr, *exprs: Expr) -> Bag:
        """A partial function: where it is defined, and what it gives there."""
        return self._with(self.df.where(guard).select(*exprs))

    def map_keys(self, f: Callable[[Column], Column]) -> Bag:
        return self._with(self.df.withColumn(self.key, f(F.col(self.key))))

    def map_values(self, f: Callable[[Column], Column]) -> Bag:
        return self._with(self.df.withColumn(self.value, f(F.col(self.value))))

    def keys(self) -> Bag:
        return self._with(self.df.select(self.key))

    def values(self) -> Bag:
        return self._with(self.df.select(self.value))

    def by(self, key: Expr) -> Bag:
        """Keyed by an expression: key, and the whole element as value."""
        whole = F.struct("*") if len(self.df.columns) > 1 else F.col(self.df.columns[0])
        return self._with(self.df.select(_col(key).alias("key"), whole.alias("value")), key="key", value="value")

    def partition(self, condition: Column) -> tuple[Bag, Bag]:
        return self.filter(condition), self.filter_not(condition)

    def stratify(self, n: int, stratum: Column) -> list[Bag]:
        """n lists by a whole number; elements whose number is not in 0..n-1 (or null) are in none."""
        return [self.filter(stratum == k) for k in range(n)]

    def stratify_weighted(self, weights: list[float], seed: int = 0) -> list[Bag]:
        """A random split by weight. The list is checkpointed first: parts of one split must see the same rows in the same order."""
        return [self._with(d) for d in cut(self.df).randomSplit([float(w) for w in weights], seed)]

    def parallel_do(self, fn: DoFn, schema: T.StructType | str, env: Scalar | None = None, counters: Counters | None = None) -> Bag:
        """The general row function: none, one or many rows out for each row in, over Arrow batches.

        Values come as Python objects (arrays as lists, structs and maps as dicts, nulls as None). env: a scalar that is given to every call; it is computed when the list runs, and travels in the
        first row of each partition only. counters: where ``fn.context.count`` adds up, with the rows of every task under "rows by task". Partitions without rows have no life cycle.
        """
        df, name = self.df, None
        if env is not None:
            name = fresh(df.columns, "env")
            df = env.beside(df, name).withColumn(name, F.when(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0, F.col(name)))
        return self._with(each_row(df, fn, schema, counters, name))

    def counted(self, group: str, name: str, condition: Column | None = None) -> tuple[Bag, Counter]:
        """The same list, with a counter of its elements (or of those that meet a condition) which has its value once the list has run."""
        seen = Observation(f"{group}.{name}")
        n = F.count(F.lit(1)) if condition is None else F.count_if(condition)
        return self._with(self.df.observe(seen, n.alias(name))), Counter(seen, name)

    def partition_sizes(self) -> Bag:
        """Elements per partition, as tasks see them."""
        return self._with(self.df.groupBy(F.spark_partition_id().alias("key")).agg(F.count(F.lit(1)).alias("value")), key="key", value="value")

    # --- grouping

    def group_by_key(self, grouping: Grouping = BY_KEY) -> Grouped:
        """Groups lazily: values are only brought together if they are looked at, else the next reduction is fused in."""
        return Grouped(self, grouping)

    def group_by(self, key: Expr, grouping: Grouping = BY_KEY) -> Grouped:
        return Grouped(self.by(key), grouping)

    # --- one value out of many

    def _one(self, *aggs: Column, empty: str = "none") -> Scalar:
        """Aggregates that have a value for an empty list too."""
        return Scalar(self.df.agg(*aggs), empty)

    def _some(self, agg: Column, empty: str = "raise") -> Scalar:
        """An aggregate that an empty list has not: then there is no row."""
        return Scalar(self.df.agg(agg.alias("value"), F.count(F.lit(1)).alias("__n")).where("__n > 0").select("value"), empty)

    def sum(self, value: Expr | None = None) -> Scalar:
        """0 for an empty list. Whole numbers are summed as bigint and overflow raises."""
        return self._one(F.coalesce(F.sum(_col(value or self.value)), F.lit(0)).alias("value"))

    def product(self, value: Expr | None = None) -> Scalar:
        """1 for an empty list."""
        return self._one(F.coalesce(F.product(_col(value or self.value)), F.lit(1.0)).alias("value"))

    def length(self) -> Scalar:
        return self._one(F.count(F.lit(1)).alias("value"))

    size = length

    def count(self, condition: Expr) -> Scalar:
        return self._one(F.count_if(F.expr(condition) if isinstance(condition, str) else condition).alias("value"))

    def max(self, value: Expr | None = None) -> Scalar:
        """The greatest value; None if all are null, ValueError for an empty list."""
        return self._some(F.max(_col(value or self.value)))

    def min(self, value: Expr | None = None) -> Scalar:
        return self._some(F.min(_col(value or self.value)))

    def max_by(self, by: Expr) -> Scalar:
        """The element with the greatest ``by``, of equals the greatest element."""
        whole = F.struct("*")
        return self._some(F.max_by(whole, F.struct(_col(by), whole)))

    def min_by(self, by: Expr) -> Scalar:
        whole = F.struct("*")
        return self._some(F.min_by(whole, F.struct(_col(by), whole)))

    def reduce(self, r: Reduction, value: Expr | None = None, order: Expr | None = None) -> Scalar:
        """ValueError on running it for an empty list."""
        return replace(self.reduce_option(r, value, order), empty="raise")

    def reduce_option(self, r: Reduction, value: Expr | None = None, order: Expr | None = None) -> Scalar:
        """None for an empty list."""
        c = _col(value or self.value)
        if r.agg is not None:
            return self._some(r.of(c, order), "none")
        keyed = Bag(self.df.select(F.lit(1).alias("key"), c.alias("value")))
        return Scalar(keyed.group_by_key().combine(r).df.select("value"), "none")

    def fold(self, r: Reduction, value: Expr | None = None, order: Expr | None = None) -> Scalar:
        """Reduces from the reduction's zero, which is also the result for an empty list."""
        if r.zero is None:
            raise ValueError(f"{r.name} has no zero")
        out = self.reduce_option(r, value, order)
        return replace(out, empty=("value", r.zero))

    def fold_map(self, f: Callable[[Column], Column], r: Reduction) -> Scalar:
        return self.map_values(f).fold(r)

    def head(self) -> Scalar:
        """Some element."""
        return Scalar(self.df.limit(1), "raise")

    def head_option(self) -> Scalar:
        return Scalar(self.df.limit(1), "none")

    def distinct(self, *columns: str) -> Bag:
        return self._with(self.df.dropDuplicates(list(columns)) if columns else self.df.distinct())

    def is_equal(self, other: Bag, grouping: Grouping = BY_KEY) -> Scalar:
        """Whether both lists hold the same elements equally often; the order of columns counts, their names don't. grouping: what makes elements equal (of a list of one column, its value; else the struct of all)."""
        names = self.df.columns
        if len(names) != len(other.df.columns):
            return Scalar(self.df.sparkSession.range(1).select(F.lit(False).alias("value")), "none")
        mark = fresh(names, "mark")
        both = self.df.withColumn(mark, F.lit(1)).union(other.df.toDF(*names).withColumn(mark, F.lit(-1)))
        by = [F.col(f"`{c}`") for c in names]
        if grouping is not BY_KEY:
            by = grouping.keys(by[0] if len(by) == 1 else F.struct(*by))
        left = both.groupBy(*by).agg(F.sum(mark).alias(mark)).where(F.col(mark) != 0)
        return Scalar(left.agg((F.count(F.lit(1)) == 0).alias("value")), "none")

    # --- lists as bags and sets

    def union(self, *others: Bag) -> Bag:
        return self._with(functools.reduce(lambda a, b: a.union(b.df), others, self.df))

    def __add__(self, other: Bag) -> Bag:
        return self.union(other)

    def diff(self, other: Bag) -> Bag:
        """Bag difference: each element of the other takes one equal element off."""
        return self._with(self.df.exceptAll(other.df))

    def distinct_diff(self, other: Bag) -> Bag:
        """Set difference."""
        return self._with(self.df.subtract(other.df))

    # --- order

    def zip_with_index(self, order: list[Column] | None = None, name: str = "index") -> Bag:
        """Each element with a number from 0 to size - 1: in the given order (by a global sort on sampled quantiles), else in any order.

        Partitions are numbered on their own and shifted by the sizes of those before, one row per partition.
        """
        name = fresh(self.df.columns, name)
        one = fresh(self.df.columns, "one")
        if order:
            rows, at = numbered(self.df.withColumn(one, F.lit(1)), [one], order)
            out, offset = with_offsets(rows, chain(edges(rows, [one], at["pid"], at["gid"], F.lit(1))), at["pid"], at["gid"])
            return self._with(out.select(*self.df.columns, (F.col(at["place"]) + F.col(offset) - 1).alias(name)))
        here = cut(self.df.withColumn(one, F.monotonically_increasing_id()))
        pid = F.shiftright(one, 33)
        sizes = sorted((r[0], r[1]) for r in here.groupBy(pid).agg(F.count(F.lit(1))).collect())
        starts = itertools.accumulate((n for _, n in sizes), initial=0)
        table = here.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts, strict=False)], "__pid bigint, __start bigint")
        out = here.join(F.broadcast(table), pid == F.col("__pid"))
        return self._with(out.select(*self.df.columns, (F.col("__start") + F.col(one).bitwiseAND(F.lit((1 << 33) - 1))).alias(name)))

    def shuffle(self, seed: int = 0) -> Bag:
        """The elements in random order."""
        return self._with(self.df.orderBy(F.rand(seed)))

    def top(self, n: int, *order: Column) -> Bag:
        return self._with(self.df.orderBy(*order).limit(n))

    # --- joins: see joins.py

    def join(self, other: Bag, **options: Any) -> Bag:
        from millrace.operators import joins

        return joins.join(self, other, **options)

    def join_left(self, other: Bag, **options: Any) -> Bag:
        from millrace.operators import joins

        return joins.join_left(self, other, **options)

    outer_join = join_left

    def join_right(self, other: Bag, **options: Any) -> Bag:
        from millrace.operators import joins

        return joins.join_right(self, other, **options)

    def join_full(self, other: Bag, **options: Any) -> Bag:
        from millrace.operators import joins

        return joins.join_full(self, other, **options)

    def join_full_with(self, other: Bag, left: Callable, right: Callable, both: Callable, **options: Any) -> Bag:
        from millrace.operators import joins

        return joins.join_full_with(self, other, left, right, both, **options)

    def cogroup(self, other: Bag, **options: Any) -> Bag:
        from millrace.operators import joins

        return joins.cogroup(self, other, **options)

    def block_join(self, other: Bag, **options: Any) -> Bag:
        from millrace.operators import joins

        return joins.block_join(self, other, **options)

    def replicate_by(self, n: int) -> Callable[..., Bag]:
        """block_join with n copies of this side."""
        return lambda other, **options: self.block_join(other, copies=n, **options)

    # --- running

    def materialise(self) -> Scalar:
        """All elements as one list value (they come to the driver when it is run)."""
        return Scalar(self.df, "list")

    def run(self) -> list:
        """The elements, as values if there is one column and as tuples otherwise."""
        rows = self.df.collect()
        return [r[0] for r in rows] if len(self.df.columns) == 1 else [tuple(r) for r in rows]

    def iterate(self) -> Iterator:
        """The elements partition by partition, without holding all of them."""
        one = len(self.df.columns) == 1
        return (r[0] if one else tuple(r) for r in self.df.toLocalIterator())

    def cached(self) -> Bag:
        return self._with(self.df.persist())

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)

    def add_sink(self, write: Callable[[DataFrame], None]) -> Bag:
        """Adds what ``persist`` shall do with the list: a function that writes a DataFrame."""
        return replace(self, sinks=(*self.sinks, write))

    def update_sinks(self, f: Callable[[tuple], tuple]) -> Bag:
        return replace(self, sinks=tuple(f(self.sinks)))


@dataclass(frozen=True)
class Counter:
    """A named count which is there once the list that it belongs to has run."""

    seen: Observation
    name: str

    @property
    def value(self) -> int:
        return int(self.seen.get[self.name])


NO_VALUE = "no value: the list is empty"


@dataclass(frozen=True)
class Scalar:
    """A lazy value: a frame of one row. empty: what it is if there is no row: raise, none, or ("value", x); list takes all rows as one value. A row that holds null is a value, None."""

    df: DataFrame
    empty: str | tuple = "none"

    @staticmethod
    def of(spark: SparkSession, value: Any, schema: str = "") -> Scalar:
        if schema:
            return Scalar(spark.createDataFrame([(value,)], schema))
        return Scalar(spark.range(1).select(F.lit(value).alias("value")))

    @staticmethod
    def lazy(spark: SparkSession, thunk: Callable[[], Any], schema: str) -> Scalar:
        """A value of one column that is computed only when it is run."""
        return Scalar(Bag.lazy(spark, lambda: [(thunk(),)], schema).df)

    def map(self, *exprs: Expr) -> Scalar:
        return Scalar(self.df.select(*exprs), self.empty)

    def map_value(self, f: Callable[[Column], Column]) -> Scalar:
        return Scalar(self.df.select(f(F.col(self.df.columns[0])).alias("value")), self.empty)

    def settled(self, name: str = "value") -> DataFrame:
        """One column and always one row, in which what an empty value stands for is already in place; raises when it is run if that is to raise."""
        whole = F.col(f"`{self.df.columns[0]}`") if len(self.df.columns) == 1 else F.struct("*")
        if self.empty == "list":
            return self.df.agg(F.transform(F.collect_list(F.struct(whole.alias("v"))), lambda x: x["v"]).alias(name))
        held = self.df.limit(1).agg(F.first(F.struct(whole.alias("v"))).alias("b"))
        there = self.df.select(whole.alias("v")).schema["v"].dataType
        none = F.raise_error(F.lit(NO_VALUE)).cast(there) if self.empty == "raise" else F.lit(self.empty[1] if isinstance(self.empty, tuple) else None).cast(there)
        return held.select(F.when(F.col("b").isNull(), none).otherwise(F.col("b.v")).alias(name))

    def beside(self, df: DataFrame, name: str) -> DataFrame:
        """df with the value as a last column; the frame that is broadcast has one row."""
        one = fresh([*df.columns, name], "one")
        side = F.broadcast(self.settled(name).withColumn(one, F.lit(1)))
        return df.withColumn(one, F.lit(1)).join(side, one).select(*[F.col(f"`{c}`") for c in df.columns], F.col(f"`{name}`"))

    def zip(self, *others: Scalar) -> Scalar:
        """Up to eight values side by side, as columns _1, _2, ...: each is a single row, so they meet on a constant. Each keeps its own rule for being empty, so it raises if one of them does."""
        parts = [s.settled(f"_{k + 1}").withColumn("__one", F.lit(1)) for k, s in enumerate((self, *others))]
        return Scalar(functools.reduce(lambda a, b: a.join(F.broadcast(b), "__one"), parts).drop("__one"), "none")

    def join(self, bag: Bag) -> Bag:
        """The value beside every element of a list; the frame that is broadcast has one row."""
        taken = list(bag.df.columns)
        if len(self.df.columns) == 1 or self.empty == "list":
            name = self.df.columns[0] if self.df.columns[0] not in taken else fresh(taken, f"scalar_{self.df.columns[0]}")
            return replace(bag, df=self.beside(bag.df, name).select(F.col(f"`{name}`"), *[F.col(f"`{c}`") for c in taken]), sinks=())
        names: list[str] = []
        for c in self.df.columns:
            names.append(fresh([*taken, *names], c if c not in taken else f"scalar_{c}"))
        box = fresh([*taken, *names], "box")
        joined = self.beside(bag.df, box)
        return replace(bag, df=joined.select(*[F.col(f"`{box}`").getField(c).alias(n) for c, n in zip(self.df.columns, names, strict=True)], *[F.col(f"`{c}`") for c in taken]), sinks=())

    def to_bag(self) -> Bag:
        """A list of the single value."""
        return Bag(self.df)

    to_single_element_bag = to_bag

    def elements(self) -> Bag:
        """A value that is a list, as a distributed list of its elements."""
        if self.empty == "list":
            return Bag(self.df)
        return Bag(self.df.select(F.explode(F.col(self.df.columns[0])).alias("value")))

    def run(self) -> Any:
        one = len(self.df.columns) == 1
        if self.empty == "list":
            return [r[0] if one else tuple(r) for r in self.df.collect()]
        try:
            row = self.df.head()
        except PySparkException as e:
            if NO_VALUE in str(e):
                raise ValueError(NO_VALUE) from None
            raise
        if row is None:
            if self.empty == "raise":
                raise ValueError(NO_VALUE)
            return self.empty[1] if isinstance(self.empty, tuple) else None
        return row[0] if one else tuple(row)


@dataclass(frozen=True)
class Grouped:
    """Keys with their values, not yet brought together. A group is never empty."""

    bag: Bag
    grouping: Grouping = BY_KEY

    def _keys(self) -> list[Column]:
        plain = self.grouping.keys is BY_KEY.keys
        return [F.col(self.bag.key)] if plain else [k.alias(f"__k{i}") for i, k in enumerate(self.grouping.keys(F.col(self.bag.key)))]

    def agg(self, *aggs: Column) -> Bag:
        """One row per group: its key (of keys that count as equal the least) and the aggregates, all in one aggregation with partial results before the shuffle."""
        keys = self._keys()
        plain = self.grouping.keys is BY_KEY.keys
        out = self.bag.df.groupBy(*keys).agg(*([] if plain else [F.min(self.bag.key).alias("__key")]), *aggs)
        if not plain:
            out = out.drop(*[c for c in out.columns if c.startswith("__k") and c != "__key"]).withColumnRenamed("__key", self.bag.key)
        return self.bag._with(out)

    def lists(self) -> Bag:
        """Keys with arrays of their values, sorted by the grouping's order if it has one. A group becomes one row; use ``combine`` wherever a reduction will do."""
        v = F.col(self.bag.value)
        if not self.grouping.order:
            return self.agg(F.transform(F.collect_list(F.struct(v.alias("v"))), lambda x: x["v"]).alias(self.bag.value))  # boxed, so that nulls stay
        boxed = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(self.grouping.order)], v.alias("v"))
        return self.agg(F.transform(F.array_sort(F.collect_list(boxed)), lambda x: x["v"]).alias(self.bag.value))

    def map_values(self, f: Callable[[Column], Column]) -> Bag:
        """f of each group's array of values."""
        return self.lists().map_values(f)

    def map_each(self, f: Callable[[Column], Column]) -> Grouped:
        """f of each single value, before they are brought together."""
        return Grouped(self.bag.map_values(f), self.grouping)

    def map_keys(self, f: Callable[[Column], Column]) -> Bag:
        return self.lists().map_keys(f)

    def bimap(self, fk: Callable[[Column], Column], fv: Callable[[Column], Column]) -> Bag:
        """fk of each key, fv of each group's array of values."""
        return self.lists().map_keys(fk).map_values(fv)

    def map_groups(self, f: Callable[[Column, Column], Column], name: str = "value") -> Bag:
        """f of a key and its array of values."""
        whole = self.lists()
        return whole._with(whole.df.select(f(F.col(self.bag.key), F.col(self.bag.value)).alias(name)))

    def flat_values(self, f: Callable[[Column], Column] = lambda a: a) -> Bag:
        """Key and single values: f of each group's array, taken apart again."""
        out = self.lists().map_values(f)
        return out._with(out.df.select(self.bag.key, F.explode(self.bag.value).alias(self.bag.value)))

    def keys(self) -> Bag:
        return self.agg(F.count(F.lit(1)).alias(fresh(self.bag.df.columns, "n"))).keys()

    def values(self) -> Bag:
        return self.lists().values()

    def combine(self, r: Reduction, order: Expr | None = None) -> Bag:
        """Key and reduced value. With a column form the reduction is one hash aggregation; otherwise each partition reduces what it holds and a sorted pass per key reduces the parts, so no group is held in memory."""
        if r.agg is not None:
            return self.agg(r.of(F.col(self.bag.value), order).alias(self.bag.value))
        if r.ordered or order is not None:
            raise TypeError("a Python reduction has no order to go by")
        rows = self._identified(partial=True)
        whole = T.StructType([rows.schema[self.bag.key], rows.schema[self.bag.value]])
        parts = reduced(rows, r.op)
        placed = self._sorted(self._spread(parts), [])
        return self.bag._with(each_group(placed, ["__h", "__k"], self.bag.key, self.bag.value, folded(r.op)(), whole, None, None))

    def _identified(self, partial: bool = False) -> DataFrame:
        """Rows with a hash and a text of what makes their keys equal (and, unless partial results go first, the columns that partition and order them)."""
        key, value = self.bag.key, self.bag.value
        canonical = F.struct(*self.grouping.keys(F.col(key)))
        ids = [F.xxhash64(canonical).alias("__h"), F.to_json(F.struct(canonical.alias("k")), {"ignoreNullFields": "false"}).alias("__k")]
        return self.bag.df.select(*ids, key, value, *([] if partial else [o.alias(f"__o{k}") for k, o in enumerate(self.grouping.order)]))

    def _spread(self, rows: DataFrame) -> DataFrame:
        """Every group in one partition."""
        g, n = self.grouping, shuffle_partitions(rows.sparkSession)
        return rows.repartition("__h") if g.partition is None else rows.repartitionById(n, F.pmod(g.partition(F.col(self.bag.key), n), F.lit(n)).cast("int"))

    def _sorted(self, rows: DataFrame, within: list[str]) -> DataFrame:
        """Groups in the grouping's own order if it has one, values in theirs."""
        return rows.sortWithinPartitions(*self.grouping.sort(F.col(self.bag.key)), "__h", "__k", *within)

    def parallel_do(self, fn: GroupFn, schema: T.StructType | str, env: Scalar | None = None, counters: Counters | None = None) -> Bag:
        """The general function of a group: none, one or many rows out for each key, whose values it gets one after the other in the grouping's order, so that no group is held in memory.

        env and counters as in ``Bag.parallel_do``. Partitions are those of the grouping (its partition function, else a hash of the key), and groups come in its order within a partition.
        """
        rows = self._identified()
        order = [c for c in rows.columns if c.startswith("__o")]
        name = fresh(rows.columns, "env") if env is not None else None
        spread = self._spread(rows)
        rows = self._sorted(env.beside(spread, name) if env is not None else spread, order).drop(*order)  # a sort below a join would be dropped
        if name:
            rows = rows.withColumn(name, F.when(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0, F.col(name)))
        return self.bag._with(each_group(rows, ["__h", "__k"], self.bag.key, self.bag.value, fn, schema, counters, name))

    def combine_do(self, f: Callable[[Column], Column]) -> Bag:
        """f of a group's array of values, applied once and giving one value per key."""
        return self.lists().map_values(f)

    def combine_rows(self, f: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> Bag:
        """A Python function of each group's rows, as a pandas frame (a group must fit into one task)."""
        return self.bag._with(self.bag.df.groupBy(self.bag.key).applyInPandas(f, schema))

    def reduce_values(self, op: Callable[[Column, Column], Column]) -> Bag:
        """Values of each group put together by a binary column operation, in the grouping's order; values must not be null."""
        return self.lists().map_values(lambda a: F.reduce(F.slice(a, 2, F.greatest(F.size(a), F.lit(1))), F.element_at(a, 1), op))

    def reduce_values_option(self, op: Callable[[Column, Column], Column]) -> Bag:
        """As reduce_values, and null for a group of nulls only."""
        return self.lists().map_values(lambda a: F.when(F.size(a) > 0, F.reduce(F.slice(a, 2, F.greatest(F.size(a), F.lit(1))), F.try_element_at(a, F.lit(1)), op)))
