"""Equi-joins of keyed lists.

Keys match by ``=``, so null keys match nothing; with null_safe=True nulls match nulls. Catalyst picks broadcast, hash or sort-merge joins and adaptive
execution splits skewed partitions; ``block_join`` spreads a skewed side whatever the settings are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.bag import Bag
from millrace.session import steady

_FROM = ("__left", "__right")


def _sides(a: Bag, b: Bag, null_safe: bool) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides as key, left or right value and a mark of presence, by which a null value can be told from a missing row."""
    left = a.df.select(F.col(a.key).alias("__lk"), F.col(a.value).alias("left"), F.lit(True).alias(_FROM[0]))
    right = b.df.select(F.col(b.key).alias("__rk"), F.col(b.value).alias("right"), F.lit(True).alias(_FROM[1]))
    on = F.col("__lk").eqNullSafe(F.col("__rk")) if null_safe else F.col("__lk") == F.col("__rk")
    return left, right, on


def _key(name: str) -> Column:
    return F.coalesce("__lk", "__rk").alias(name)


def _out(a: Bag, df: DataFrame) -> Bag:
    return replace(a, df=df, value="value", sinks=())


def _join(a: Bag, b: Bag, how: str, null_safe: bool) -> Bag:
    left, right, on = _sides(a, b, null_safe)
    return _out(a, left.join(right, on, how).select(_key(a.key), "left", "right"))


def join(a: Bag, b: Bag, null_safe: bool = False) -> Bag:
    """Columns key, left, right: every pair of values of equal keys."""
    return _join(a, b, "inner", null_safe)


def join_left(a: Bag, b: Bag, null_safe: bool = False) -> Bag:
    """Every value of the left side; right is null where there is no match."""
    return _join(a, b, "left", null_safe)


def join_right(a: Bag, b: Bag, null_safe: bool = False) -> Bag:
    return _join(a, b, "right", null_safe)


def join_full(a: Bag, b: Bag, null_safe: bool = False) -> Bag:
    return _join(a, b, "full", null_safe)


def join_full_with(a: Bag, b: Bag, has_left: Callable[[Column, Column], Column], has_right: Callable[[Column, Column], Column], has_both: Callable[[Column, Column, Column], Column], null_safe: bool = False) -> Bag:
    """Columns key, value: has_left(key, a), has_right(key, b) or has_both(key, a, b), by which sides have the key; a null value counts as being there."""
    left, right, on = _sides(a, b, null_safe)
    k, x, y = F.coalesce("__lk", "__rk"), F.col("left"), F.col("right")
    value = F.when(F.col(_FROM[0]) & F.col(_FROM[1]), has_both(k, x, y)).when(F.col(_FROM[0]), has_left(k, x)).otherwise(has_right(k, y))
    return _out(a, left.join(right, on, "full").select(_key(a.key), value.alias("value")))


def cogroup(a: Bag, b: Bag, null_safe: bool = False) -> Bag:
    """Columns key, left, right: the arrays of both sides' values of a key, empty where a side has none. Each side is grouped before the join, so no pairs are formed."""

    def grouped(bag: Bag, key: str, name: str) -> DataFrame:
        boxed = F.collect_list(F.struct(F.col(bag.value).alias("v")))
        return bag.df.groupBy(F.col(bag.key).alias(key)).agg(F.transform(boxed, lambda x: x["v"]).alias(name))

    left, right = grouped(a, "__lk", "left"), grouped(b, "__rk", "right")
    on = F.col("__lk").eqNullSafe(F.col("__rk")) if null_safe else F.col("__lk") == F.col("__rk")
    return _out(a, left.join(right, on, "full").select(_key(a.key), F.coalesce("left", F.array()).alias("left"), F.coalesce("right", F.array()).alias("right")))


def cogroup_sizes(a: Bag, b: Bag) -> Bag:
    """As cogroup where only the sizes matter: counted with partial results, no arrays."""
    left = a.df.groupBy(F.col(a.key).alias("__lk")).agg(F.count(F.lit(1)).alias("left"))
    right = b.df.groupBy(F.col(b.key).alias("__rk")).agg(F.count(F.lit(1)).alias("right"))
    joined = left.join(right, F.col("__lk") == F.col("__rk"), "full")
    return _out(a, joined.select(_key(a.key), F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("right", F.lit(0)).alias("right")))


def block_join(a: Bag, b: Bag, copies: int = 5) -> Bag:
    """The inner join, with the left side copied ``copies`` times and the right side's rows of a key dealt out over the copies: for a right side with heavy keys.

    Rows are dealt by a hash of their place, not by a fresh random number, so that a task that is run again deals them the same way (rows out of a shuffle are checkpointed first). The result does not depend on it.
    """
    if copies < 1:
        raise ValueError("copies must be at least 1")
    left, right, on = _sides(a, replace(b, df=steady(b.df)), False)
    left = left.withColumn("__ls", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    right = right.withColumn("__rs", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(copies)).cast("int"))
    return _out(a, left.join(right, on & (F.col("__ls") == F.col("__rs"))).select(_key(a.key), "left", "right"))


def semi(a: Bag, b: Bag) -> Bag:
    """Elements of the left side whose key the right side has."""
    return replace(a, df=a.df.join(b.df.select(F.col(b.key).alias("__rk")), F.col(a.key) == F.col("__rk"), "left_semi"), sinks=())


def anti(a: Bag, b: Bag) -> Bag:
    """Elements of the left side whose key the right side has not."""
    return replace(a, df=a.df.join(b.df.select(F.col(b.key).alias("__rk")), F.col(a.key) == F.col("__rk"), "left_anti"), sinks=())
