"""Operations on array columns that stand for ordered collections of at least one element, and on keys with such collections.

All are expressions of built-in higher-order functions. For a null array the result is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Unary = Callable[[Column], Column]
Binary = Callable[[Column, Column], Column]


def single(x: Column) -> Column:
    return F.array(x)


def many(x: Column, *more: Column) -> Column:
    return F.array(x, *more)


def counted_from(start: Column, n: Column) -> Column:
    """n whole numbers from start."""
    return F.sequence(start, start + n - 1)


def iterate(start: Column, f: Unary, n: int) -> Column:
    """start, f(start), f(f(start)), ...: n elements."""
    out, x = [start], start
    for _ in range(n - 1):
        x = f(x)
        out.append(x)
    return F.array(*out)


map_ = F.transform


def flat_map(a: Column, f: Unary) -> Column:
    return F.flatten(F.transform(a, f))


def ap(values: Column, *functions: Unary) -> Column:
    """Every function of every value, function by function."""
    return F.concat(*[F.transform(values, f) for f in functions])


def append(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def prepend(x: Column, a: Column) -> Column:
    return F.concat(F.array(x), a)


def first(a: Column) -> Column:
    return F.element_at(a, 1)


def last(a: Column) -> Column:
    return F.element_at(a, -1)


def tail(a: Column) -> Column:
    return F.slice(a, 2, F.size(a))


def init(a: Column) -> Column:
    return F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))


def zip_(a: Column, b: Column) -> Column:
    """Pairs _1, _2, as long as the shorter one."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.struct(x.alias("_1"), y.alias("_2")))


def zip_all(a: Column, b: Column, fill_a: Column, fill_b: Column) -> Column:
    """Pairs as long as the longer one, with fillers."""
    n = F.greatest(F.size(a), F.size(b))
    return zip_(pad_to(a, n, fill_a), pad_to(b, n, fill_b))


def zip_with_index(a: Column) -> Column:
    return F.transform(a, lambda x, i: F.struct(x.alias("_1"), i.alias("_2")))


def filter_(a: Column, p: Unary) -> Column:
    return F.filter(a, lambda x: F.coalesce(p(x), F.lit(False)))


def filter_not(a: Column, p: Unary) -> Column:
    return F.filter(a, lambda x: ~F.coalesce(p(x), F.lit(False)))


def collect(a: Column, guard: Unary, f: Unary) -> Column:
    return F.transform(filter_(a, guard), f)


def find(a: Column, p: Unary) -> Column:
    """The first element that meets p, null if none does."""
    return F.try_element_at(filter_(a, p), F.lit(1))


def collect_first(a: Column, guard: Unary, f: Unary) -> Column:
    return F.try_element_at(collect(a, guard, f), F.lit(1))


def partition(a: Column, p: Unary) -> Column:
    """A struct of those that meet p and those that don't."""
    return F.struct(filter_(a, p).alias("_1"), filter_not(a, p).alias("_2"))


def index_where(a: Column, p: Unary) -> Column:
    """Place of the first element that meets p, from 0; -1 if none does."""
    hits = F.filter(F.transform(a, lambda x, i: F.when(F.coalesce(p(x), F.lit(False)), i)), lambda i: i.isNotNull())
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.when(a.isNotNull(), F.lit(-1)))


def index_of(a: Column, x: Column) -> Column:
    return F.array_position(a, x) - 1


def _leading(a: Column, p: Unary) -> Column:
    stop = index_where(a, lambda x: ~F.coalesce(p(x), F.lit(False)))
    return F.when(stop < 0, F.size(a)).otherwise(stop)


def take_while(a: Column, p: Unary) -> Column:
    return F.slice(a, 1, _leading(a, p))


def drop_while(a: Column, p: Unary) -> Column:
    return drop(a, _leading(a, p))


def span(a: Column, p: Unary) -> Column:
    return F.struct(take_while(a, p).alias("_1"), drop_while(a, p).alias("_2"))


def take(a: Column, n: Column) -> Column:
    return F.slice(a, 1, F.greatest(n, F.lit(0)))


def drop(a: Column, n: Column) -> Column:
    n = F.greatest(n, F.lit(0))
    return F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))


def slice_(a: Column, start: Column, stop: Column) -> Column:
    """Elements from start up to but without stop, counted from 0."""
    return take(drop(a, start), stop - F.greatest(start, F.lit(0)))


def pad_to(a: Column, n: Column, x: Column) -> Column:
    return F.concat(a, F.array_repeat(x, F.greatest(n - F.size(a), F.lit(0))))


def fold_left(a: Column, zero: Column, op: Binary) -> Column:
    return F.aggregate(a, zero, op)


def reduce_left(a: Column, op: Binary) -> Column:
    return F.aggregate(tail(a), first(a), op)


def scan_left(a: Column, zero: Column, op: Binary) -> Column:
    """Running results of fold_left, zero first."""
    return F.aggregate(a, F.array(zero), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))


def scan_left1(a: Column, op: Binary) -> Column:
    """Running results of reduce_left, the first element first."""
    return scan_left(tail(a), first(a), op)


def for_all(a: Column, p: Unary) -> Column:
    return F.forall(a, p)


def exists(a: Column, p: Unary) -> Column:
    return F.exists(a, p)


def count(a: Column, p: Unary) -> Column:
    return F.size(filter_(a, p))


def contains(a: Column, x: Column) -> Column:
    return F.array_contains(a, x)


def same_elements(a: Column, b: Column) -> Column:
    """The same elements in the same order."""
    return a.eqNullSafe(b)


# --- a key with its values, as a struct of key and values


def association(key: Column, values: Column) -> Column:
    return F.struct(key.alias("key"), values.alias("values"))


def map_values(assoc: Column, f: Unary) -> Column:
    return association(assoc["key"], F.transform(assoc["values"], f))


def map_key(assoc: Column, f: Unary) -> Column:
    return association(f(assoc["key"]), assoc["values"])


def bimap(assoc: Column, fk: Unary, fv: Unary) -> Column:
    return map_values(map_key(assoc, fk), fv)


def zip_associations(a: Column, b: Column) -> Column:
    """Values of one key side by side; null if the keys differ."""
    return F.when(a["key"] == b["key"], association(a["key"], zip_(a["values"], b["values"])))


def ap_associations(functions: list[Unary], assoc: Column) -> Column:
    """Every function of every value of a key, function by function."""
    return association(assoc["key"], ap(assoc["values"], *functions))


def first_value(assoc: Column) -> Column:
    return first(assoc["values"])


def find_value(assoc: Column, p: Unary) -> Column:
    return find(assoc["values"], p)


def exists_value(assoc: Column, p: Unary) -> Column:
    return exists(assoc["values"], p)


def for_all_values(assoc: Column, p: Unary) -> Column:
    return for_all(assoc["values"], p)


def n_values(assoc: Column) -> Column:
    return F.size(assoc["values"])


def key_lens(assoc: Column) -> tuple[Column, Callable[[Column], Column]]:
    """The key, and the association with another key."""
    return assoc["key"], lambda k: association(k, assoc["values"])


def values_lens(assoc: Column) -> tuple[Column, Callable[[Column], Column]]:
    return assoc["values"], lambda v: association(assoc["key"], v)


def first_value_lens(assoc: Column) -> tuple[Column, Callable[[Column], Column]]:
    """The first value, and the association with another first value."""
    return first_value(assoc), lambda x: association(assoc["key"], prepend(x, tail(assoc["values"])))


def product_key(a: Column, b: Column) -> Column:
    """Both keys as one, every pair of values: the first side's value varies slowest."""
    pairs = F.flatten(F.transform(a["values"], lambda x: F.transform(b["values"], lambda y: F.struct(x.alias("_1"), y.alias("_2")))))
    return association(F.struct(a["key"].alias("_1"), b["key"].alias("_2")), pairs)
