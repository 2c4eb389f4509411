"""An algebra of associative reductions.

A Reduction has up to two forms. ``agg`` turns a column into a Spark aggregate: Catalyst then combines on the map side and inside code generation.
``op`` is the same operation on two Python values; it serves law tests, lazily combined values and reductions that no column expression can say.
A reduction without ``agg`` is still distributed (see ``Grouped.combine``): partial results per partition, then one streaming pass per key.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Op = Callable[[Any, Any], Any]


@dataclass(frozen=True)
class Reduction:
    """op: associative binary operation; agg: the aggregate of a column, taking an optional order column where the result depends on order; zero: neutral value, None if there is none."""

    name: str
    op: Op
    agg: Callable[..., Column] | None = None
    zero: Any = None
    ordered: bool = False

    def __call__(self, a: Any, b: Any) -> Any:
        return self.op(a, b)

    def of(self, column: Column | str, order: Column | str | None = None) -> Column:
        """The aggregate over a column. Order-dependent reductions need an order, so that results are the same on every run."""
        if self.agg is None:
            raise TypeError(f"{self.name} has no column form; use Grouped.combine or Bag.reduce")
        c = F.col(column) if isinstance(column, str) else column
        if self.ordered:
            if order is None:
                raise ValueError(f"{self.name} depends on order; give an order column")
            return self.agg(c, F.col(order) if isinstance(order, str) else order)
        return self.agg(c)

    def fold(self, values: list) -> Any:
        """Reduces Python values; the zero for none (ValueError if there is no zero)."""
        it = iter(values)
        try:
            acc = next(it)
        except StopIteration:
            if self.zero is None:
                raise ValueError(f"{self.name} of nothing") from None
            return self.zero
        for v in it:
            acc = self.op(acc, v)
        return acc

    # --- combinators

    def dual(self) -> Reduction:
        """The operation with its sides exchanged."""
        if self.ordered and self.agg is not None:
            return Reduction(f"dual {self.name}", lambda a, b: self.op(b, a), _DUALS.get(self.name), self.zero, True)
        return Reduction(f"dual {self.name}", lambda a, b: self.op(b, a), self.agg, self.zero)

    __invert__ = dual

    def pair(self) -> Callable[[Any], Any]:
        """A value combined with itself."""
        return lambda a: self.op(a, a)

    def map_in(self, into: Callable[[Any], Any], expr: Callable[[Column], Column] | None = None) -> Reduction:
        """Reduces images of the values: ``on``. expr: the same map on columns."""
        agg = (lambda c, *o: self.agg(expr(c), *o)) if self.agg is not None and expr is not None else None
        return Reduction(f"{self.name} on", lambda a, b: self.op(into(a), into(b)), agg, None, self.ordered)

    def biject(self, into: Callable, back: Callable, expr_in: Callable[[Column], Column] | None = None, expr_out: Callable[[Column], Column] | None = None) -> Reduction:
        """The reduction carried over to another type: into, reduce, back."""
        agg = (lambda c, *o: expr_out(self.agg(expr_in(c), *o))) if self.agg is not None and expr_in is not None and expr_out is not None else None
        return Reduction(f"{self.name} xmap", lambda a, b: back(self.op(into(a), into(b))), agg, None if self.zero is None else back(self.zero), self.ordered)

    def map_out(self, back: Callable, expr: Callable[[Column], Column] | None = None) -> Callable[[Any, Any], Any] | Reduction:
        """The reduction with its result mapped (no longer closed, so meant for a last step)."""
        agg = (lambda c, *o: expr(self.agg(c, *o))) if self.agg is not None and expr is not None else None
        return Reduction(f"{self.name} out", lambda a, b: back(self.op(a, b)), agg, None, self.ordered)

    def zip(self, *others: Reduction) -> Reduction:
        """Tuples reduced place by place; as columns, the fields of a struct, all in one aggregation."""
        parts = (self, *others)
        agg = None
        if all(p.agg is not None for p in parts):
            agg = lambda c, *o: F.struct(*[(p.agg(c.getField(k), *o) if p.ordered else p.agg(c.getField(k))).alias(k) for p, k in zip(parts, [f"_{i + 1}" for i in range(len(parts))], strict=True)])
        return Reduction(" and ".join(p.name for p in parts), lambda a, b: tuple(p.op(x, y) for p, x, y in zip(parts, a, b, strict=True)), agg, None, any(p.ordered for p in parts))

    def left(self, other: Reduction) -> Reduction:
        """Of tagged values ("left", a) or ("right", b): lefts win over rights; equals are reduced with their own side's reduction.

        As columns: a struct with fields left and right of which one is null.
        """
        return _either(self, other, "left")

    def right(self, other: Reduction) -> Reduction:
        """As ``left``, but rights win."""
        return _either(self, other, "right")

    def option(self) -> Reduction:
        """Leaves nothing (None, null) out of account; nothing at all gives nothing."""
        return Reduction(f"{self.name} option", lambda a, b: b if a is None else a if b is None else self.op(a, b), self.agg, None, self.ordered)

    def validation(self, failures: Reduction) -> Reduction:
        """Of tagged values ("ok", a) or ("error", e): any ok wins; only errors are reduced with ``failures``. As columns: a struct with fields ok and error."""

        def op(a: tuple, b: tuple) -> tuple:
            if a[0] == b[0]:
                return a[0], (self if a[0] == "ok" else failures).op(a[1], b[1])
            return a if a[0] == "ok" else b

        agg = None
        if self.agg is not None and failures.agg is not None:
            def agg(c: Column, *o: Column) -> Column:
                ok, error = self.agg(c.getField("ok"), *o), failures.agg(c.getField("error"), *o)
                return F.struct(ok.alias("ok"), F.when(ok.isNull(), error).alias("error"))

        return Reduction(f"{self.name} or {failures.name}", op, agg, None, self.ordered or failures.ordered)

    def pointwise(self, arguments: int = 1) -> Reduction:
        """Functions of so many arguments, reduced by their values."""
        return Reduction(f"{self.name} of functions", lambda f, g: lambda *x: self.op(f(*x[:arguments]), g(*x[:arguments])))

    def pointwise_lifted(self, bind: Callable) -> Reduction:
        """Functions into wrapped values: bind(op, wrapped, wrapped) combines what they give (Kleisli arrows; for functions from wrapped values use ``pointwise``)."""
        return Reduction(f"{self.name} of lifted functions", lambda f, g: lambda *x: bind(self.op, f(*x), g(*x)))

    def pointwise_from(self, take: Callable[[Any], Any]) -> Reduction:
        """Functions from a value in its surroundings (cokleisli arrows): both see the whole, and what they give is reduced; take puts out the value for functions of it alone."""
        return Reduction(f"{self.name} of functions from surroundings", lambda f, g: lambda w: self.op(f(w), g(w)) if take is None else self.op(f(take(w)), g(take(w))))

    def lift(self, bind: Callable) -> Reduction:
        """Wrapped values, combined through bind(op, wrapped, wrapped)."""
        return Reduction(f"{self.name} lifted", lambda a, b: bind(self.op, a, b))

    def store(self) -> Reduction:
        """Pairs of a function and a place: functions reduced pointwise, the right place kept."""
        return Reduction(f"{self.name} store", lambda a, b: (lambda x: self.op(a[0](x), b[0](x)), b[1]))

    def state(self) -> Reduction:
        """State steps s -> (s, value): run one after the other, values reduced."""

        def op(f: Callable, g: Callable) -> Callable:
            def step(s: Any) -> tuple:
                s1, a = f(s)
                s2, b = g(s1)
                return s2, self.op(a, b)

            return step

        return Reduction(f"{self.name} state", op)

    def writer(self, log: Reduction) -> Reduction:
        """Pairs of a log and a value, each with its own reduction."""
        return Reduction(f"{self.name} writer", lambda a, b: (log.op(a[0], b[0]), self.op(a[1], b[1])))

    def compose(self, other: Reduction) -> Reduction:
        """Pairs, reduced by this and the other: the two-place ``zip``."""
        return self.zip(other)

    # --- laws

    def associative(self, a: Any, b: Any, c: Any, by: Callable[[Any], Any] = lambda x: x, same: Callable[[Any, Any], bool] = lambda x, y: x == y) -> bool:
        """Whether a(bc) equals (ab)c for these values, compared after ``by`` with ``same``."""
        return same(by(self.op(a, self.op(b, c))), by(self.op(self.op(a, b), c)))


def _either(lefts: Reduction, rights: Reduction, wins: str) -> Reduction:
    def op(a: tuple, b: tuple) -> tuple:
        if a[0] == b[0]:
            return a[0], (lefts if a[0] == "left" else rights).op(a[1], b[1])
        return a if a[0] == wins else b

    agg = None
    if lefts.agg is not None and rights.agg is not None:
        def agg(c: Column, *o: Column) -> Column:
            x, y = lefts.agg(c.getField("left"), *o), rights.agg(c.getField("right"), *o)
            return F.struct(F.when(y.isNull(), x).alias("left"), y.alias("right")) if wins == "right" else F.struct(x.alias("left"), F.when(x.isNull(), y).alias("right"))

    return Reduction(f"{lefts.name} {wins} {rights.name}", op, agg, None, lefts.ordered or rights.ordered)


# --- numbers

SUM = Reduction("sum", lambda a, b: a + b, lambda c: F.coalesce(F.sum(c), F.lit(0)), 0)


def decimal_sum(scale: int) -> Reduction:
    """Sum of decimals with so many digits behind the point; values with more are rounded to them."""
    return Reduction("decimal sum", lambda a, b: a + b, lambda c: F.coalesce(F.sum(c.cast(f"decimal(38,{scale})")), F.lit(0).cast(f"decimal(38,{scale})")), Decimal(0))


#: With ten digits behind the point; ``decimal_sum`` takes any number of them.
SUM_DECIMAL = decimal_sum(10)
SUM_DIGIT = Reduction("digit sum", lambda a, b: (a + b) % 10, lambda c: F.coalesce(F.pmod(F.sum(c), F.lit(10)), F.lit(0)), 0)
#: As a column the product is a double; exact products of whole numbers go through ``op``.
PRODUCT = Reduction("product", lambda a, b: a * b, lambda c: F.coalesce(F.product(c), F.lit(1.0)), 1)
PRODUCT_EXACT = Reduction("exact product", lambda a, b: a * b, None, 1)


def _digit_product(c: Column) -> Column:
    """d to the power of its count, for each digit: powers modulo 10 repeat after four, so ten counts are all the state there is."""
    out = F.lit(1)
    for d in range(10):
        n = F.count_if(F.pmod(c, F.lit(10)) == d)
        power = F.when(n == 0, 1)
        for r in range(4):
            power = power.when(n % 4 == r, pow(d, r or 4, 10))
        out = F.pmod(out * power, F.lit(10))
    return out


PRODUCT_DIGIT = Reduction("digit product", lambda a, b: (a * b) % 10, _digit_product, 1)
MINIMUM = Reduction("minimum", min, F.min)
MAXIMUM = Reduction("maximum", max, F.max)


def minimum_by(key: Callable[[Any], Any], expr: Callable[[Column], Column] | None = None) -> Reduction:
    return Reduction("minimum by", lambda a, b: b if key(b) < key(a) else a, (lambda c: F.min_by(c, expr(c))) if expr else None)


def maximum_by(key: Callable[[Any], Any], expr: Callable[[Column], Column] | None = None) -> Reduction:
    return Reduction("maximum by", lambda a, b: b if key(b) > key(a) else a, (lambda c: F.max_by(c, expr(c))) if expr else None)


COUNT = Reduction("count", lambda a, b: a + b, F.count, 0)

# --- order and choice

_first = lambda c, o: F.min_by(c, o)
_last = lambda c, o: F.max_by(c, o)
FIRST = Reduction("first", lambda a, b: a, _first, None, True)
LAST = Reduction("last", lambda a, b: b, _last, None, True)
FIRST_OPTION = Reduction("first option", lambda a, b: b if a is None else a, lambda c, o: F.min_by(c, F.when(c.isNotNull(), o)), None, True)
LAST_OPTION = Reduction("last option", lambda a, b: a if b is None else b, lambda c, o: F.max_by(c, F.when(c.isNotNull(), o)), None, True)
OR = Reduction("or", lambda a, b: a or b, lambda c: F.coalesce(F.bool_or(c), F.lit(False)), False)
AND = Reduction("and", lambda a, b: a and b, lambda c: F.coalesce(F.bool_and(c), F.lit(True)), True)

# --- text and collections; values of one key end up in one row, as that is what is asked for

_in_order = lambda c, o: F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), c.alias("v")))), lambda x: x["v"])
STRING = Reduction("string", lambda a, b: a + b, lambda c, o: F.array_join(_in_order(c, o), ""), "", True)
LIST = Reduction("list", lambda a, b: [*a, *b], lambda c, o: F.flatten(F.filter(_in_order(c, o), lambda x: x.isNotNull())), (), True)
SET = Reduction("set", lambda a, b: frozenset(a) | frozenset(b), lambda c: F.array_distinct(F.flatten(F.collect_set(c))), frozenset())
SORTED_SET = Reduction("sorted set", lambda a, b: tuple(sorted({*a, *b})), lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))), ())


def _last_wins(c: Column, o: Column) -> Column:
    """One map of maps in order: an entry's last value wins. Maps themselves can't be sorted, so their entries travel as arrays; places are sorted by key, and of each key's places the last is kept."""
    boxed = F.array_sort(F.collect_list(F.struct(o.alias("o"), F.map_entries(c).alias("v"))))
    entries = F.flatten(F.filter(F.transform(boxed, lambda x: x["v"]), lambda m: m.isNotNull()))
    places = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["key"].alias("k"), i.alias("i"))))
    # arrays that are made once: a lambda that names an expression would have it computed again for every element
    held = F.transform(F.array(F.struct(entries.alias("e"), places.alias("p"))), lambda h: F.transform(F.filter(h["p"], lambda x, j: F.coalesce(F.get(h["p"], j + 1)["k"] != x["k"], F.lit(True))), lambda x: F.get(h["e"], x["i"])))
    return F.map_from_entries(F.flatten(held))


MAP = Reduction("map", lambda a, b: {**a, **b}, _last_wins, None, True)


def bag_union(a: Any, b: Any) -> Any:
    """Distributed lists, one behind the other (duplicates kept)."""
    return a + b


BAGS = Reduction("bags", bag_union)

# --- values that are always the same, functions, orders

UNIT = Reduction("unit", lambda a, b: None, lambda c: F.lit(None))


def constant(value: Any) -> Reduction:
    return Reduction("constant", lambda a, b: value, lambda c: F.first(F.lit(value)))


def split1(f: Callable[[Any], Any]) -> Reduction:
    """f of the left value."""
    return Reduction("split left", lambda a, b: f(a))


def split2(f: Callable[[Any], Any]) -> Reduction:
    """f of the right value."""
    return Reduction("split right", lambda a, b: f(b))


def split1_by(r: Reduction, f: Callable[[Any], Any]) -> Reduction:
    """r of f of the left value and the right value as it is: f on one side only."""
    return Reduction(f"{r.name} split left", lambda a, b: r.op(f(a), b))


def split2_by(r: Reduction, f: Callable[[Any], Any]) -> Reduction:
    return Reduction(f"{r.name} split right", lambda a, b: r.op(a, f(b)))


def _siblings(a: Any, b: Any) -> list:
    return [*a, *b]


#: Lists of XML nodes (as text or elements), one behind the other; as columns, arrays of their text.
NODES = Reduction("nodes", _siblings, lambda c, o: F.flatten(F.filter(_in_order(c, o), lambda x: x.isNotNull())), (), True)

ENDO = Reduction("endo", lambda f, g: lambda x: f(g(x)), None, lambda x: x)
#: Comparisons a, b -> -1, 0, 1 by one criterion after the other; as expressions, ``orderBy`` with several columns.
ORDERING = Reduction("ordering", lambda f, g: lambda x, y: f(x, y) or g(x, y), None, lambda x, y: 0)


def by_criteria(*criteria: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """ORDERING as an expression: a comparison of two columns (-1, 0, 1) by one criterion after the other, as ``array_sort`` takes it."""
    return lambda x, y: F.coalesce(*[F.nullif(c(x, y), F.lit(0)) for c in criteria], F.lit(0))


def ascending(f: Callable[[Column], Column] = lambda x: x) -> Callable[[Column, Column], Column]:
    return lambda x, y: F.when(f(x) < f(y), -1).when(f(x) > f(y), 1).otherwise(0)


def descending(f: Callable[[Column], Column] = lambda x: x) -> Callable[[Column, Column], Column]:
    return lambda x, y: ascending(f)(y, x)


COMPARISON = Reduction("comparison", lambda a, b: a or b, None, 0)
#: Equivalences, both of which must hold.
EQUAL = Reduction("equal", lambda f, g: lambda x, y: f(x, y) and g(x, y), None, lambda x, y: True)
UNEQUAL = Reduction("unequal", lambda f, g: lambda x, y: f(x, y) or g(x, y), None, lambda x, y: False)


def reduction(op: Op, agg: Callable[[Column], Column] | None = None, zero: Any = None) -> Reduction:
    """A user's own associative operation, with its aggregate if it has one."""
    return Reduction("own", op, agg, zero)


_DUALS = {"first": _last, "last": _first, "first option": LAST_OPTION.agg, "last option": FIRST_OPTION.agg, "string": lambda c, o: F.array_join(F.reverse(_in_order(c, o)), ""), "list": lambda c, o: F.flatten(F.filter(F.reverse(_in_order(c, o)), lambda x: x.isNotNull()))}

#: Ready-made reductions by name.
ALL = {r.name: r for r in (SUM, SUM_DECIMAL, SUM_DIGIT, PRODUCT, PRODUCT_EXACT, PRODUCT_DIGIT, MINIMUM, MAXIMUM, COUNT, FIRST, LAST, FIRST_OPTION, LAST_OPTION, OR, AND, STRING, LIST, SET, SORTED_SET, MAP, UNIT, ENDO, ORDERING, COMPARISON, EQUAL, UNEQUAL)}


def close(a: float, b: float) -> bool:
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
