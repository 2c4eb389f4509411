"""What makes keys equal and how values of a key are ordered, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grouping:
    """keys: the columns that decide equality, from the key column; order: expressions over a row by which the values of a group are sorted (empty: no order is promised).

    partition and sort serve ``Grouped.parallel_do``: the number of the partition of a key, and the columns by which groups follow one another in a partition. Keys that count as equal must get
    equal results from both. Without a partition function Spark partitions by hash. An equality that is no function of the key (a bare comparator) can't be distributed and isn't offered.
    """

    keys: Callable[[Column], list[Column]] = field(default=lambda k: [k])
    order: tuple[Column, ...] = ()
    partition: Callable[[Column, int], Column] | None = None
    sort: Callable[[Column], list[Column]] = field(default=lambda k: [])

    def contramap(self, f: Callable[[Column], Column]) -> Grouping:
        """Groups by f(key)."""
        part = self.partition
        return Grouping(lambda k: self.keys(f(k)), self.order, part and (lambda k, n: part(f(k), n)), lambda k: self.sort(f(k)))

    def partitioned(self, f: Callable[[Column, int], Column]) -> Grouping:
        """The same groups, a key in partition f(key, number of partitions), taken modulo that number."""
        return replace(self, partition=f)

    def sorted(self, f: Callable[[Column], list[Column]]) -> Grouping:
        """The same groups, following one another in a partition by these columns of the key."""
        return replace(self, sort=f)

    def zip(self, other: Grouping) -> Grouping:
        """For keys that are structs of two fields: the first field by this grouping and the second by the other."""
        return Grouping(lambda k: [*self.keys(k.getField("_1")), *other.keys(k.getField("_2"))], (*self.order, *other.order))

    def refine(self, other: Grouping) -> Grouping:
        """Keys are equal if both groupings say so."""
        return Grouping(lambda k: [*self.keys(k), *other.keys(k)], (*self.order, *other.order))

    def secondary_sort(self, *by: Column | str) -> Grouping:
        """The same groups, with their values in ascending order of these expressions (negate a number to descend)."""
        return replace(self, order=tuple(F.col(b) if isinstance(b, str) else b for b in by))


BY_KEY = Grouping()
#: All keys are one group.
ALL = Grouping(lambda k: [F.lit(1)])
