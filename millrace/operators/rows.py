"""Python functions of rows and groups over Arrow batches: values arrive as Python objects, so whole numbers stay whole and arrays stay lists."""

from __future__ import annotations

import copy
import functools
from collections import Counter as Tally
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Output rows of a Python function that are put into one batch.
BATCH = 10_000


class _Sums(AccumulatorParam):
    def zero(self, value: Tally) -> Tally:
        return Tally()

    def addInPlace(self, a: Tally, b: Tally) -> Tally:
        a.update(b)
        return a


class Counters:
    """Named counts that Python functions raise while they run, by group and name; the driver reads them once an action has run.

    They add up over all actions of a session, as long as the same object is used. A task that is run again after its output was lost counts again.
    """

    def __init__(self, spark: SparkSession) -> None:
        self._sums = spark.sparkContext.accumulator(Tally(), _Sums())

    def add(self, group: str, name: str, by: int = 1) -> None:
        self._sums.add(Tally({(group, name): by}))

    def value(self, group: str, name: str) -> int:
        return self._sums.value[(group, name)]

    def group(self, group: str) -> dict[str, int]:
        return {n: v for (g, n), v in sorted(self._sums.value.items()) if g == group}


class Context:
    """What a function may ask for and tell while it runs: the number of its partition, settings it was given, its own counters, and that it is alive."""

    def __init__(self, settings: dict[str, str], counters: Counters | None) -> None:
        self.partition = TaskContext.get().partitionId()
        self.settings = settings
        self._counters, self._held = counters, Tally()

    def count(self, group: str, name: str, by: int = 1) -> None:
        """Raises a counter; without ``counters`` given to the operator it is forgotten."""
        self._held[(group, name)] += by

    def tick(self) -> None:
        """A sign of life. Spark has none to wait for, so it does nothing."""

    def close(self) -> None:
        if self._counters is not None:
            for (group, name), n in self._held.items():
                self._counters.add(group, name, n)
            self._held.clear()


class DoFn:
    """A row function with a life cycle, for ``Bag.parallel_do``: setup and cleanup run once per partition that has rows.

    process gets the environment (None without one) and a row as a dict and yields output rows as dicts or tuples; cleanup may yield rows too. ``self.context`` is there from setup on.
    """

    context: Context

    def setup(self, env: Any) -> None: ...

    def process(self, env: Any, row: dict) -> Iterable:
        raise NotImplementedError

    def cleanup(self, env: Any) -> Iterable:
        return ()


class GroupFn(DoFn):
    """As DoFn for whole groups: process gets a key and an iterator over its values, which come in order and are never held together."""

    def process(self, env: Any, key: Any, values: Iterator) -> Iterable:  # type: ignore[override]
        raise NotImplementedError


def schema_of(spark: SparkSession, schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def batches_of(rows: Iterable, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Rows (dicts, tuples or, for one column, bare values) as Arrow batches."""
    arrow, names = to_arrow_schema(schema), schema.names
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], f.type) for k, f in enumerate(arrow)], schema=arrow)
        held.clear()
        return out

    for r in rows:
        held.append(tuple(r[c] for c in names) if isinstance(r, dict) and names and set(r) >= set(names) else r if isinstance(r, (tuple, list)) and (len(names) > 1 or isinstance(r, tuple)) else (r,))
        if len(held) >= BATCH:
            yield batch()
    if held:
        yield batch()


def _plain(kind: T.DataType) -> Callable[[Any], Any] | None:
    """How a value of the type as Arrow gives it becomes a Python value: maps become dicts. None where nothing is to be done."""
    if isinstance(kind, T.MapType):
        k, v = _plain(kind.keyType) or (lambda x: x), _plain(kind.valueType) or (lambda x: x)
        return lambda m: None if m is None else {k(a): v(b) for a, b in m}
    if isinstance(kind, T.ArrayType):
        e = _plain(kind.elementType)
        return e and (lambda a: None if a is None else [e(x) for x in a])
    if isinstance(kind, T.StructType):
        inner = {f.name: g for f in kind.fields if (g := _plain(f.dataType))}
        return (lambda s: None if s is None else {n: inner[n](x) if n in inner else x for n, x in s.items()}) if inner else None
    return None


def columns_of(b: pa.RecordBatch, schema: T.StructType) -> list[list]:
    """The columns of a batch as Python lists."""
    out = []
    for c, f in zip(b.columns, schema.fields, strict=True):
        change = _plain(f.dataType)
        values = c.to_pylist()
        out.append([change(x) for x in values] if change else values)
    return out


def each_row(df: DataFrame, fn: DoFn, schema: T.StructType | str, counters: Counters | None, env: str | None) -> DataFrame:
    """fn over the rows of df. env: a column that holds the environment in the first row of every partition; it is no part of the rows."""
    spark, source = df.sparkSession, df.schema
    wanted = schema_of(spark, schema)
    settings = dict(spark.sparkContext.getConf().getAll())
    names = [c for c in df.columns if c != env]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator:
        mine, given = None, None
        for b in batches:
            if not b.num_rows:
                continue
            cols = columns_of(b, source)
            if mine is None:
                mine = copy.copy(fn)
                mine.context = Context(settings, counters)
                given = cols.pop()[0] if env else None
                mine.setup(given)
            elif env:
                cols.pop()
            mine.context.count("rows by task", f"map {mine.context.partition}", b.num_rows)
            for values in zip(*cols, strict=True):
                yield from mine.process(given, dict(zip(names, values, strict=True)))
        if mine is not None:
            yield from mine.cleanup(given)
            mine.context.close()

    return df.mapInArrow(lambda batches: batches_of(rows(batches), wanted), wanted)


def each_group(df: DataFrame, ids: list[str], key: str, value: str, fn: GroupFn, schema: T.StructType | str, counters: Counters | None, env: str | None) -> DataFrame:
    """fn over the groups of df, whose partitions hold whole groups one after the other; ids: columns that tell groups apart."""
    spark, source = df.sparkSession, df.schema
    wanted = schema_of(spark, schema)
    settings = dict(spark.sparkContext.getConf().getAll())
    place = {c: k for k, c in enumerate(df.columns)}

    def flat(batches: Iterator[pa.RecordBatch], state: dict) -> Iterator[tuple]:
        for b in batches:
            if b.num_rows:
                cols = columns_of(b, source)
                state["rows"] += b.num_rows
                if env and "env" not in state:
                    state["env"] = cols[place[env]][0]
                yield from zip(zip(*[cols[place[c]] for c in ids], strict=True), cols[place[key]], cols[place[value]], strict=True)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator:
        state: dict = {"rows": 0}
        it = flat(batches, state)
        ahead = next(it, None)
        if ahead is None:
            return
        mine = copy.copy(fn)
        mine.context = Context(settings, counters)
        given = state.get("env")
        mine.setup(given)
        while ahead is not None:
            own, name = ahead[0], ahead[1]

            def values() -> Iterator:
                nonlocal ahead
                while ahead is not None and ahead[0] == own:  # noqa: B023
                    v = ahead[2]
                    ahead = next(it, None)
                    yield v

            left = values()
            yield from mine.process(given, name, left)
            for _ in left:  # what the function did not look at
                pass
        yield from mine.cleanup(given)
        mine.context.count("rows by task", f"reduce {mine.context.partition}", state["rows"])
        mine.context.close()

    return df.mapInArrow(lambda batches: batches_of(rows(batches), wanted), wanted)


def reduced(df: DataFrame, op: Callable[[Any, Any], Any], most: int = 100_000) -> DataFrame:
    """df (h, k, key, value), the partial results of op per (h, k), held for at most ``most`` keys at a time."""
    schema = df.schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: dict = {}
        for b in batches:
            for h, k, name, v in zip(*columns_of(b, schema), strict=True):
                held[k] = (h, name, op(held[k][2], v)) if k in held else (h, name, v)
            if len(held) > most:
                yield from ((h, k, name, v) for k, (h, name, v) in held.items())
                held = {}
        yield from ((h, k, name, v) for k, (h, name, v) in held.items())

    return df.mapInArrow(lambda batches: batches_of(rows(batches), schema), schema)


def folded(op: Callable[[Any, Any], Any]) -> type[GroupFn]:
    """The reduction of each group's values, without holding them."""

    class Fold(GroupFn):
        def process(self, env: Any, key: Any, values: Iterator) -> Iterable:
            yield (key, functools.reduce(op, values))

    return Fold
