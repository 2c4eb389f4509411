"""Range-partitioned ordered scans: positions, runs and prefix sums without one task per group.

A global sort on (group, order) cuts the data into partitions of like size whatever the group sizes are;
a group of a third of all rows then lies in many neighbouring partitions. Each partition numbers its rows
on its own, and what is carried over a partition's edge is mended from one summary row per partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import cut


def fresh(taken: list[str], name: str) -> str:
    """name, or name with a number behind it that no column in taken has (case is ignored, as Spark does)."""
    low = {x.lower() for x in taken}
    k, out = 0, name
    while out.lower() in low:
        k += 1
        out = f"{name}_{k}"
    return out


def changed(arr: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """For each value whether it differs from the one before it; nulls equal nulls and NaN equals NaN.

    before: the value ahead of the first, None if there is none (the first then counts as changed).
    """
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    head = pa.array([before.as_py()], arr.type) if before is not None else arr.slice(0, 1)
    prev = pa.concat_arrays([head, arr.slice(0, len(arr) - 1)])
    differ = pc.fill_null(pc.not_equal(arr, prev), False)
    if pa.types.is_floating(arr.type):
        differ = pc.and_not(differ, pc.fill_null(pc.and_(pc.is_nan(arr), pc.is_nan(prev)), False))
    out = pc.or_(differ, pc.xor(pc.is_null(arr), pc.is_null(prev))).to_numpy(zero_copy_only=False).copy()
    if before is None and len(out):
        out[0] = True
    return out


def any_changed(arrays: list[pa.Array], before: list[pa.Scalar] | None) -> np.ndarray:
    out = changed(arrays[0], before[0] if before else None)
    for k in range(1, len(arrays)):
        out |= changed(arrays[k], before[k] if before else None)
    return out


def range_scan(df: DataFrame, order: list[Column], fn: Callable[[int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType, partitions: int | None = None) -> DataFrame:
    """Sorts df globally by sampled quantiles of ``order`` and runs fn(partition number, sorted batches) on each partition."""
    parted = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(TaskContext.get().partitionId(), (b for b in batches if b.num_rows))

    return parted.sortWithinPartitions(*order).mapInArrow(run, schema)


def _numbering(groups: int, amount: int | None, keep: int | None, names: list[str]) -> Callable:
    """fn for range_scan; the first ``groups`` columns are the group. Adds partition, ordinal of the group in it and place in the group (or the running sum of column ``amount``)."""

    def fn(pid: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, gid, carry = None, -1, 0
        for b in batches:
            n = b.num_rows
            starts = any_changed([b.column(k) for k in range(groups)], last and last[:groups])
            each = np.ones(n, np.int64) if amount is None else b.column(amount).to_numpy(zero_copy_only=False).astype(np.int64)
            ahead = np.cumsum(each) - each
            place = ahead + each - ahead[np.maximum.accumulate(np.where(starts, np.arange(n), 0))]
            place[: int(starts.argmax()) if starts.any() else n] += carry
            gids = gid + np.cumsum(starts)
            extra = [np.full(n, pid, np.int32), gids.astype(np.int64), place]
            last, gid, carry = [b.column(k)[n - 1] for k in range(groups)], int(gids[-1]), int(place[-1])
            out = pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, extra)], names)
            yield out.filter(pa.array(place <= keep)) if keep is not None else out

    return fn


def numbered(df: DataFrame, group: list[str], order: list[Column], keep: int | None = None, amount: str | None = None, partitions: int | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Numbers rows within their partition of the global sort, checkpointed so that numbers and partitions stay as they are.

    Returns the frame and the names of its added columns: pid, gid (ordinal of the group within the partition) and place
    (1, 2, ... within group and partition; if ``amount`` names a column of whole numbers without nulls, its running sum).
    keep: drop rows whose place within the partition is already beyond it.
    """
    cols = [*group, *(c for c in df.columns if c not in group)]
    df = df.select(*[F.col(f"`{c}`") for c in cols])
    names = {k: fresh(cols, k) for k in ["pid", "gid", "place"]}
    schema = T.StructType([*df.schema.fields, T.StructField(names["pid"], T.IntegerType()), *(T.StructField(v, T.LongType()) for k, v in names.items() if k != "pid")])
    fn = _numbering(len(group), None if amount is None else cols.index(amount), keep, schema.names)
    return cut(range_scan(df, [*[F.col(f"`{g}`").asc_nulls_first() for g in group], *order], fn, schema, partitions)), names


def same(a: object, b: object) -> bool:
    """Equality of group values as grouping sees it: None equals None and NaN equals NaN."""
    if isinstance(a, (tuple, list)) and isinstance(b, (tuple, list)):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b or (a != a and b != b)


class Edge(NamedTuple):
    pid: int
    first: Row
    last: Row
    first_amount: int
    last_amount: int
    groups: int


def edges(df: DataFrame, group: list[str], pid: str, gid: str, amount: Column) -> list[Edge]:
    """One row per non-empty partition, at most as many as there are shuffle partitions: first and last group and their amounts.

    amount: a Column whose sum over a group's rows in a partition is what is carried on (1 for counts). Only a partition's outer groups are summed, as no other one can go on beyond it; no
    row per group is made or shuffled.
    """
    name = F.struct(*[F.col(f"`{g}`") for g in group])
    outer = df.groupBy(F.col(pid).alias("pid")).agg(F.min_by(name, gid).alias("first"), F.max_by(name, gid).alias("last"), F.min(gid).alias("low"), F.max(gid).alias("top")).collect()
    low, top, at = (fresh([*df.columns, "__amount"], x) for x in ("edge_low", "edge_top", "edge_pid"))
    table = df.sparkSession.createDataFrame([(r.pid, r.low, r.top) for r in outer], T.StructType([T.StructField(at, T.IntegerType()), T.StructField(low, T.LongType()), T.StructField(top, T.LongType())]))
    ends = df.join(F.broadcast(table), F.col(pid) == F.col(at)).where((F.col(gid) == F.col(low)) | (F.col(gid) == F.col(top)))
    sums = {(r[0], r[1]): r[2] for r in ends.groupBy(pid, gid).agg(F.sum(amount)).collect()}
    return [Edge(r.pid, r.first, r.last, sums[r.pid, r.low], sums[r.pid, r.top], r.top - r.low + 1) for r in sorted(outer, key=lambda r: r.pid)]


def chain(rows: list[Edge]) -> dict[int, float]:
    """Prefix sums over partitions: for each partition what its first group amounts to in the partitions before."""
    out, last, carry = {}, None, 0
    for r in rows:
        goes_on = last is not None and same(tuple(r.first), tuple(last))
        out[r.pid] = carry if goes_on else 0
        carry = (out[r.pid] if goes_on else 0) + r.first_amount if r.groups == 1 else r.last_amount
        last = r.last
    return out


def with_offsets(df: DataFrame, offsets: dict[int, float], pid: str, gid: str, kind: T.DataType = T.LongType()) -> tuple[DataFrame, str]:
    """df with the offset of each row: that of its partition for the partition's first group, else 0. The joined table has a row per partition."""
    name = fresh(df.columns, "offset")
    key = fresh([*df.columns, name], "offset_pid")
    table = df.sparkSession.createDataFrame([(int(p), v) for p, v in offsets.items() if v], T.StructType([T.StructField(key, T.IntegerType()), T.StructField(name, kind)]))
    zero = F.lit(0).cast(kind)
    joined = df.join(F.broadcast(table), (F.col(pid) == F.col(key)) & (F.col(gid) == 0), "left")
    return joined.withColumn(name, F.coalesce(F.col(name), zero)).drop(key), name


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """From sorted batches, one batch for each group of equal values in the first ``keys`` columns (for groups of bounded size)."""
    held: list[pa.RecordBatch] = []

    def closed() -> pa.RecordBatch:
        out = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
        return out

    last = None
    for b in batches:
        if not b.num_rows:
            continue
        at = np.flatnonzero(any_changed([b.column(k) for k in range(keys)], last)).tolist()
        last = [b.column(k)[b.num_rows - 1] for k in range(keys)]
        bounds = [0, *[x for x in at if x], b.num_rows]
        for k in range(len(bounds) - 1):
            if held and (k or (at and at[0] == 0)):
                yield closed()
            held.append(b.slice(bounds[k], bounds[k + 1] - bounds[k]))
    if held:
        yield closed()
