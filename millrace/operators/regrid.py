"""Irregular readings onto a regular grid, through validity intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.ordered import any_changed, range_scan
from millrace.session import cut, steady


def _split(t0: np.ndarray, t1: np.ndarray, value: np.ndarray, ok: np.ndarray, step: int, hold: int) -> tuple[np.ndarray, ...]:
    """Intersects intervals [t0, min(t1, t0 + hold)) with grid cells: index of the interval, cell, seconds covered, seconds times value."""
    end = np.minimum(t1, t0 + hold)
    use = ok & (end > t0)
    i = np.flatnonzero(use)
    a, b = t0[i] // step, (end[i] - 1) // step
    reps = b - a + 1
    which = np.repeat(np.arange(len(i)), reps)
    cell = a[which] + np.arange(len(which)) - np.repeat(np.cumsum(reps) - reps, reps)
    seconds = np.minimum(end[i][which], (cell + 1) * step) - np.maximum(t0[i][which], cell * step)
    return i[which], cell, seconds, seconds * value[i][which]


def regrid(df: DataFrame, source: str, time: str, value: str, step: int = 3600, hold: int = 10800, low: float | None = None, high: float | None = None, partitions: int | None = None) -> DataFrame:
    """A regular series per source: ``source, slot, value, coverage, n_readings, state`` for every cell between those of its first and last usable reading.

    A reading holds from its own time to that of the next reading, for ``hold`` seconds at most; cells of ``step`` seconds (starting at multiples of
    it) get the time-weighted mean of the values that hold in them and the covered fraction. state: ``read`` (the cell has readings), ``held``
    (none, but an earlier reading holds into it) or ``missing`` (value null, coverage 0).

    Method: one global sort on (source, time) by sampled quantiles; each partition turns its readings into intervals and intersects these with the
    cells. The last reading of a partition finds its successor in the first reading of a later partition (one row per partition), and only
    the cells at partition edges are summed once more. Long silences travel as one row and are unrolled afterwards.

    Defined results: rows with a null source, time or value (or NaN) are not usable and take no part. A value outside [low, high] counts as a reading but
    carries no weight and ends what held before. Of readings at one time the highest value holds. Repeated rows each count in n_readings.
    A cell whose only readings are outside the limits is ``read`` with a null value. An empty table gives an empty result. Only the named columns are read.
    """
    span = df.schema[time].dataType
    rows = df.select(F.col(f"`{source}`").alias("source"), F.col(f"`{time}`").cast("long").alias("time"), F.col(f"`{value}`").cast("double").alias("value"))
    rows = rows.where("source is not null and time is not null and value is not null and not isnan(value)")
    rows = steady(rows).withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))  # so that copies of one reading don't all lie in one partition
    kind = df.schema[source].dataType
    schema = T.StructType(
        [
            T.StructField("kind", T.StringType()),  # cell: parts of a cell, gap: cells from..to that nothing touches, first / last: a partition's outer readings
            T.StructField("pid", T.IntegerType()),
            T.StructField("source", kind),
            T.StructField("cell", T.LongType()),
            T.StructField("upto", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("seconds", T.LongType()),
            T.StructField("weighted", T.DoubleType()),
            T.StructField("edge", T.BooleanType()),
        ]
    )

    def cells(src: pa.Array, t: np.ndarray, v: np.ndarray, nxt: np.ndarray, goes_on: np.ndarray, pid: int) -> Iterator[pa.RecordBatch]:
        """src, t, v: readings whose successors (nxt) are known where goes_on; where not, the source ends with them."""
        ok = np.ones(len(t), bool)
        if low is not None:
            ok &= v >= low
        if high is not None:
            ok &= v <= high
        own = t // step
        nxt = np.where(goes_on, nxt, (own + 1) * step)  # a source's last reading holds to the end of its cell
        which, cell, seconds, weighted = _split(t, nxt, np.where(ok, v, 0.0), ok, step, hold)
        # one entry per reading and one per interval part, summed by (source, cell)
        at = np.concatenate([np.arange(len(t)), which])
        c = np.concatenate([own, cell])
        code = src.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((c, code[at]))
        at, c = at[order], c[order]
        new = np.flatnonzero(np.concatenate([[True], (code[at][1:] != code[at][:-1]) | (c[1:] != c[:-1])])) if len(c) else np.array([], int)
        add = lambda x: np.add.reduceat(x[order], new) if len(new) else x[:0]
        n, s, w = add(np.concatenate([np.ones(len(t), np.int64), np.zeros(len(which), np.int64)])), add(np.concatenate([np.zeros(len(t), np.int64), seconds])), add(np.concatenate([np.zeros(len(t)), weighted]))
        # cells at the ends of what this call sees of a source may get more from elsewhere
        lo, hi = np.full(int(code.max()) + 1, 2**62), np.full(int(code.max()) + 1, -(2**62))
        np.minimum.at(lo, code, own)
        np.maximum.at(hi, code, own)
        k, cc = code[at][new], c[new]
        edge = (cc <= lo[k]) | (cc >= hi[k])
        yield pa.RecordBatch.from_arrays([pa.array(["cell"] * len(new), pa.string()), pa.array(np.full(len(new), pid, np.int32)), src.take(pa.array(at[new])), pa.array(cc), pa.array(cc), pa.array(n), pa.array(s), pa.array(w), pa.array(edge)], schema.names)
        # cells behind the held part, up to the successor's cell
        a = np.maximum(own, np.where(ok, np.minimum(nxt, t + hold) - 1, t) // step) + 1
        gap = np.flatnonzero(goes_on & (nxt // step - 1 >= a))
        if len(gap):
            zero = np.zeros(len(gap), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(["gap"] * len(gap), pa.string()), pa.array(np.full(len(gap), pid, np.int32)), src.take(pa.array(gap)), pa.array(a[gap]), pa.array(nxt[gap] // step - 1), pa.array(zero), pa.array(zero), pa.array(zero.astype(float)), pa.array(zero > 0)], schema.names)

    def outer(kind_: str, pid: int, row: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind_]), pa.array([pid], pa.int32()), row[0], pa.array([row[1]], pa.int64()), pa.array([row[1]], pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([row[2]], pa.float64()), pa.array([False])], schema.names)

    def fn(pid: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None  # the last reading, whose successor is not known yet: source (array of one), time, value
        for b in batches:
            src, t, v = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy()
            if tail is None:
                yield outer("first", pid, (src.slice(0, 1), int(t[0]), float(v[0])))
            else:
                src, t, v = pa.concat_arrays([tail[0], src]), np.append(tail[1], t), np.append(tail[2], v)
            n = len(t)
            tail = (src.slice(n - 1, 1), int(t[-1]), float(v[-1]))
            if n > 1:
                goes_on = ~any_changed([src], None)[1:]
                yield from cells(src.slice(0, n - 1), t[:-1], v[:-1], t[1:], goes_on, pid)
        if tail is not None:
            yield outer("last", pid, tail)

    scanned = cut(range_scan(rows, [F.col("source").asc(), F.col("time").asc(), F.col("value").asc(), F.col("spread")], fn, schema, partitions))
    spark = df.sparkSession
    # at most two rows per partition come to the driver
    ends: dict[int, dict] = {}
    for r in scanned.where("kind in ('first', 'last')").select("kind", "pid", "source", "cell", "weighted").collect():
        ends.setdefault(r.pid, {})[r.kind] = (r.source, r.cell, r.weighted)
    order = sorted(ends)
    joints = []
    for k, p in enumerate(order):
        s, t, v = ends[p]["last"]
        nxt = ends[order[k + 1]]["first"] if k + 1 < len(order) else None
        joints.append((s, t, v, nxt[1] if nxt and nxt[0] == s else None))
    joint = spark.createDataFrame(joints, T.StructType([T.StructField("source", kind), T.StructField("time", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("next", T.LongType())]))

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                on = b.column(3).is_valid().to_numpy(zero_copy_only=False)
                t = b.column(1).to_numpy()
                yield from cells(b.column(0), t, b.column(2).to_numpy(), np.where(on, b.column(3).fill_null(0).to_numpy(), t), on, -1)

    stitched = joint.mapInArrow(stitch, schema)
    cell_rows = scanned.where("kind = 'cell'")
    part = lambda d: d.select("source", "cell", "n", "seconds", "weighted")
    edge = part(cell_rows.where("edge")).unionByName(part(stitched.where("kind = 'cell'"))).groupBy("source", "cell").agg(F.sum("n").alias("n"), F.sum("seconds").alias("seconds"), F.sum("weighted").alias("weighted"))
    gaps = scanned.where("kind = 'gap'").unionByName(stitched.where("kind = 'gap'")).select("source", F.explode(F.sequence("cell", "upto")).alias("cell"), "n", "seconds", "weighted")
    total = part(cell_rows.where("not edge")).unionByName(edge).unionByName(gaps)
    slot = F.col("cell") * step
    return total.select(
        F.col("source").alias(source),
        (slot.cast(span) if isinstance(span, T.IntegralType) else slot).alias("slot"),
        F.when(F.col("seconds") > 0, F.col("weighted") / F.col("seconds")).alias("value"),
        (F.col("seconds") / step).alias("coverage"),
        F.col("n").alias("n_readings"),
        F.when(F.col("n") > 0, "read").when(F.col("seconds") > 0, "held").otherwise("missing").alias("state"),
    )
