"""Exact percentiles per group by distributed multi-selection over mergeable summaries."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from millrace.operators.ordered import any_changed
from millrace.session import cut

#: The field of a summary's value column that tells to multiples of what its values were rounded.
RESOLUTION = "resolution"


def summarise(df: DataFrame, keys: list[str], value: str, resolution: float | None = None) -> DataFrame:
    """The mergeable form of a column's distribution per key: ``keys, value, cnt``, one row per distinct value.

    Summaries of days, files or partitions are combined by ``merge``; what is read from a combined summary is what the whole data would give.
    resolution: round values to multiples of it, which bounds the size of a summary of continuous values; percentiles are then off by at most half of it, and the
    summary's value column says so in its metadata (which Parquet keeps).
    Null and NaN values take no part; a null key is a key. Repeated rows count each time. Only the named columns are read.
    """
    v = F.col(f"`{value}`")
    kept = v.isNotNull()
    if isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType)):
        kept &= ~F.isnan(v)
    if resolution is not None:
        v = F.round(v / resolution) * resolution
    out = df.where(kept).groupBy(*[F.col(f"`{k}`") for k in keys], v.alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    return _with_resolution(out, resolution or 0.0)


def resolution_of(summary: DataFrame) -> float:
    return float(summary.schema["value"].metadata.get(RESOLUTION, 0.0))


def _with_resolution(summary: DataFrame, resolution: float) -> DataFrame:
    return summary.withMetadata("value", {RESOLUTION: float(resolution)}) if resolution else summary


def merge(*summaries: DataFrame, keys: list[str]) -> DataFrame:
    """One summary of several; ``keys`` may leave out keys of the parts (days into months, say). Its resolution is the coarsest of theirs."""
    out = summaries[0].select(*[F.col(f"`{k}`") for k in keys], "value", "cnt")
    for s in summaries[1:]:
        out = out.unionByName(s.select(*[F.col(f"`{k}`") for k in keys], "value", "cnt"))
    out = out.groupBy(*[F.col(f"`{k}`") for k in keys], "value").agg(F.sum("cnt").alias("cnt"))
    return _with_resolution(out, max(map(resolution_of, summaries)))


def rank_of(p: str, n: Column) -> Column:
    """The rank ceil(p * n), 1 at least, in whole numbers: p is a decimal in text, so 0.05 is exactly a twentieth."""
    q = Decimal(p)
    if not 0 <= q <= 1:
        raise ValueError("percentiles lie in [0, 1]")
    scale = 10 ** max(0, -q.as_tuple().exponent)
    return F.greatest(F.expr("1L"), F.ceil((n * F.lit(int(q * scale)) / F.lit(scale)).cast("decimal(38,12)")).cast("long"))


#: Candidates of a range at or below which the rest is settled in one step.
SETTLE = 64
#: Values of a block: what is counted against the pivots in one go.
BLOCK = 4096
#: Pivots of a range in one round: the weighted median, those of both halves, of the quarters and of the eighths.
PIVOTS = 15
#: Ranges up to which the table of their pivots (fifteen values each) is broadcast.
BROADCAST_RANGES = 50_000
#: Parts of a group when sizes are joined to groups too many to be broadcast.
SALTS = 32


def weighted_quantiles(values: np.ndarray, weights: np.ndarray, pivots: int) -> np.ndarray:
    """The values at 1, ..., pivots of pivots + 1 parts of the weight, each once."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, pivots + 1) / (pivots + 1), side="left")
    return np.unique(values[order][np.minimum(at, len(order) - 1)])


def _proposal(values: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    """Evenly spread values of a sorted block, and how many candidates each stands for."""
    n = len(values)
    if n <= pivots:
        return values, np.ones(n)
    return values[((np.arange(pivots) + 0.5) * n / pivots).astype(int)], np.full(pivots, n / pivots)


def three_way(values: np.ndarray, counts: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted values: what counts (and how many values) lie below the first pivot, at it, between it and the next, and so on; 2 * pivots + 1 numbers each."""
    edge = np.empty(2 * len(pivots) + 2, np.int64)
    edge[0], edge[-1] = 0, len(values)
    edge[1:-1:2], edge[2:-1:2] = np.searchsorted(values, pivots, side="left"), np.searchsorted(values, pivots, side="right")
    upto = np.concatenate([[0], np.cumsum(counts)])
    return np.diff(upto[edge]), np.diff(edge)


def _rows(b: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    """A list column's rows as numpy arrays."""
    c = b.column(b.schema.get_field_index(name))
    at, flat = c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)
    return (flat[at[k] : at[k + 1]] for k in range(len(c)))


def _column(rows: list, kind: pa.DataType) -> pa.Array:
    """An Arrow column of values, or of numpy arrays."""
    if not pa.types.is_list(kind):
        return pa.array(rows, kind)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows), kind.value_type))


def percentiles(summary: DataFrame, group: str, probabilities: dict[str, str], settle: int = SETTLE, blocks: int | None = None, block: int = BLOCK, pivots: int = PIVOTS, broadcast: int = BROADCAST_RANGES) -> DataFrame:
    """Percentiles of every group from a summary (group, value, cnt): ``group, n``, a column for each of ``probabilities`` (name to decimal text), ``error_bound``.

    A percentile p is the least value whose cumulated count reaches ceil(p * n), so it is a value of the data; its rank error is zero, and its
    value error, ``error_bound``, is half the summary's resolution (zero without one).

    Method: multi-selection. Partitions hold sorted blocks of a group's candidates. In every round each partition proposes, for every range that is still open, the medians of its own candidates,
    of their halves, quarters and eighths; the weighted medians of all proposals become the pivots, candidates are counted three ways (below, at, above) against them, and only the range
    between two pivots in which a wanted rank lies goes on. Percentiles in one range share it and ranges are disjoint, so a candidate is never held twice, and five percentiles cost little more than one.
    A range of ``settle`` candidates or fewer is picked directly. A round leaves about a sixteenth of each range.

    blocks: partitions to deal the summary to by hash of (group, value); by default as it comes, which after ``merge`` is by that hash. A group of any size lies in all partitions and no step brings more of it
    together than a proposal per partition. ``broadcast``: with more ranges than this, tables of pivots are joined by (group, range, partition).

    Defined results: a null group is a group; groups without values are not in the result; an empty summary gives an empty result. ``group`` may not be called
    value, cnt, n, error_bound or like a percentile.
    """
    if group in ("value", "cnt", "n", "error_bound") or group in probabilities:
        raise ValueError(f"rename the group column {group}")
    spark = summary.sparkSession
    base = summary.select(F.col(f"`{group}`").alias("g"), "value", "cnt")
    kind, g_kind, names = summary.schema["value"].dataType, summary.schema[group].dataType, list(probabilities)
    array, long = to_arrow_type(kind), pa.int64()
    data = cut(base.repartition(blocks, "g", "value") if blocks else base)
    totals = cut(data.groupBy("g").agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("left")))
    ranges = totals.where(F.col("left") > settle).count()
    fits = ranges * len(names) <= broadcast
    wanted = F.array(*[F.struct(F.lit(k).alias("q"), rank_of(p, F.col("n")).alias("k")) for k, p in enumerate(probabilities.values())])
    targets = "array<struct<q:int,k:bigint>>"

    def with_group(table: DataFrame) -> DataFrame:
        """data beside a row per group: broadcast, or joined by group and a part of it."""
        if totals_fit:
            return data.join(F.broadcast(table.withColumnRenamed("g", "tg")), F.col("g").eqNullSafe(F.col("tg"))).drop("tg")
        salted = table.withColumnRenamed("g", "tg").withColumn("ts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return data.withColumn("s", F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int")).join(salted, F.col("g").eqNullSafe(F.col("tg")) & (F.col("s") == F.col("ts"))).drop("tg", "s", "ts")

    totals_fit = totals.limit(broadcast + 1).count() <= broadcast
    # a group of few values is picked at once, all ranks from one sorted array of at most `settle` values
    few = with_group(totals.where(F.col("left") <= settle).select("g", wanted.cast(targets).alias("ks")))
    few = few.groupBy("g").agg(F.first("ks").alias("ks"), F.array_sort(F.collect_list(F.struct("value", "cnt"))).alias("vs"))
    seen = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast(kind).alias("at"))
    pick = lambda k: F.aggregate("vs", seen, lambda a, x: F.when(a["seen"] >= k, a).otherwise(F.struct((a["seen"] + x["cnt"]).alias("seen"), x["value"].alias("at"))), lambda a: a["at"])
    found = [few.select("g", F.explode(F.transform("ks", lambda t: F.struct(t["q"].alias("q"), pick(t["k"]).alias("value")))).alias("x")).select("g", "x.q", "x.value")]

    g_field, values_ = T.StructField("g", g_kind), T.ArrayType(kind)
    block_schema = T.StructType([g_field, T.StructField("iv", T.IntegerType()), T.StructField("pid", T.IntegerType()), T.StructField("done", T.BooleanType()), T.StructField("vs", values_), T.StructField("cs", T.ArrayType(T.LongType()))])
    proposal_schema = T.StructType([g_field, T.StructField("iv", T.IntegerType()), T.StructField("vs", values_), T.StructField("ws", T.ArrayType(T.DoubleType()))])
    pivot_schema = T.StructType([g_field, T.StructField("iv", T.IntegerType()), T.StructField("pv", values_)])
    count_schema = T.StructType([g_field, T.StructField("iv", T.IntegerType()), T.StructField("cs", T.ArrayType(T.LongType())), T.StructField("ns", T.ArrayType(T.LongType()))])

    def batch(gs: pa.Array, at: list[int], columns: list[tuple[list, pa.DataType]], names_: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([gs.take(pa.array(at, long)), *(_column(x, t) for x, t in columns)], names_)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows (g, value, cnt) into blocks; the batch's end ends a block too."""
        pid = TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            starts = np.flatnonzero(any_changed([b.column(0)], None))
            cuts = np.unique(np.concatenate([*(np.arange(s, e, block) for s, e in zip(starts, [*starts[1:], b.num_rows], strict=True))]))
            ends = np.append(cuts[1:], b.num_rows).astype(np.int32)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            n = len(cuts)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cuts)), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, pid, np.int32)), pa.array(np.zeros(n, bool)), pa.ListArray.from_arrays(offsets, b.column(1)), pa.ListArray.from_arrays(offsets, b.column(2))], block_schema.names)

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's proposal for each range: points of its blocks, thinned to as many as a block gives."""
        for b in batches:
            if not b.num_rows:
                continue
            new = np.flatnonzero(any_changed([b.column(0), b.column(1)], None))
            rows, iv = list(_rows(b, "vs")), b.column(1).to_pylist()
            vs, ws = [], []
            for s, e in zip(new.tolist(), [*new[1:].tolist(), b.num_rows], strict=True):
                points = [_proposal(rows[k], pivots) for k in range(s, e)]
                v, w = np.concatenate([p[0] for p in points]), np.concatenate([p[1] for p in points])
                if len(v) > 4 * pivots:
                    total = w.sum()
                    v = weighted_quantiles(v, w, 4 * pivots)
                    w = np.full(len(v), total / len(v))
                vs.append(v)
                ws.append(w)
            yield batch(b.column(0), new.tolist(), [([iv[k] for k in new.tolist()], pa.int32()), (vs, pa.list_(array)), (ws, pa.list_(pa.float64()))], proposal_schema.names)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pivots of each range from its proposals."""
        for b in batches:
            if b.num_rows:
                chosen = [weighted_quantiles(v, w, pivots) for v, w in zip(_rows(b, "vs"), _rows(b, "ws"), strict=True)]
                yield batch(b.column(0), list(range(b.num_rows)), [(b.column(1).to_pylist(), pa.int32()), (chosen, pa.list_(array))], pivot_schema.names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a partition's blocks (g, iv, vs, cs, pv) have below, at and above the pivots."""
        for b in batches:
            if not b.num_rows:
                continue
            new = np.flatnonzero(any_changed([b.column(0), b.column(1)], None))
            each = [three_way(v, c, p) for v, c, p in zip(_rows(b, "vs"), _rows(b, "cs"), _rows(b, "pv"), strict=True)]
            iv, cs, ns = b.column(1).to_pylist(), [], []
            for s, e in zip(new.tolist(), [*new[1:].tolist(), b.num_rows], strict=True):
                pad = 2 * pivots + 1
                total = np.zeros((2, pad), np.int64)
                for c, n in each[s:e]:
                    total[0, : len(c)] += c
                    total[1, : len(n)] += n
                cs.append(total[0])
                ns.append(total[1])
            yield batch(b.column(0), new.tolist(), [([iv[k] for k in new.tolist()], pa.int32()), (cs, pa.list_(long)), (ns, pa.list_(long))], count_schema.names)

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What goes on of blocks (g, iv, pid, vs, cs, pv, js): the stretches between pivots that are kept, js: [(stretch, its new range, whether it is to be settled)]."""
        for b in batches:
            at, iv, done, vs, cs = [], [], [], [], []
            for r, (v, c, p, js) in enumerate(zip(_rows(b, "vs"), _rows(b, "cs"), _rows(b, "pv"), b.column(6).to_pylist(), strict=True)):
                lo, hi = np.concatenate([[0], np.searchsorted(v, p, side="right")]), np.concatenate([np.searchsorted(v, p, side="left"), [len(v)]])
                for j in js:
                    s, e = int(lo[j["j"]]), int(hi[j["j"]])
                    if s < e:
                        at.append(r)
                        iv.append(j["iv"])
                        done.append(j["done"])
                        vs.append(v[s:e])
                        cs.append(c[s:e])
            if at:
                pids = b.column(2).take(pa.array(at)).to_pylist()
                yield batch(b.column(0), at, [(iv, pa.int32()), (pids, pa.int32()), (done, pa.bool_()), (vs, pa.list_(array)), (cs, pa.list_(long))], block_schema.names)

    def beside(rows: DataFrame, table: DataFrame) -> DataFrame:
        """Blocks with the row of their range; a group's blocks of one partition are the largest key there is."""
        t = table.withColumnsRenamed({"g": "tg", "iv": "tiv"})
        mine = F.col("g").eqNullSafe(F.col("tg")) & (F.col("iv") == F.col("tiv"))
        if fits:
            return rows.join(F.broadcast(t), mine).drop("tg", "tiv")
        parts = rows.select("g", "iv", F.col("pid").alias("tp")).distinct().join(t, mine).drop("g", "iv")
        return rows.join(parts, mine & (F.col("pid") == F.col("tp"))).drop("tg", "tiv", "tp").sortWithinPartitions("g", "iv")

    big = totals.where(F.col("left") > settle)
    states = big.select("g", F.lit(0).alias("iv"), wanted.cast(targets).alias("ks"))
    live = None
    if ranges:
        live = cut(with_group(big.select("g")).select("g", "value", "cnt").sortWithinPartitions("g", "value").mapInArrow(pack, block_schema))
    while live is not None:
        proposals = live.where("not done").mapInArrow(propose, proposal_schema)
        gathered = proposals.groupBy("g", "iv").agg(F.flatten(F.collect_list("vs")).alias("vs"), F.flatten(F.collect_list("ws")).alias("ws"))  # one proposal per batch of a partition
        chosen = cut(gathered.mapInArrow(choose, pivot_schema))
        counted = beside(live.where("not done"), chosen).select("g", "iv", "vs", "cs", "pv").mapInArrow(count, count_schema)
        sums = [F.sum(F.get(c, k)).alias(f"{c}{k}") for c in ("cs", "ns") for k in range(2 * pivots + 1)]
        summed = counted.groupBy("g", "iv").agg(*sums).select("g", "iv", *[F.array(*[F.col(f"{c}{k}") for k in range(2 * pivots + 1)]).alias(c) for c in ("cs", "ns")])
        pair = lambda a, b: a["g"].eqNullSafe(b["g"]) & (a["iv"] == b["iv"])
        known = summed.join(chosen, pair(summed, chosen)).select(summed["g"], summed["iv"], "cs", "ns", "pv")
        known = known.join(states, pair(known, states)).select(known["g"], known["iv"], "cs", "ns", "pv", "ks")
        # the stretch (0 below the first pivot, 1 at it, 2 between it and the next, ...) in which each wanted rank lies, and what is counted before it
        upto = F.transform("cs", lambda x, i: F.aggregate(F.slice("cs", 1, i + 1), F.lit(0).cast("long"), lambda a, y: a + y))
        stretch = known.withColumn("upto", upto).select("g", "iv", "cs", "ns", "pv", "upto", F.explode("ks").alias("t"))
        stretch = stretch.select("g", "iv", "ns", "pv", "cs", "upto", "t.q", "t.k", F.size(F.filter("upto", lambda x: x < F.col("t.k"))).alias("at"))
        verdict = cut(
            stretch.select(
                "g", "iv", "pv", "q", "at", F.when(F.col("at") % 2 == 1, F.get("pv", F.floor(F.col("at") / 2).cast("int"))).alias("value"), (F.get("ns", F.col("at")) <= settle).alias("done"),
                (F.col("k") - F.get("upto", F.col("at")) + F.get("cs", F.col("at"))).alias("k"),
            )
        )
        found.append(verdict.where("at % 2 = 1").select("g", "q", "value"))
        going = verdict.where("at % 2 = 0").groupBy("g", "iv", "at").agg(F.first("pv").alias("pv"), F.first("done").alias("done"), F.min("q").alias("niv"), F.collect_list(F.struct("q", "k")).alias("ks"))
        going = cut(going)
        if going.isEmpty():
            break
        kept = going.groupBy("g", "iv").agg(F.first("pv").alias("pv"), F.collect_list(F.struct((F.col("at") / 2).cast("int").alias("j"), F.col("niv").alias("iv"), "done")).alias("js"))
        states = going.select("g", F.col("niv").alias("iv"), F.col("ks").cast(targets).alias("ks"))
        live = cut(beside(live.where("not done"), kept).select("g", "iv", "pid", "vs", "cs", "pv", "js").mapInArrow(trim, block_schema))
        settled = live.where("done").groupBy("g", "iv").agg(F.flatten(F.collect_list(F.arrays_zip("vs", "cs"))).alias("z"))
        settled = settled.join(states, pair(settled, states)).select(settled["g"], "ks", F.array_sort(F.transform("z", lambda x: F.struct(x["vs"].alias("value"), x["cs"].alias("cnt")))).alias("vs"))
        found.append(settled.select("g", F.explode(F.transform("ks", lambda t: F.struct(t["q"].alias("q"), pick(t["k"]).alias("value")))).alias("x")).select("g", "x.q", "x.value"))
        if going.where("not done").isEmpty():
            break
    wide = functools.reduce(DataFrame.unionByName, found).groupBy("g").agg(*[F.max(F.when(F.col("q") == k, F.col("value"))).alias(name) for k, name in enumerate(names)])
    joined = totals.join(wide.withColumnRenamed("g", "wg"), totals["g"].eqNullSafe(F.col("wg")))
    return joined.select(F.col("g").alias(group), "n", *names, F.lit(resolution_of(summary) / 2).alias("error_bound"))
