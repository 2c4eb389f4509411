"""Implausible readings: physically impossible values, isolated excursions and frozen sensors, judged per source."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.ordered import any_changed, chain, edges, groups, range_scan, same, with_offsets
from millrace.session import cut, small

DAY = 86400


def esd_limits(n: int, most: int, alpha: float) -> np.ndarray:
    """Critical values of the generalised extreme studentised deviate test for the 1st to most-th largest of n deviations."""
    i = np.arange(1, most + 1)
    z = np.array([NormalDist().inv_cdf(1 - alpha / (2 * (n - k + 1))) for k in i])
    v = np.maximum(n - i - 1, 1).astype(float)
    t = z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v**2)  # normal to Student quantile
    return (n - i) * t / np.sqrt((v + t**2) * (n - i + 1))


def _medians(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, key))
    key, value = key[order], value[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    end = np.append(start[1:], len(key))
    return key[start], (value[(start + end - 1) // 2] + value[(start + end) // 2]) / 2


def seasonal(t: np.ndarray, x: np.ndarray, least: int = 5) -> np.ndarray:
    """Median course over the hours of the day, after a level through the days' medians is taken off; smoothed over neighbouring hours, and drawn through those with fewer than ``least`` readings."""
    day, level = _medians(t // DAY, x)
    hours = t // 3600 % 24
    hour, course = _medians(hours, x - np.interp(t, day * DAY + DAY // 2, level))
    enough = np.bincount(hours, minlength=24)[hour] >= least
    if not enough.any():
        return np.zeros(len(t))
    hour, course = hour[enough], course[enough]
    around = np.concatenate([course[-1:], course, course[:1]])
    if len(course) > 2:
        course = (around[:-2] + 2 * course + around[2:]) / 4
    return np.interp((t % DAY) / 3600 - 0.5, np.concatenate([[hour[-1] - 24], hour, [hour[0] + 24]]), np.concatenate([course[-1:], course, course[:1]]))


def decomposed(t: np.ndarray, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Season, trend and remainder of readings in order of time. The trend is the running median of 2 * width + 1 readings without their season: it follows slopes and lasting steps, and nothing that lasts ``width`` readings or less."""
    season = seasonal(t, x)
    y = x - season
    around = np.concatenate([y[:width][::-1], y, y[-width:][::-1]]) if len(y) > width else np.pad(y, width, mode="edge")
    trend = np.median(sliding_window_view(around, 2 * width + 1), axis=1)
    return season, trend, y - trend


def spreads(size: np.ndarray, octave: np.ndarray, least: float, sample: int, growth: float) -> np.ndarray:
    """For each octave of intervals the median of what is usual in it; where fewer than ``sample`` readings tell it, ``growth`` times that of the octave before."""
    out, now = np.zeros(int(octave.max()) + 1), least
    for k in range(len(out)):
        here = size[octave == k]
        now = max(now, float(np.median(here))) if len(here) >= sample else now * growth if k else now
        out[k] = now
    return out


def generalised_esd(size: np.ndarray, scale: np.ndarray, least: float, most: int, alpha: float, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Which deviations are extreme, and for each how far an extreme one would have to go.

    The largest deviation (in units of its scale) is taken away, the spread of the rest is estimated anew, and so on up to ``most`` times; what was taken up to the last one that is beyond
    ``margin`` times its limit is extreme. Spread is the median absolute deviation, so its estimate after each step is the middle one of the deviations that are left, which one sort gives.
    """
    n = len(size)
    z = size / scale
    order = np.argsort(-z, kind="stable")
    step = np.arange(most)
    left = np.minimum(1.0, z[order[np.minimum(step + (n - step) // 2, n - 1)]])
    limits = margin * esd_limits(n, most, alpha)
    taken = order[:most]
    beyond = np.flatnonzero(size[taken] > limits * 1.4826 * np.maximum(scale[taken] * left, least))
    out = np.zeros(n, bool)
    last = int(beyond[-1]) if len(beyond) else 0
    if len(beyond):
        out[order[: last + 1]] = True
    return out, limits[last] * 1.4826 * np.maximum(scale * left[last], least)


def excursions(t: np.ndarray, x: np.ndarray, width: int, alpha: float, margin: float, back: float, floor: float, most: float = 0.2, sample: int = 15, growth: float = 1.6, away: float = 0.7) -> np.ndarray:
    """Which readings stand in an excursion of at most ``width`` readings that leaves its surroundings and returns.

    Remainders of the decomposition go through the generalised ESD test, at most the part ``most`` of all readings being taken out. Their scale is that of remainders with neighbours as far apart (in powers
    of two of the usual interval), so that silent periods and slow stations are judged by what they usually do. Of what is beyond the limits, a block is marked if it is at most ``width`` long and all on one side,
    if it stands off the readings before and after it by ``away`` times the limit at least, and if these differ by at most ``back`` times that step (else the change lasts).
    """
    n = len(x)
    marked = np.zeros(n, bool)
    if n < 5:
        return marked
    season, _, remainder = decomposed(t, x, width)
    step = max(float(np.median(np.diff(t))), 1.0)
    gap = np.diff(t, prepend=t[0] - step, append=t[-1] + step)
    octave = np.maximum(np.floor(np.log2(np.maximum(np.maximum(gap[:-1], gap[1:]), 1) / step)), 0).astype(int)
    grain = 10.0 if np.mean(x % 10 == 0) > 0.95 else 5.0 if np.mean(x % 5 == 0) > 0.95 else 1.0
    least, size = max(floor, grain / 2), np.abs(remainder)
    extreme, limit = generalised_esd(size, spreads(size, octave, least, sample, growth)[octave], least, max(1, int(n * most)), alpha, margin)
    y, at = x - season, np.flatnonzero(extreme)
    new = np.diff(at) > 1
    for a, b in zip(at[np.concatenate([[True], new])].tolist(), at[np.concatenate([new, [True]])].tolist(), strict=True) if len(at) else ():
        side = np.sign(remainder[a])
        if b - a < width and a > 0 and b < n - 1 and (np.sign(remainder[a : b + 1]) == side).all():
            off = min(((y[a : b + 1] - y[a - 1]) * side).min(), ((y[a : b + 1] - y[b + 1]) * side).min())
            marked[a : b + 1] = off > away * limit[a : b + 1].max() and abs(y[b + 1] - y[a - 1]) <= back * off
    return marked


def implausible(
    df: DataFrame,
    source: str,
    time: str,
    value: str,
    low: float,
    high: float,
    width: int = 3,
    alpha: float = 0.001,
    margin: float = 1.7,
    back: float = 0.7,
    floor: float = 2.0,
    most: float = 0.2,
    sample: int = 15,
    growth: float = 1.6,
    away: float = 0.7,
    least_run: int = 8,
    chance: float = 0.001,
    tile: int = 4096,
    halo: int = 256,
    partitions: int | None = None,
) -> DataFrame:
    """Implausible readings as ``source, time, value, reason``; reason is ``range``, ``frozen`` or ``spike``, a row for each that holds.

    range: outside [low, high]. frozen: a run of one value at least ``least_run`` long and so long that a source repeating its value as often as this one does
    elsewhere would show it with probability ``chance`` at most. spike: up to ``width`` readings beyond ``margin`` times the generalised ESD limit (level ``alpha``)
    of the remainder after a robust seasonal-trend decomposition, followed by a return; see ``excursions`` for the other parameters.

    Method: one global sort on (source, time) by sampled quantiles. Partitions number their readings and their runs of one value and report long and outermost runs; positions and
    runs are stitched over partition edges with two rows per partition, and a frozen run's readings are found by its number in its partition. The decomposition takes a source of less than two
    ``tile`` readings as a whole, larger ones in tiles of ``tile`` to twice as many consecutive readings with ``halo`` more on either side, so a source of any size is many tasks.

    Defined results: rows with a null in source, time or value (or NaN) take no part and do not break a run; repeated rows count once; readings outside the limits are no part
    of runs or surroundings. A source with fewer than five readings has no spikes. An empty table gives an empty result. Only the named columns are read.
    """
    kinds = {c: df.schema[c].dataType for c in (source, time, value)}
    rows = df.select(F.col(f"`{source}`").alias("source"), F.col(f"`{time}`").cast("long").alias("time"), F.col(f"`{value}`").cast("double").alias("value"))
    rows = rows.where("source is not null and time is not null and value is not null and not isnan(value)")
    rows = rows.distinct()
    schema = T.StructType(
        [
            T.StructField("kind", T.StringType()),  # bad: a reading outside the limits; row: one inside; run: a run (time..until, n readings); count: n readings of which runs begin
            T.StructField("source", kinds[source]),
            T.StructField("time", T.LongType()),
            T.StructField("value", T.DoubleType()),
            T.StructField("pid", T.IntegerType()),
            T.StructField("gid", T.LongType()),
            T.StructField("place", T.LongType()),
            T.StructField("until", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("runs", T.LongType()),  # of a row or run: the number of its run in its partition; of a count: runs that begin
        ]
    )

    def scan(pid: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: str, src: pa.Array, t: np.ndarray, v: np.ndarray, gid: np.ndarray, place: np.ndarray, until: np.ndarray, n: np.ndarray, runs: np.ndarray) -> pa.RecordBatch:
            k = len(src)
            ints = [np.broadcast_to(x, k).astype(np.int64) for x in (gid, place, until, n, runs)]
            return pa.RecordBatch.from_arrays([pa.array([kind] * k, pa.string()), src, pa.array(np.broadcast_to(t, k).astype(np.int64)), pa.array(np.broadcast_to(v, k).astype(float)), pa.array(np.full(k, pid, np.int32)), *map(pa.array, ints)], schema.names)

        last, gid, carry, rid = None, -1, 0, -1
        held = None  # the open run: source, value, first time, last time, readings, whether it opens the partition, its number
        for b in batches:
            bad = (b.column(2).to_numpy() < low) | (b.column(2).to_numpy() > high)
            if bad.any():
                off, b = b.filter(pa.array(bad)), b.filter(pa.array(~bad))
                yield out("bad", off.column(0), off.column(1).to_numpy(), off.column(2).to_numpy(), 0, 0, 0, 1, 0)
                if not b.num_rows:
                    continue
            n, src, t, v = b.num_rows, b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy()
            starts = any_changed([src], last and last[:1])
            new = starts | any_changed([b.column(2)], last and last[2:3])
            at = np.arange(n)
            place = at - np.maximum.accumulate(np.where(starts, at, 0)) + 1
            place[: int(starts.argmax()) if starts.any() else n] += carry
            gids = gid + np.cumsum(starts)
            last, gid, carry = [b.column(k)[n - 1] for k in range(3)], int(gids[-1]), int(place[-1])
            rids = rid + np.cumsum(new)
            rid = int(rids[-1])
            yield out("row", src, t, v, gids, place, t, 1, rids)
            s = np.flatnonzero(np.concatenate([[True], starts[1:]]))
            yield out("count", src.take(pa.array(s)), t[s], 0.0, gids[s], 0, t[s], np.diff(np.append(s, n)), np.add.reduceat(new.astype(np.int64), s))
            # runs of this batch; the first may go on from the batch before, the last is held open
            r = np.flatnonzero(np.concatenate([[True], new[1:]]))
            e = np.append(r[1:], n) - 1
            size, begin = (e - r + 1).astype(np.int64), t[r].copy()
            opens = np.zeros(len(r), bool)
            if held is not None and not new[0]:
                begin[0], size[0], opens[0] = held[2], size[0] + held[4], held[5]
            elif held is not None:
                if held[4] >= least_run or held[5]:
                    yield out("run", held[0], held[2], held[1], int(held[5]), 0, held[3], held[4], held[6])
            else:
                opens[0] = True
            keep = np.flatnonzero((size >= least_run) | opens)
            keep = keep[keep < len(r) - 1]
            if len(keep):
                yield out("run", src.take(pa.array(r[keep])), begin[keep], v[r[keep]], opens[keep].astype(int), 0, t[e[keep]], size[keep], rids[r[keep]])
            held = (src.slice(int(r[-1]), 1), v[r[-1]], begin[-1], t[e[-1]], int(size[-1]), bool(opens[-1]), rid)
        if held is not None:
            yield out("run", held[0], held[2], held[1], 2 + int(held[5]), 0, held[3], held[4], held[6])  # gid of a run: 1 it opens, 2 it ends its partition, 3 both

    spark = df.sparkSession
    scanned = cut(range_scan(rows, [F.col("source").asc(), F.col("time").asc(), F.col("value").asc()], scan, schema, partitions))

    notes = cut(scanned.where("kind <> 'row'"))  # few beside the readings, and read many times
    # runs at partition edges: at most two rows per partition come to the driver and are joined up there
    outer = notes.where("kind = 'run' and gid > 0").select("pid", "gid", "source", "value", "n", "runs").collect()
    joined, open_ = [], None
    for r in sorted(outer, key=lambda r: (r.pid, r.gid == 2)):
        piece = [r.source, r.value, r.n, [(r.pid, r.runs)]]
        if r.gid != 2 and open_ is not None and same(open_[:2], piece[:2]):
            piece = [*piece[:2], open_[2] + r.n, open_[3] + piece[3]]
        elif open_ is not None:
            joined.append(open_)
            open_ = None
        if r.gid == 1:
            joined.append(piece)
            open_ = None
        else:
            open_ = piece
    if open_ is not None:
        joined.append(open_)
    parts_ = T.ArrayType(T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("run", T.LongType())]))
    stitched = spark.createDataFrame([(x[0], x[2], x[3]) for x in joined if x[2] >= least_run], T.StructType([T.StructField("source", kinds[source]), T.StructField("n", T.LongType()), T.StructField("parts", parts_)]))
    runs = notes.where(f"kind = 'run' and gid = 0 and n >= {least_run}").select("source", "n", F.array(F.struct("pid", F.col("runs").alias("run"))).alias("parts")).unionByName(stitched)

    def longest(readings: Column, begun: Column) -> Column:
        repeat = F.least(F.greatest(1 - begun / F.greatest(readings, F.lit(1)), F.lit(0.001)), F.lit(0.999))
        return F.greatest(F.lit(least_run), F.ceil(F.log(F.greatest(readings, F.lit(2)) / chance) / -F.log(repeat)))

    # a run that goes on over a partition's edge began once, but was counted as beginning in each partition
    over = [(x[0], 0, 1 - len(x[3])) for x in joined if len(x[3]) > 1]
    repeated = spark.createDataFrame(over, T.StructType([T.StructField("source", kinds[source]), T.StructField("n", T.LongType()), T.StructField("runs", T.LongType())]))
    # how often a source repeats its value elsewhere: first without runs of least_run, then without the runs found frozen on that basis
    counts = notes.where("kind = 'count'").select("source", "n", "runs").unionByName(repeated).groupBy("source").agg(F.sum("n").alias("readings"), F.sum("runs").alias("begun"))
    taken = lambda d: d.groupBy("source").agg(F.sum("n").alias("off_n"), F.count(F.lit(1)).alias("off_runs"))
    rest = lambda d: d.withColumn("limit", longest(F.col("readings") - F.coalesce("off_n", F.lit(0)), F.greatest(F.col("begun") - F.coalesce("off_runs", F.lit(0)), F.lit(1))))
    first = rest(taken(runs).join(counts, "source")).select("source", "readings", "begun", F.col("limit").alias("first_limit"))
    again = taken(runs.join(first.select("source", "first_limit"), "source").where("n >= first_limit"))
    limits = rest(first.join(again, "source", "left")).select("source", "limit")
    frozen = cut(runs.join(limits, "source").where("n >= limit").select(F.explode("parts").alias("x")).select(F.col("x.pid").alias("fp"), F.col("x.run").alias("fr")))
    readings = scanned.where("kind = 'row'").select("source", "time", "value", "pid", "gid", "place", "runs")
    stuck = readings.join(small(frozen), (F.col("pid") == F.col("fp")) & (F.col("runs") == F.col("fr")), "left_semi")

    ranked, offset = with_offsets(readings, chain(edges(notes.where("kind = 'count'"), ["source"], "pid", "gid", F.col("n"))), "pid", "gid")
    large = small(cut(counts.where(F.col("readings") >= 2 * tile).select(F.col("source").alias("ls"), (F.floor(F.col("readings") / tile) - 1).alias("last"))))  # the last tile takes in what is left over
    at = F.col("place") + F.col(offset) - 1
    ranked = ranked.join(large, F.col("source") == F.col("ls"), "left").withColumn("last", F.coalesce("last", F.lit(0)))
    home = F.least(F.floor(at / tile), F.col("last"))
    near = F.array_compact(F.array(home, F.when((at - home * tile < halo) & (home > 0), home - 1), F.when((at - home * tile >= tile - halo) & (home < F.col("last")), home + 1)))
    tiled = ranked.select("source", F.explode(near).alias("tile"), "time", "value", home.alias("home"))
    tiled = tiled.repartition("source", "tile").sortWithinPartitions("source", "tile", "time", "value")
    found = T.StructType([T.StructField("source", kinds[source]), T.StructField("time", T.LongType()), T.StructField("value", T.DoubleType())])

    def spikes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 2):
            t, v = g.column(2).to_numpy(), g.column(3).to_numpy()
            hit = excursions(t, v, width, alpha, margin, back, floor, most, sample, growth, away) & (g.column(4).to_numpy() == g.column(1).to_numpy())
            if hit.any():
                yield pa.RecordBatch.from_arrays([g.column(k).filter(pa.array(hit)) for k in (0, 2, 3)], found.names)

    outside = notes.where("kind = 'bad'").select("source", "time", "value").withColumn("reason", F.lit("range"))
    parts = [outside, stuck.select("source", "time", "value").withColumn("reason", F.lit("frozen")), tiled.mapInArrow(spikes, found).withColumn("reason", F.lit("spike"))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.select(F.col("source").alias(source), F.col("time").cast(kinds[time]).alias(time), F.col("value").cast(kinds[value]).alias(value), "reason")


def limit_of_run(readings: int, repeat: float, chance: float = 0.001, least: int = 8) -> int:
    """The run length beyond which ``implausible`` calls a run frozen, for a source of so many readings that repeats its value with this frequency."""
    return max(least, math.ceil(math.log(max(readings, 2) / chance) / -math.log(min(max(repeat, 0.001), 0.999))))
