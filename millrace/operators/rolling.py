"""Rolling totals over trailing calendar periods, days without activity included."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.ordered import any_changed
from millrace.session import cut


def calendar_day(number: Column) -> Column:
    """Days since 1970 of a yyyymmdd number; null where no calendar has that day (month 13, 30 February, day 0, year 0)."""
    y, m, d = F.floor(number / 10000).cast("int"), F.floor(F.pmod(number, F.lit(10000)) / 100).cast("int"), F.pmod(number, F.lit(100)).cast("int")
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    longest = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    there = number.between(10101, 99991231) & m.between(1, 12) & (d >= 1) & (d <= longest)
    return F.when(there, F.unix_date(F.make_date(y, m, d)))


def day_number(day: Column) -> Column:
    """yyyymmdd of days since 1970."""
    date = F.date_from_unix_date(day)
    return (F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)).cast("int")


def _bands(tile: int, windows: list[int]) -> list[np.ndarray]:
    """For each window the matrix that turns the days of a tile and the halo before it into trailing sums of the tile's days."""
    halo = max(windows) - 1
    day, out = np.arange(tile + halo)[:, None], np.arange(tile)[None, :] + halo
    return [((day <= out) & (day > out - w)).astype(float) for w in windows]


def rolling_totals(df: DataFrame, entity: str, day: str, value: str, windows: tuple[int, ...] = (7, 30), tile_days: int = 256, pack: int = 64) -> DataFrame:
    """Totals, counts and averages over the trailing ``windows`` days of every entity and every day from its first to its last active one.

    day: integer column of days since 1970. Returns ``entity, day, n_1, sum_1`` and for each window w ``n_w, sum_w, avg_w`` (w days up to and
    including the day; avg_w is sum_w / n_w, null where the window holds no row).

    Method: rows are summed to (entity, day) with partial sums before the shuffle. Time is cut into tiles of ``tile_days``; a day's sum also goes
    to the next tile where it lies in that tile's halo of the preceding max(windows) - 1 days. Within a partition up to ``pack`` entities of one
    tile are laid out as a dense block, entities by days, and multiplied by the banded window matrices. An (entity, tile) has a bounded number of
    rows, so an entity of any length is spread over as many tasks as it has tiles.

    Defined results: rows with a null entity, day or value, or a value that is not finite, take no part; an entity without usable rows is not in the
    result. Repeated rows count each time. An empty table gives an empty result. Only the three named columns are read.
    """
    if not windows or min(windows) < 1:
        raise ValueError("windows must be at least one day")
    halo = max(windows) - 1
    tile_days = max(tile_days, halo, 1)
    e, v = F.col(f"`{entity}`"), F.col(f"`{value}`").cast("double")
    used = df.select(e.alias("entity"), F.col(f"`{day}`").cast("int").alias("day"), v.alias("value"))
    used = used.where("entity is not null and day is not null and value is not null and not isnan(value) and abs(value) < double('infinity')")
    daily = cut(used.groupBy("entity", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))  # read twice below
    tile = F.floor(F.col("day") / tile_days).cast("int")
    last_days = F.col("day") - tile * tile_days >= tile_days - halo
    rows = daily.select("entity", F.explode(F.when(F.lit(halo > 0) & last_days, F.array(tile, tile + 1)).otherwise(F.array(tile))).alias("tile"), "day", "n", "total")
    span = daily.groupBy("entity").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    # every tile of an entity's span, each with the span itself; these rows stand before the tile's days
    frame = span.select("entity", F.explode(F.sequence(F.floor(F.col("lo") / tile_days).cast("int"), F.floor(F.col("hi") / tile_days).cast("int"))).alias("tile"), F.lit(None).cast("int").alias("day"), F.col("lo").cast("long").alias("n"), F.col("hi").cast("double").alias("total"))
    laid = frame.unionByName(rows).repartition("entity", "tile").sortWithinPartitions("tile", "entity", F.col("day").asc_nulls_first())
    kind = df.schema[entity].dataType
    fields = [T.StructField("entity", kind), T.StructField("day", T.IntegerType()), T.StructField("n_1", T.LongType()), T.StructField("sum_1", T.DoubleType())]
    for w in windows:
        fields += [T.StructField(f"n_{w}", T.LongType()), T.StructField(f"sum_{w}", T.DoubleType())] if w > 1 else []
    schema = T.StructType(fields)
    wide = [w for w in windows if w > 1]
    bands = _bands(tile_days, wide) if wide else []

    def block(names: pa.Array, at: int, who: np.ndarray, days: np.ndarray, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch | None:
        """who: ordinal of each row's entity; rows with day -1 hold the span."""
        size = len(names)
        head = days < 0
        lo, hi = np.full(size, 1, np.int64), np.full(size, 0, np.int64)
        lo[who[head]], hi[who[head]] = n[head], total[head].astype(np.int64)
        counts, sums = np.zeros((size, tile_days + halo)), np.zeros((size, tile_days + halo))
        body = ~head
        counts[who[body], days[body]], sums[who[body], days[body]] = n[body], total[body]
        all_days = at * tile_days + np.arange(tile_days)
        keep = (all_days[None, :] >= lo[:, None]) & (all_days[None, :] <= hi[:, None])
        if not keep.any():
            return None
        row, col = np.nonzero(keep)
        cols = [names.take(pa.array(row)), pa.array(all_days[col].astype(np.int32)), pa.array(counts[:, halo:][keep].astype(np.int64)), pa.array(sums[:, halo:][keep])]
        for m in bands:
            cols += [pa.array(np.rint((counts @ m)[keep]).astype(np.int64)), pa.array((sums @ m)[keep])]
        return pa.RecordBatch.from_arrays(cols, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # of the open block: names, ordinals, days, n, totals
        last, at, size = None, None, 0

        def closed() -> Iterator[pa.RecordBatch]:
            if held:
                out = block(pa.concat_arrays([h[0] for h in held]), at, *(np.concatenate([h[k] for h in held]) for k in range(1, 5)))
                if out is not None:
                    yield out
            held.clear()

        for b in batches:
            if not b.num_rows:
                continue
            starts = any_changed([b.column(1), b.column(0)], last)
            last = [b.column(1)[b.num_rows - 1], b.column(0)[b.num_rows - 1]]
            tiles = b.column(1).to_numpy()
            day = b.column(2).fill_null(-(2**31)).to_numpy().astype(np.int64)
            offset = np.where(day == -(2**31), -1, day - tiles.astype(np.int64) * tile_days + halo)
            # a block ends where the tile changes or it holds `pack` entities
            first = np.flatnonzero(starts)
            cutting, here, tile_now = [], size, at
            for k in first:
                if tiles[k] != tile_now or here == pack:
                    cutting.append(int(k))
                    here, tile_now = 0, tiles[k]
                here += 1
            bounds = [0, *cutting, b.num_rows]
            for k in range(len(bounds) - 1):
                i, j = bounds[k], bounds[k + 1]
                if k and cutting:
                    yield from closed()
                    size, at = 0, int(tiles[i])
                if j > i:
                    who = size - 1 + np.cumsum(starts[i:j])
                    fresh_names = b.column(0).slice(i, j - i).filter(pa.array(starts[i:j]))
                    held.append((fresh_names, who, offset[i:j], b.column(3).slice(i, j - i).to_numpy(), b.column(4).slice(i, j - i).to_numpy()))
                    size = int(who[-1]) + 1
        yield from closed()

    out = laid.mapInArrow(run, schema)
    cols = [F.col("entity").alias(entity), F.col("day"), F.col("n_1"), F.col("sum_1")]
    for w in windows:
        cols += [F.col(f"n_{w}"), F.col(f"sum_{w}")] if w > 1 else []
        cols += [F.when(F.col(f"n_{w}") > 0, F.col(f"sum_{w}") / F.col(f"n_{w}")).alias(f"avg_{w}")]
    return out.select(*cols)
