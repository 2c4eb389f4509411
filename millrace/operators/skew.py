"""Per-key results when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.operators.ordered import any_changed, changed, fresh, range_scan
from millrace.session import cut, shuffle_partitions, steady


def _states(names: list[str]) -> Callable:
    def fn(pid: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for seq, b in enumerate(batches):
            key, item = b.column(0), b.column(1)
            starts = changed(key, last and last[0])
            new = any_changed([key, item], last)
            new &= item.is_valid().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(np.concatenate([[True], starts[1:]]))
            end = np.append(at[1:], b.num_rows) - 1
            last = [key[b.num_rows - 1], item[b.num_rows - 1]]
            yield pa.RecordBatch.from_arrays(
                [key.take(pa.array(at)), pa.array(np.full(len(at), pid, np.int32)), pa.array(np.full(len(at), seq, np.int64)), pa.array((end - at + 1).astype(np.int64)), pa.array(np.add.reduceat(new.astype(np.int64), at)), item.take(pa.array(at)), item.take(pa.array(end))],
                names,
            )

    return fn


def key_states(df: DataFrame, key: str, item: str, partitions: int | None = None) -> DataFrame:
    """Partial states of each key, one per partition that holds a part of it: ``key, pid, rows, items, first_item, last_item``.

    Rows are range-partitioned on (key, item, a hash of the row's place) by sampled quantiles, so a heavy key, even one made of
    exact copies of a single item, is split over partitions of like size, and each partition holds whole stretches in order.
    """
    spread = F.xxhash64(F.monotonically_increasing_id())
    rows = steady(df.select(*{key: F.col(f"`{key}`"), item: F.col(f"`{item}`")}.values())).select(F.col(f"`{key}`").alias("key"), F.col(f"`{item}`").alias("item"), spread.alias("spread"))
    kind = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType(
        [T.StructField("key", kind["key"]), T.StructField("pid", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("seq", "rows", "items")), *(T.StructField(c, kind["item"]) for c in ("first_item", "last_item"))]
    )
    pieces = range_scan(rows, [F.col("key").asc_nulls_first(), F.col("item").asc_nulls_first(), F.col("spread")], _states(schema.names), schema, partitions)
    return cut(pieces).groupBy("key", "pid").agg(F.sum("rows").alias("rows"), F.sum("items").alias("items"), F.min_by("first_item", "seq").alias("first_item"), F.max_by("last_item", "seq").alias("last_item"))


def key_counts(df: DataFrame, key: str, item: str, partitions: int | None = None) -> DataFrame:
    """Rows and distinct non-null items of every key: ``key, n_rows, n_items``; the null key, if any, is one of them.

    The states of a key are stitched in the order of their partitions: an item that ends one partition and begins the next
    was counted in both and is taken off once. A window here sees at most one state per partition.
    An empty table gives no rows; only the two named columns are read, so other columns and their names do not matter.
    """
    before = F.lag("last_item").over(Window.partitionBy("key").orderBy("pid"))
    stitched = key_states(df, key, item, partitions).withColumn("again", F.coalesce((before == F.col("first_item")).cast("long"), F.lit(0)))
    return stitched.groupBy("key").agg(F.sum("rows").alias("n_rows"), F.sum(F.col("items") - F.col("again")).alias("n_items"))


#: Sampled rows per slot from which skew_join takes its quantiles; the driver gets at most this many times the number of slots.
SAMPLE_PER_SLOT = 40


def skew_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", slots: int | None = None, seed: int = 7) -> DataFrame:
    """Equi-join of a skewed left side with a right side (inner, left, right or full): every heavy key is split over as many slots as its share asks for.

    Quantiles of (key, row hash) in a bounded sample of the left side cut it into ``slots`` ranges; a key that holds several cuts is
    heavy. Its left rows take the slot between whose cuts their hash lies, its right rows are repeated once for each of its slots, and the
    join is on (key, slot). The table of cuts has at most ``slots`` rows. The sample decides only how work is spread, never the result.

    Right and full joins add what an anti join against the left side's distinct keys leaves of the right side, as rows that are repeated over slots can't tell there whether they match.

    Null keys match nothing (the joins that keep a side keep its null keys). Columns of the right side whose names clash get a numbered name.
    """
    if how not in ("inner", "left", "right", "full"):
        raise ValueError("how must be inner, left, right or full")
    spark = left.sparkSession
    slots = slots or shuffle_partitions(spark)
    taken = list(left.columns)
    renamed = []
    for c in right.columns:
        renamed.append(fresh(taken, c))
        taken.append(renamed[-1])
    rk = renamed[right.columns.index(right_key)]
    h, slot, cuts, ck = (fresh([*taken], x) for x in ("row_hash", "slot", "cuts", "cut_key"))
    left = steady(left)
    left_h = left.withColumn(h, F.xxhash64(F.col(f"`{left_key}`"), F.monotonically_increasing_id()))
    keyed = left_h.where(F.col(f"`{left_key}`").isNotNull()).select(F.col(f"`{left_key}`").alias(ck), F.col(h).alias("h"))
    most = SAMPLE_PER_SLOT * slots
    n = left.select(left_key).count()
    sample = sorted((r[0], r[1]) for r in (keyed.sample(min(1.0, most / max(n, 1)), seed) if n > most else keyed).limit(2 * most).collect())
    at: dict = {}
    for k in range(1, slots):
        if sample:
            key, value = sample[len(sample) * k // slots]
            at.setdefault(key, set()).add(value)
    heavy = {k: sorted(v) for k, v in at.items() if len(v) > 1}
    schema = T.StructType([T.StructField(ck, keyed.schema[ck].dataType), T.StructField(cuts, T.ArrayType(T.LongType()))])
    table = F.broadcast(spark.createDataFrame(list(heavy.items()), schema))
    left_s = left_h.join(table, F.col(f"`{left_key}`") == F.col(ck), "left").withColumn(slot, F.coalesce(F.size(F.filter(F.col(cuts), lambda c: c <= F.col(h))), F.lit(0))).drop(ck, cuts, h)
    left_s = left_s.withColumn(slot, F.greatest(F.col(slot), F.lit(0)))
    r = right.toDF(*renamed)
    rslot = fresh([*taken, slot], "right_slot")
    r = r.join(table, F.col(f"`{rk}`") == F.col(ck), "left").withColumn(rslot, F.explode(F.sequence(F.lit(0), F.coalesce(F.size(cuts), F.lit(0))))).drop(ck, cuts)
    matched = left_s.join(r, (F.col(f"`{left_key}`") == F.col(f"`{rk}`")) & (F.col(slot) == F.col(rslot)), "left" if how in ("left", "full") else "inner").drop(slot, rslot)
    if how in ("inner", "left"):
        return matched
    keys = left.select(F.col(f"`{left_key}`").alias(ck)).where(F.col(ck).isNotNull()).distinct()
    alone = right.toDF(*renamed).join(keys, F.col(f"`{rk}`") == F.col(ck), "left_anti")
    return matched.unionByName(alone.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema.fields], *[F.col(f"`{c}`") for c in renamed]))
