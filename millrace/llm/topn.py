"""Top N items within every group, by exact positions in a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import chain, edges, fresh, numbered, with_offsets


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, partitions: int | None = None) -> DataFrame:
    """The n best items of every group: columns group, item, score and ``position`` (1 is best).

    Method: (group, item) pairs are reduced to their best score (combined before the shuffle), then sorted globally
    by group, score descending and item by sampled range partitioning, so a group of any size lies in many partitions. Each partition
    numbers its groups and drops places beyond n; the counts at partition edges are prefix-summed into exact positions.

    Defined results: an item that stands in a group several times counts once, with its highest score; ties go to the lower item.
    A null group is a group of its own, a null score ranks below all others, a null item behind other items of equal score. An empty
    table gives an empty result. Only the three named columns are read; other columns, whatever their names, are left out.
    If a named column is called ``position``, the result's position is ``position_1``.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    cols = [group, item, score]
    g, i, s = (F.col(f"`{c}`") for c in cols)
    best = df.groupBy(g, i).agg(F.max(s).alias(score))
    reduced, at = numbered(best, [group], [s.desc_nulls_last(), i.asc_nulls_last()], keep=n, partitions=partitions)
    # a group that fills partitions has n places in each of them, so counts capped at n still decide position <= n
    offsets = chain(edges(reduced, [group], at["pid"], at["gid"], F.lit(1)))
    placed, offset = with_offsets(reduced, offsets, at["pid"], at["gid"])
    position = F.col(at["place"]) + F.col(offset)
    return placed.where(position <= n).select(g, i, s, position.cast("int").alias(fresh(cols, "position")))
