"""Whole programs on bags and matrices: iterative graphs and composed statistics."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut


def page_rank(edges: DataFrame, damping: float = 0.5, rounds: int | None = None, tolerance: float = 1e-6, most: int = 100) -> DataFrame:
    """Ranks of a graph's vertices (id, rank), from its edges (src, dst): 1 - damping plus damping times what neighbours hand on.

    Runs a given number of rounds or until no rank changes by more than ``tolerance``. Edges are partitioned by their source once; every round is one join and one aggregation with partial sums, and is
    checkpointed, so lineage stays short. Repeated edges count each time. No edges give no ranks.
    """
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    links = cut(edges.join(degree, "src"))
    vertices = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    ranks = cut(vertices.withColumn("rank", F.lit(1.0)))
    for _ in range(rounds or most):
        given = links.join(ranks, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        new = ranks.join(given, F.col("id") == F.col("dst"), "left").select("id", F.col("rank").alias("old"), (F.lit(1 - damping) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("rank"))
        new = cut(new)
        ranks = new.select("id", "rank")
        if rounds is None and (new.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0) <= tolerance:
            break
    return ranks


def shortest_paths(edges: DataFrame, start: DataFrame, most: int = 100) -> DataFrame:
    """Least number of edges (id, distance) from any vertex of ``start`` (id) along edges (src, dst), up to ``most``; vertices that can't be reached are not there.

    Each round only carries the vertices that were reached last; it ends when there are none.
    """
    links = cut(edges.select("src", "dst").distinct())
    reached = [cut(start.select("id").distinct().withColumn("distance", F.lit(0)))]  # what each round adds; nothing is written twice
    for d in range(1, most + 1):
        step = links.join(reached[-1], F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id")).distinct()
        known = functools.reduce(DataFrame.unionByName, reached).select("id")
        new = cut(step.join(known, "id", "left_anti").withColumn("distance", F.lit(d)))
        if new.isEmpty():
            break
        reached.append(new)
    return functools.reduce(DataFrame.unionByName, reached)


def similarity(pairs: DataFrame, *keys: str) -> DataFrame:
    """Correlation and cosine of paired values x, y per key, from eight reductions in one aggregation."""
    sums = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))
    spread: Column = F.sqrt(F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * F.sqrt(F.col("n") * F.col("syy") - F.col("sy") * F.col("sy"))
    norm = F.sqrt("sxx") * F.sqrt("syy")
    return sums.select(*keys, "n", "max_x", "max_y", F.when(spread > 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / spread).alias("correlation"), F.when(norm > 0, F.col("sxy") / norm).alias("cosine"))
