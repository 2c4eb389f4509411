"""Mixing sources to target weights with capped repeats."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.ordered import chain, edges, groups, numbered, with_offsets
from millrace.session import cut, small

#: The tree of weights is laid out on the driver; more leaves than this are refused.
MAX_LEAVES = 100_000


@dataclass
class Node:
    """A node of the weight tree; a leaf has tokens (of one epoch) and repeats, an inner node children."""

    weight: float
    tokens: int = 0
    repeats: int = 1
    children: dict = field(default_factory=dict)
    budget: float = 0.0

    @property
    def capacity(self) -> float:
        return sum(c.capacity for c in self.children.values()) if self.children else self.tokens * self.repeats


def share_out(nodes: list[Node], budget: float) -> None:
    """Gives each node its weight's part of the budget, at most its capacity; what one can't take goes to its siblings by weight, and so on down.

    A node's capacity is that of its leaves, so a leaf's shortage is first made up by its own siblings, and only what these
    can't take was never given to their parent but to the parent's siblings.
    """
    open_, left = [n for n in nodes if n.capacity > 0 and n.weight > 0], budget
    for n in nodes:
        n.budget = 0.0
    while open_ and left > 1e-9:
        total = sum(n.weight for n in open_)
        full = [n for n in open_ if n.capacity <= left * n.weight / total]
        if not full:
            for n in open_:
                n.budget = left * n.weight / total
            break
        for n in full:
            n.budget = float(n.capacity)
        left -= sum(n.budget for n in full)
        open_ = [n for n in open_ if n not in full]
    for n in nodes:
        if n.children:
            share_out(list(n.children.values()), n.budget)


def reachable_total(sources: list[Node]) -> float:
    """The largest mix in which every source that has any tokens gets its share; a source without any leaves its share to the others."""
    there = [n for n in sources if n.capacity > 0 and n.weight > 0]
    whole = sum(n.weight for n in there)
    return min((n.capacity * whole / n.weight for n in there), default=0.0)


def weigh_below(node: Node, path: tuple, weigh: Callable[[tuple, int], float]) -> int:
    """Sets the weights of all nodes below a node; returns the tokens it holds."""
    if not node.children:
        return node.tokens
    held = 0
    for name, c in node.children.items():
        own = weigh_below(c, (*path, name), weigh)
        c.weight = float(weigh((*path, name), own))
        held += own
    return held


#: How many times what is left of a source's budget the records hold among which it is filled up.
FILL = 64


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of the records (source, tokens, what is short, place ...) that fill up their source: whatever fits, and at last the smallest one that brings the sum nearer. A source's records are few times what it is short of."""
    for g in groups(batches, 1):
        n, left, taken = g.column(1).to_numpy(), g.column(2)[0].as_py(), []
        over = -1
        for k, x in enumerate(n.tolist()):
            if x <= left:
                left -= x
                taken.append(k)
            elif over < 0 or x < n[over]:
                over = k
        if over >= 0 and n[over] < 2 * left:
            taken.append(over)
        if taken:
            yield pa.RecordBatch.from_arrays([g.column(k).take(pa.array(taken)) for k in (3, 4, 5)], ["fp", "fg", "ft"])


def mix(
    records: DataFrame,
    targets: DataFrame,
    ident: str,
    source: str,
    leaf: str,
    tokens: str,
    share: str = "target_share",
    repeats: str = "max_repeats",
    total: float | None = None,
    epochs: float | None = None,
    seed: int = 17,
    domain: str | None = None,
    weigh: Callable[[tuple, int], float] = lambda path, held: float(held),
) -> tuple[DataFrame, DataFrame]:
    """Chooses how often each record is used. Returns (uses, report).

    uses: ``ident, source, leaf, tokens, times`` with times >= 1. report, one row per target source: ``source, target_share, max_repeats, n_records,
    available_tokens, budget_tokens, mixed_tokens, actual_share, most_times``.

    total: tokens of the mix; None takes the largest mix in which every source that has records reaches its share. epochs gives the total as a multiple of the tokens of all
    targeted sources. With a given total a source is used up at most ``repeats`` times and its shortage goes to the others by weight.

    domain: a column of targets; its sources are siblings below a node that weighs what they do together. leaf: a struct column gives one level of the tree per field.
    weigh: weight of a node below a source among its siblings, from its path (source, level, ...) and the tokens it holds; by default these tokens.

    Method: the weights of sources are propagated down a tree of domain, source and levels; shortages go to siblings before ancestors. A leaf takes as many whole
    epochs as its budget holds and a token-prefix of one more epoch, whose order is a seeded hash; the prefix is found by a global sort on (leaf, hash) with prefix sums over
    partitions, so a leaf of any size is many tasks. What the prefixes of a source's leaves leave of its budget is filled up, in another seeded order, with records that still fit, and in the end with the
    smallest one that brings the source nearer to its budget. So every source is off by less than half of its smallest record not used up (of those looked at: enough for ``FILL`` times what is to be filled).

    Defined results: records without tokens, with a null ident, or of a source without target are not used; a null leaf is a leaf. Idents are taken as given: a repeated ident is
    a record each time. Targets with a null source, share or repeats (or a repeated source) raise ValueError. Empty records give no uses and a report of zeros.
    """
    spark = records.sparkSession
    named = targets.select(source, share, repeats, *([domain] if domain else [])).limit(MAX_LEAVES + 1).collect()
    wanted = [(r[0], r[1], r[2]) for r in named]
    if len(wanted) > MAX_LEAVES:
        raise ValueError("too many sources")
    if any(None in r for r in wanted) or len({r[0] for r in wanted}) < len(wanted):
        raise ValueError("targets must name each source once, with a share and a number of repeats")
    kinds = {c: records.schema[c].dataType for c in (ident, source, leaf)}
    table = F.broadcast(spark.createDataFrame([(r[0],) for r in wanted], T.StructType([T.StructField("s", kinds[source])])))
    used = records.select(F.col(f"`{ident}`").alias("i"), F.col(f"`{source}`").alias("s"), F.col(f"`{leaf}`").alias("l"), F.col(f"`{tokens}`").cast("long").alias("n"))
    used = cut(used.where("i is not null and n > 0").join(table, "s", "left_semi"))
    sizes = used.groupBy("s", "l").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("records")).limit(MAX_LEAVES + 1).collect()
    if len(sizes) > MAX_LEAVES:
        raise ValueError("too many leaves")
    tree = {s: Node(w, repeats=r) for s, w, r in wanted}
    leaves = []
    for row in sizes:
        at_, path = tree[row.s], row.l if isinstance(row.l, tuple) else (row.l,)
        for name in path[:-1]:
            at_ = at_.children.setdefault(name, Node(0.0))
        at_.children[path[-1]] = Node(0.0, row.n, tree[row.s].repeats)
        leaves.append((row.s, row.l, at_.children[path[-1]]))
    for s, top in tree.items():
        weigh_below(top, (s,), weigh)
    tops: list[Node] = list(tree.values())
    if domain:
        families: dict = {}
        for r in named:
            families.setdefault(r[3], {})[r[0]] = tree[r[0]]
        tops = [Node(sum(n.weight for n in f.values()), children=f) for f in families.values()]
    if epochs is not None:
        total = epochs * sum(row.n for row in sizes)
    reach = [Node(n.weight, reachable_total(list(n.children.values()))) for n in tops] if domain else tops
    aim = reachable_total(reach) if total is None else float(total)
    share_out(tops, aim)
    plan = []
    for g, (s, name, n) in enumerate(leaves):
        whole = min(int(n.budget // n.tokens), n.repeats)
        plan.append((g, s, name, whole, n.budget - whole * n.tokens if whole < n.repeats else 0.0, n.repeats))
    fields = [T.StructField("g", T.IntegerType()), T.StructField("ps", kinds[source]), T.StructField("pl", kinds[leaf]), T.StructField("whole", T.IntegerType()), T.StructField("rest", T.DoubleType()), T.StructField("most", T.IntegerType())]
    budgets = F.broadcast(spark.createDataFrame(plan, T.StructType(fields)))
    order: Column = F.xxhash64(F.lit(seed), F.col("whole"), F.col("i"))
    planned = used.join(budgets, (F.col("s") == F.col("ps")) & F.col("l").eqNullSafe(F.col("pl"))).drop("ps", "pl")
    spread = F.xxhash64(F.monotonically_increasing_id())  # so that records with one ident don't all lie in one partition
    rows, at = numbered(planned.withColumn("o", order).withColumn("spread", spread), ["g"], [F.col("o"), F.col("i"), F.col("spread")], amount="n")
    summed, offset = with_offsets(rows, chain(edges(rows, ["g"], at["pid"], at["gid"], F.col("n"))), at["pid"], at["gid"])
    summed = summed.withColumn("upto", F.col(at["place"]) + F.col(offset))
    base = summed.withColumn("times", F.col("whole") + (F.col("upto") <= F.col("rest")).cast("int"))
    # what prefixes leave of a source's budget is filled up in another seeded order
    got = {r.s: (r.n, r.spare) for r in base.groupBy("s").agg(F.sum(F.col("n") * F.col("times")).alias("n"), F.sum(F.when(F.col("times") < F.col("most"), F.col("n")).otherwise(0)).alias("spare")).collect()}
    short = [(s, tree[s].budget - n, min(1.0, FILL * (tree[s].budget - n) / spare)) for s, (n, spare) in got.items() if spare and tree[s].budget - n >= 0.5]
    shortages = F.broadcast(spark.createDataFrame(short, T.StructType([T.StructField("fs", kinds[source]), T.StructField("short", T.DoubleType()), T.StructField("part", T.DoubleType())])))
    again = F.xxhash64(F.lit(seed + 1), F.col("i"))
    spare = base.where("times < most").join(shortages, F.col("s") == F.col("fs")).where(F.col("n") < 2 * F.col("short")).where(again / F.lit(2.0**64) + 0.5 <= F.col("part"))
    spare = spare.select("s", "n", "short", again.alias("a"), "i", *at.values()).repartition("s").sortWithinPartitions("s", "a", "i", *at.values()).drop("a", "i")
    place = T.StructType([T.StructField("fp", T.IntegerType()), T.StructField("fg", T.LongType()), T.StructField("ft", T.LongType())])
    filled = small(cut(spare.mapInArrow(_fill, place)))
    base = base.join(filled, (F.col(at["pid"]) == F.col("fp")) & (F.col(at["gid"]) == F.col("fg")) & (F.col(at["place"]) == F.col("ft")), "left")
    chosen = base.withColumn("times", F.col("times") + F.col("fp").isNotNull().cast("int")).where("times > 0")
    uses = cut(chosen.select(F.col("i").alias(ident), F.col("s").alias(source), F.col("l").alias(leaf), F.col("n").alias(tokens), "times"))
    taken = {r[0]: (r[1], r[2]) for r in uses.groupBy(F.col(source)).agg(F.sum(F.col(tokens) * F.col("times")), F.max("times")).collect()}
    mixed = sum(v[0] for v in taken.values())
    held: dict = {}
    for x in sizes:
        records_, tokens_ = held.get(x.s, (0, 0))
        held[x.s] = (records_ + x.records, tokens_ + x.n)
    report = [(s, w, r, *held.get(s, (0, 0)), tree[s].budget, taken.get(s, (0, 0))[0], taken.get(s, (0, 0))[0] / mixed if mixed else 0.0, taken.get(s, (0, 0))[1]) for s, w, r in wanted]
    names = [source, "target_share", "max_repeats", "n_records", "available_tokens", "budget_tokens", "mixed_tokens", "actual_share", "most_times"]
    types = [kinds[source], T.DoubleType(), T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.LongType(), T.DoubleType(), T.IntegerType()]
    return uses, spark.createDataFrame(report, T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)]))


def tidy(c: Column) -> Column:
    """A source or language name without odd spelling: trimmed, lower case, without the suffix ``-x``; blank and ``und`` become null."""
    name = F.regexp_replace(F.lower(F.trim(c)), "-x$", "")
    return F.when(~name.isin("", "und"), name)
