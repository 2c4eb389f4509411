"""Running lists and values, several at a time, and results that are kept between runs."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.bag import Bag, Scalar
from millrace.sources.files import Files


def _plans(plan: Any, found: list) -> list:
    """All nodes of a logical plan, the root first."""
    found.append(plan)
    children = plan.children()
    for k in range(children.size()):
        _plans(children.apply(k), found)
    return found


#: What is worth keeping: nodes above which work would be done again.
_COSTLY = {"Aggregate", "Join", "Sort", "RepartitionByExpression", "Repartition", "Distinct", "Deduplicate", "Window", "Generate", "MapInArrow", "MapInPandas", "FlatMapGroupsInPandas", "CollectMetrics", "Except", "Intersect", "Sample"}


def common_ancestors(frames: list[DataFrame]) -> list[DataFrame]:
    """The largest parts that the plans of several frames have in common, of those that hold an operation worth keeping; as frames, the innermost first."""
    seen: dict[int, list] = {}
    for n, df in enumerate(frames):
        for node in _plans(df._jdf.queryExecution().analyzed(), []):
            entry = seen.setdefault(node.canonicalized().hashCode(), [node, set()])
            entry[1].add(n)
    out: list[tuple[int, DataFrame]] = []
    covered: set = set()
    for code, (node, users) in seen.items():  # roots come before what is below them
        below = _plans(node, [])
        codes = {x.canonicalized().hashCode() for x in below[1:]}
        if len(users) > 1 and (code, frozenset(users)) not in covered:
            if any(x.nodeName() in _COSTLY for x in below):
                spark = frames[0].sparkSession
                out.append((len(below), DataFrame(spark.sparkContext._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, node), spark)))
            covered |= {(c, frozenset(users)) for c in codes}
    return [df for _, df in sorted(out, key=lambda x: x[0])]


@contextmanager
def computed_once(*frames: DataFrame) -> Iterator[None]:
    """While it lasts, what several of the frames come from is computed once and kept (in memory, then on disk; what an executor takes with it is computed again)."""
    held = [d.persist() for d in common_ancestors(list(frames))] if len(frames) > 1 else []  # the innermost first, so that others are made from it
    try:
        yield
    finally:
        for d in held:
            d.unpersist()


def _again(df: DataFrame) -> DataFrame:
    """The same frame, planned anew, so that it sees what is kept by now."""
    spark = df.sparkSession
    return DataFrame(spark.sparkContext._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, df._jdf.queryExecution().logical()), spark)


def persist(*things: Bag | Scalar) -> list[Any]:
    """Writes every list to all its sinks and gives the values of the scalars, in their order; elements of lists stay where they are (``run`` brings them to the driver).

    What several lists and scalars have in common, and a list with several sinks, is computed once.
    """
    bags, scalars = [t for t in things if isinstance(t, Bag)], [t for t in things if isinstance(t, Scalar)]
    with computed_once(*[b.df for b in bags for _ in b.sinks], *[s.df for s in scalars]):
        for b in bags:
            for write in b.sinks:
                write(_again(b.df))
        return [replace(s, df=_again(s.df)).run() for s in scalars]


def run(*things: Bag | Scalar, shared: tuple[Bag, ...] = ()) -> list[Any]:
    """The values of lists and scalars, after sinks are written; what several of them come from is found and computed once. shared: lists to keep besides.

    All elements of every list come to the driver, of one with sinks too; ``persist`` leaves them where they are.
    """
    bags = [t for t in things if isinstance(t, Bag)]
    for s in shared:
        s.df.persist()
    try:
        with computed_once(*[t.df for t in things], *[b.df for b in bags for _ in b.sinks]):
            for b in bags:
                for write in b.sinks:
                    write(_again(b.df))
            return [replace(t, df=_again(t.df)).run() for t in things]
    finally:
        for s in shared:
            s.df.unpersist()


def checked(bag: Bag, check: Callable[[DataFrame], None]) -> Bag:
    """A check that runs before the sink that was added last writes; ``lambda df: None`` in the place of a sink's own check of what is there, see ``unchecked``."""
    return bag.update_sinks(lambda s: (*s[:-1], _Checked(s[-1], check)))


def unchecked(bag: Bag) -> Bag:
    """The sink that was added last writes without looking whether its path is there already: files are added to it."""
    return bag.update_sinks(lambda s: (*s[:-1], replace(s[-1], check=False)))


@dataclass(frozen=True)
class _Checked:
    sink: Callable[[DataFrame], None]
    check: Callable[[DataFrame], None]

    def __call__(self, df: DataFrame) -> None:
        self.check(df)
        self.sink(df)


def kept(bag: Bag, expiry: Expiry | None = None) -> Bag:
    """Makes the sink that was added last a checkpoint: an output that is complete and not expired is left as it is, another one is written anew."""
    return bag.update_sinks(lambda s: (*s[:-1], _Kept(s[-1], expiry or Expiry())))


@dataclass(frozen=True)
class _Kept:
    sink: Any
    expiry: Expiry

    def __call__(self, df: DataFrame) -> None:
        if not valid(df.sparkSession, self.sink.path, self.expiry):
            self.sink(df)


def downloaded(spark: SparkSession, path: str, wanted: Callable[[str], bool], target: str) -> list[str]:
    """Files that tasks wrote below path, of those whose name is wanted, copied to a folder of this machine."""
    os.makedirs(target, exist_ok=True)
    out = []
    for f in Files(spark, path).data_files():
        name = f.rpartition("/")[2]
        if wanted(name):
            Files(spark, f).copy_to_local(os.path.join(target, name))
            out.append(os.path.join(target, name))
    return out


def delete_old(spark: SparkSession, path: str) -> None:
    Files(spark, path).delete()


def keep_numbered(spark: SparkSession, path: str) -> None:
    """The old result becomes path-1, or the next free number."""
    k = 1
    while Files(spark, f"{path}-{k}").exists():
        k += 1
    Files(spark, path).rename(f"{path}-{k}")


def keep_last(n: int) -> Callable[[SparkSession, str], None]:
    """As keep_numbered, but only the last n old results stay."""

    def archive(spark: SparkSession, path: str) -> None:
        keep_numbered(spark, path)
        k = 1
        while Files(spark, f"{path}-{k}").exists():
            k += 1
        kept = k - 1
        for drop in range(1, kept - n + 1):
            Files(spark, f"{path}-{drop}").delete()
        for old in range(max(1, kept - n + 1), kept + 1):
            if kept > n:
                Files(spark, f"{path}-{old}").rename(f"{path}-{old - (kept - n)}")

    return archive


@dataclass(frozen=True)
class Expiry:
    """After how many seconds a kept result is no longer used (None: never), and what becomes of it."""

    seconds: float | None = None
    archive: Callable[[SparkSession, str], None] = delete_old


def valid(spark: SparkSession, path: str, expiry: Expiry) -> bool:
    """Whether the output at path is complete (its success mark is there) and not expired. One that isn't is taken away: archived if it is complete, else deleted."""
    files = Files(spark, path)
    if not files.exists():
        return False
    mark = Files(spark, files.child("_SUCCESS"))
    whole = mark.exists()
    if whole and (expiry.seconds is None or time.time() * 1000 - mark.modified_ms() <= expiry.seconds * 1000):
        return True
    (expiry.archive if whole else delete_old)(spark, path)
    return False


def checkpointed(spark: SparkSession, path: str, make: Callable[[], DataFrame | Bag], expiry: Expiry = Expiry()) -> Bag:  # noqa: B008
    """The result kept at path if it is complete (its success mark is there) and not expired; otherwise it is made, kept and read from there.

    Unlike ``DataFrame.checkpoint`` it is there for the next application too. A result that was left half written is made anew.
    """
    if valid(spark, path, expiry):
        return Bag(spark.read.parquet(path))
    made = make()
    (made.df if isinstance(made, Bag) else made).write.parquet(path)
    return Bag(spark.read.parquet(path))
