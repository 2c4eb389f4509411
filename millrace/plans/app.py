"""Programs: a main function with options, a session to suit, and an interactive helper or two."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.files import Files
from millrace.sources.records import avro_cat

#: What sizes shuffles: reducers by bytes (adaptive execution merges small partitions up to this), and the bounds of their number.
BYTES_PER_REDUCER = 1 << 30


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(add_help=False)
    p.add_argument("--master", help="local[*] for this machine; left out, what spark-submit says")
    p.add_argument("--local", action="store_true", help="all cores of this machine")
    p.add_argument("--inmemory", action="store_true", help="one core of this machine, for small lists and tests")
    p.add_argument("--cluster", action="store_true", help="what spark-submit says; the default")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--quiet", action="store_true", help="no word from the engine, not even errors")
    p.add_argument("--keep-files", action="store_true", help="leave checkpoints where they are when the program ends")
    p.add_argument("--times", action="store_true", help="print the seconds taken")
    p.add_argument("--plan-only", action="store_true", help="print plans instead of running them")
    p.add_argument("--bytes-per-reducer", type=int, default=BYTES_PER_REDUCER)
    p.add_argument("--max-reducers", type=int)
    p.add_argument("--min-reducers", type=int)
    return p


class App:
    """Subclass it and write ``run``; ``main(argv)`` parses options, makes the session and passes on the other arguments."""

    def run(self, spark: SparkSession, args: list[str]) -> None:
        raise NotImplementedError

    def session(self, o: argparse.Namespace) -> SparkSession:
        b = SparkSession.builder.appName(type(self).__name__).config("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(o.bytes_per_reducer))
        master = o.master or ("local[1]" if o.inmemory else "local[*]" if o.local else None)
        if master and not o.cluster:
            b = b.master(master)
        b = b.config("spark.cleaner.referenceTracking.cleanCheckpoints", str(not o.keep_files).lower())
        if o.max_reducers:
            b = b.config("spark.sql.shuffle.partitions", str(o.max_reducers))
        if o.min_reducers:
            b = b.config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false").config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(o.min_reducers, o.max_reducers or 0)))
        return b.getOrCreate()

    def main(self, argv: list[str] | None = None) -> None:
        import time

        o, rest = options().parse_known_args(sys.argv[1:] if argv is None else argv)
        self.options = o
        spark = self.session(o)
        spark.sparkContext.setLogLevel("INFO" if o.verbose else "OFF" if o.quiet else "ERROR")
        began = time.time()
        self.run(spark, rest)
        if o.times:
            print(f"{time.time() - began:.1f} s")

    def show(self, df: DataFrame, act: Callable[[DataFrame], None] = DataFrame.show) -> None:
        """Runs an action on the frame, or prints its plan where only plans are wanted."""
        if self.options.plan_only:
            df.explain("formatted")
        else:
            act(df)


def ls(spark: SparkSession, glob: str) -> list[str]:
    return Files(spark, glob).matches()


def cat(spark: SparkSession, path: str, lines: int = 20) -> list[str]:
    """The first lines of text files."""
    return [r.value for r in spark.read.text(path).limit(lines).collect()]


def avrocat(spark: SparkSession, path: str, lines: int = 20) -> list[str]:
    """The first records of Avro files, as JSON."""
    return avro_cat(spark, path, lines)
