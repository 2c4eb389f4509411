"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the session comes from spark-submit."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("millrace")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset and the master is local."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"millrace-checkpoints-{os.getuid()}")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and goes on from there.

    Used where later steps must see exactly the same rows in the same partitions (positions after a
    sampled range partitioning) and where a loop would pile up lineage. Survives the loss of executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Plan nodes whose rows come in the same order in the same partitions whenever a task runs.
_STEADY = {"LogicalRelation", "LogicalRDD", "LocalRelation", "Range", "Project", "Filter", "Union", "SubqueryAlias", "View", "DataSourceV2Relation", "DataSourceV2ScanRelation", "OneRowRelation", "Generate"}


def steady(df: DataFrame) -> DataFrame:
    """df if a task that is run again sees its rows in the same places (files, checkpoints, and row-wise steps on them), else its checkpoint.

    Asked for where rows are dealt out by a hash of their place: after a shuffle, rows come in the order in which they are fetched, so an executor that is lost could deal some of them twice or not at all.
    """

    def all_steady(plan) -> bool:
        children = plan.children()
        return plan.nodeName() in _STEADY and all(all_steady(children.apply(k)) for k in range(children.size()))

    return df if all_steady(df._jdf.queryExecution().analyzed()) else cut(df)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows up to which a counted table may be broadcast (times the width of a few short columns).
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most ``rows`` rows, else df unchanged (a shuffle join follows).

    Give it a checkpointed or otherwise cheap frame: the count is an action, and stops at ``rows`` + 1.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
