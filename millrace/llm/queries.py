"""Queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.leakage import leaks
from millrace.llm.mixing import mix, tidy
from millrace.llm.quantiles import merge, percentiles, summarise
from millrace.llm.splitting import split_items
from millrace.llm.tokens import with_token_counts
from millrace.llm.topn import top_n
from millrace.session import cut


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- problem 1


def best_movies(spark: SparkSession, folder: str) -> DataFrame:
    ratings = table(spark, folder, "ratings").select("user", "movie", "rating").dropna()
    return top_n(ratings, "user", "movie", "rating", 5)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The five best movies of each user."""
    return best_movies(spark, folder).select("user", "movie")


def p1_top(spark: SparkSession, folder: str) -> DataFrame:
    """The same with rating and position."""
    return best_movies(spark, folder)


# --- problem 4

PERCENTS = {"p01": "0.01", "p05": "0.05", "p50": "0.5", "p95": "0.95", "p99": "0.99"}


def p4_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Median and outer percentiles of temp per station, read from the merged summaries of single days; the operator states its error bound, which is 0 as nothing is rounded.

    A reading (station, time, temp) that is delivered again counts once. Days are those of the reading's time; readings without a time are a part of their own.
    """
    readings = table(spark, folder, "weather").where("station is not null and temp is not null").select("station", "time", "temp").distinct()
    daily = summarise(readings.withColumn("day", F.floor(F.col("time") / 86400)), ["station", "day"], "temp")
    return percentiles(merge(daily, keys=["station"]), "station", PERCENTS)


# --- problem 7


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Notebooks and the test items that leaked into them, with the share of the item and whether its numbers, names or units were changed."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), "doc_id", "text", "item_id", "text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Notebooks and items of whose words at least a third stand there in order."""
    return p7_leaks(spark, folder).where("kind = 'same'").select("doc_id", "item_id")


def p7_verbatim(spark: SparkSession, folder: str) -> DataFrame:
    """Of the pairs found, those whose whole passage stands in the notebook letter for letter."""
    pairs = p7_leaks(spark, folder).where("kind = 'same' and share = 1").select("doc_id", "item_id")
    items = table(spark, folder, "eval_items").select("item_id", F.substring_index("text", "\n", 1).alias("head"), F.col("text").alias("whole"))
    both = pairs.join(items, "item_id").join(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return both.where(F.contains("text", F.substring("whole", F.length("head") + 2, F.length("whole")))).select("doc_id", "item_id")


# --- problem 8


def _mix(spark: SparkSession, folder: str, epochs: float | None = None) -> tuple[DataFrame, DataFrame]:
    """epochs: None for the largest mix that reaches every share, else the mix's size in multiples of the targeted sources' tokens."""
    docs = table(spark, folder, "documents").select("doc_id", tidy(F.col("source")).alias("source"), tidy(F.col("lang")).alias("lang"), "text")
    targets = table(spark, folder, "source_targets")
    sized = cut(with_token_counts(docs, "text", ["doc_id", "source", "lang"]))
    return mix(sized, targets, "doc_id", "source", "lang", "n_tokens", epochs=epochs)


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How often each notebook is used in the largest mix in which every source that has notebooks reaches its share."""
    return _mix(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares reached by that mix."""
    return _mix(spark, folder)[1]


def p8_shares_epoch(spark: SparkSession, folder: str) -> DataFrame:
    """The shares reached by a mix as large as the sources themselves: short sources are used max_repeats times and the others make up for them."""
    return _mix(spark, folder, epochs=1.0)[1]


def p8_tree(spark: SparkSession, folder: str) -> DataFrame:
    """A mix as large as the sources in which a source's languages weigh the same, kernels below them what they hold: rare languages run short and their siblings make up for them."""
    docs = table(spark, folder, "documents").select("doc_id", tidy(F.col("source")).alias("source"), F.struct(tidy(F.col("lang")).alias("lang"), "kernel").alias("leaf"), "text")
    sized = cut(with_token_counts(docs, "text", ["doc_id", "source", "leaf"]))
    uses = mix(sized, table(spark, folder, "source_targets"), "doc_id", "source", "leaf", "n_tokens", epochs=1.0, weigh=lambda path, held: 1.0 if len(path) == 2 else held)[0]
    return uses.groupBy("source", F.col("leaf.lang").alias("lang")).agg(F.sum(F.col("n_tokens") * F.col("times")).alias("mixed_tokens"), F.max("times").alias("most_times"))


def p8_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Records of every source, how many are used too often, and whether the mix comes within one of its records of its budget."""
    uses, report = _mix(spark, folder)
    held = uses.groupBy("source").agg(F.max("n_tokens").alias("largest"), F.max("times").alias("times"))
    near = F.abs(F.col("mixed_tokens") - F.col("budget_tokens")) <= F.coalesce("largest", F.lit(0))
    return report.join(held, "source", "left").select("source", "target_share", "max_repeats", "n_records", F.coalesce(F.greatest(F.col("times") - F.col("max_repeats"), F.lit(0)), F.lit(0)).alias("beyond"), near.alias("near"))


# --- problem 9

LIMIT, OVERLAP = 4096, 128


def _pieces(spark: SparkSession, folder: str, carry_text: bool) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", F.col("cells.start_at").alias("starts"))
    return split_items(docs, "doc_id", "text", "starts", LIMIT, OVERLAP, carry_text=carry_text)


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every notebook of more than 4,096 tokens."""
    return _pieces(spark, folder, True)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Notebooks that had to be split."""
    return _pieces(spark, folder, False).where("piece = 0").select("doc_id")


def p9_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """A digest of every notebook, of those that were split from what their pieces hold beside the overlap: nothing is lost."""
    docs = table(spark, folder, "documents").where("text is not null").select("doc_id", "text")
    before = F.lag("end_at").over(Window.partitionBy("doc_id").orderBy("piece"))  # a window of one notebook's pieces
    own = p9_pieces(spark, folder).withColumn("skip", F.greatest(F.coalesce(before, F.lit(0)) - F.col("start_at"), F.lit(0)).cast("int"))
    part = F.struct("piece", F.substring("text", F.col("skip") + 1, F.length("text")).alias("part"))
    whole = own.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["part"]), "").alias("rebuilt"))
    return docs.join(whole, "doc_id", "left").select("doc_id", F.md5(F.coalesce("rebuilt", "text")).alias("digest"))


def p9_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces beyond the limit, out of order, empty, or whose overlap with the piece before is off by more than what tokens at a cut can be."""
    w = Window.partitionBy("doc_id").orderBy("piece")
    pieces = p9_pieces(spark, folder).withColumns({"before": F.lag("end_at").over(w), "last": F.lag("piece").over(w)})
    shared = F.when(F.col("before").isNotNull(), F.substring("text", F.lit(1), (F.col("before") - F.col("start_at")).cast("int")))
    sized = with_token_counts(with_token_counts(pieces.withColumn("shared", shared), "text", ["doc_id", "piece", "start_at", "end_at", "n_tokens", "before", "last", "shared"], "again"), "shared", ["piece", "start_at", "end_at", "n_tokens", "again", "before", "last"], "overlap")
    count = lambda c: F.count_if(c)
    return sized.agg(
        count((F.col("again") > LIMIT) | (F.col("again") != F.col("n_tokens"))).alias("beyond"), count((F.coalesce("last", F.lit(-1)) != F.col("piece") - 1) | (F.col("end_at") <= F.coalesce("before", F.lit(0)))).alias("disorder"),
        count(F.col("before").isNotNull() & ~F.col("overlap").between(OVERLAP - 2, OVERLAP + 8)).alias("off_overlap"),
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_top, p4_percentiles, p7_found, p7_leaks, p7_verbatim, p8_mix, p8_counts, p8_shares, p8_shares_epoch, p8_tree, p9_found, p9_pieces, p9_rebuilt, p9_rules)}

_BEST = """with best as (select "user", movie, max(rating) as rating from ratings where "user" is not null and movie is not null and rating is not null group by 1, 2),
    placed as (select *, cast(row_number() over (partition by "user" order by rating desc, movie) as integer) as position from best)"""

_SOURCES = """(select case when s not in ('', 'und') then s end as source from (select regexp_replace(lower(trim(source)), '-x$', '') as s from documents where text <> ''))"""

SQL = {
    "p7_verbatim": "select doc_id, item_id from documents d, eval_items e where contains(d.text, case when contains(e.text, chr(10)) then substr(e.text, instr(e.text, chr(10)) + 1) else e.text end)",
    "p8_counts": f"select t.source, target_share, max_repeats, (select count(*) from {_SOURCES} d where d.source = t.source) as n_records, 0 as beyond, true as near from source_targets t",
    "p9_rebuilt": "select doc_id, md5(text) as digest from documents where text is not null",
    "p9_rules": "select 0 as beyond, 0 as disorder, 0 as off_overlap",
    "p1_found": f'{_BEST} select "user", movie from placed where position <= 5',
    "p1_top": f'{_BEST} select "user", movie, rating, position from placed where position <= 5',
    "p4_percentiles": """with r as (select distinct station, time, temp from weather where station is not null and temp is not null),
        o as (select station, temp, row_number() over (partition by station order by temp) as rn, count(*) over (partition by station) as n from r)
        select station, any_value(n) as n, """
    + ", ".join(f"min(case when rn >= greatest(1, (n * {k} + 99) // 100) then temp end) as p{k:02d}" for k in (1, 5, 50, 95, 99))
    + ", cast(0 as double) as error_bound from o group by station",
}
