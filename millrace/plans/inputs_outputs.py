"""Queries of sources and sinks over the driver's tables, and their SQL. Each writes below a folder of its own and takes it away when its result is read."""

from __future__ import annotations

import contextlib
import io
import time
from collections.abc import Callable, Iterable
from urllib.parse import urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import a_double, a_float, a_long, an_int
from millrace.operators import reductions as red
from millrace.operators.bag import Bag, Counters, DoFn
from millrace.plans.app import App, cat, ls
from millrace.plans.collections import bag, keyed, kept_from, registry, scratch
from millrace.plans.pipeline import table
from millrace.sources import persisting, records, sequence, text
from millrace.sources.files import Files

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registry(QUERIES, SQL)

LONG, STRING = T.LongType(), T.StringType()


def outcome(f: Callable) -> str:
    """``raised`` or ``went on``."""
    try:
        f()
    except Exception:
        return "raised"
    return "went on"


@query("select 'region=' || n_regionkey as folder, n_name as line from nation")
def text_lines_with_path(spark, folder):
    """Every line with the folder of its file."""
    out = scratch(spark)
    persisting.persist(text.to_partitioned_text(bag(spark, folder, "nation", "n_name", "n_regionkey").map("n_name", F.col("n_regionkey").alias("region")), out, ["region"]))
    lines = text.from_text_with_path(spark, f"{out}/region=*")
    return kept_from(lines.map(F.element_at(F.split("key", "/"), -2).alias("folder"), F.col("value").alias("line")).df, out)


@query("select l_orderkey, l_linenumber, l_extendedprice, round(cast(cast(l_discount as float) as double), 6) as discount from lineitem where l_linenumber % 2 = 1")
def delimited_numbers(spark, folder):
    """Lines with fields of all kinds of numbers; where one of them is none, the line is dropped."""
    out = scratch(spark)
    number = F.when(F.col("l_linenumber") % 2 == 1, F.col("l_linenumber").cast("string")).otherwise(F.concat(F.col("l_linenumber").cast("string"), F.lit(".5")))
    lines = bag(spark, folder, "lineitem").map("l_orderkey", number.alias("n"), "l_extendedprice", "l_discount")
    persisting.persist(text.to_delimited(lines, out))
    got = text.from_delimited(spark, {"l_orderkey": (0, a_long), "l_linenumber": (1, an_int), "l_extendedprice": (2, a_double), "discount": (3, a_float)}, out)
    return kept_from(got.map("l_orderkey", "l_linenumber", "l_extendedprice", F.round(F.col("discount").cast("double"), 6).alias("discount")).df, out)


@query("select min(r_name) as line, min_by(r_regionkey, r_name) as k, min(r_name) as globbed from region")
def text_objects(spark, folder):
    """First lines of files as single values, by a path and by a pattern."""
    out = scratch(spark)
    first = Bag(table(spark, folder, "region").select("r_name", "r_regionkey").coalesce(1).sortWithinPartitions("r_name"))
    persisting.persist(text.to_text(first.map("r_name"), f"{out}/a"), text.to_delimited(first, f"{out}/b"))
    row = (text.text_object(spark, f"{out}/a").run(), text.delimited_object(spark, {"name": (0, lambda c: c), "k": (1, an_int)}, f"{out}/b").run()[1], text.text_object(spark, f"{out}/a*").run())
    return kept_from(spark.createDataFrame([row], "line string, k int, globbed string"), out)


@query("select 'raised' as checked, 0 as unchecked, 'raised' as over, 2 * count(*) as appended, count(*) as replaced, true as gzip, false as other from region")
def input_and_output_checks(spark, folder):
    out = scratch(spark)
    names = bag(spark, folder, "region", "r_name")
    sink = text.to_text(names, f"{out}/t")
    persisting.persist(sink)
    over = outcome(lambda: persisting.persist(sink))
    persisting.persist(persisting.unchecked(sink))
    appended = text.from_text(spark, f"{out}/t").length().run()
    persisting.persist(text.to_text(names, f"{out}/t", overwrite=True))
    row = (outcome(lambda: text.from_text(spark, f"{out}/none")), text.from_text(spark, f"{out}/none", check=False).length().run(), over, appended, text.from_text(spark, f"{out}/t").length().run(), text.codec_available(spark, "gzip"), text.codec_available(spark, "no.such.Codec"))
    return kept_from(spark.createDataFrame([row], "checked string, unchecked int, over string, appended bigint, replaced bigint, gzip boolean, other boolean"), out)


@query("""select s_suppkey as k, s_name as v, 'both' as part from supplier union all select s_suppkey, '', 'keys' from supplier union all select 0, s_name, 'values' from supplier
    union all select s_suppkey, s_name, 'paths' from supplier union all select s_suppkey * 2, s_name, 'converted' from supplier where s_suppkey % 2 = 0""")
def sequence_parts(spark, folder):
    """Sequence files of keys and values, keys only, values only, with the paths of their files, and brought to elements by a function."""
    out = scratch(spark)
    rows = keyed(spark, folder, "supplier", "s_suppkey", "s_name")
    persisting.persist(sequence.to_sequence(rows, f"{out}/a"), sequence.keys_to_sequence(rows, f"{out}/k"), persisting.kept(sequence.values_to_sequence(rows, f"{out}/v")))
    nothing, tag = T.NullType(), lambda b, part: b.map(F.col("key").alias("k"), F.col("value").alias("v"), F.lit(part).alias("part"))
    located = sequence.from_sequence(spark, LONG, STRING, f"{out}/a", with_path=True).filter(F.col("path").contains("/a/part-"))
    parts = [
        tag(sequence.from_sequence(spark, LONG, STRING, f"{out}/a"), "both"), tag(sequence.keys_from_sequence(spark, LONG, nothing, f"{out}/k").map("key", F.lit("").alias("value")), "keys"), tag(sequence.values_from_sequence(spark, nothing, STRING, f"{out}/v").map(F.lit(0).cast("bigint").alias("key"), "value"), "values"),
        tag(located, "paths"), tag(sequence.convert_sequence(spark, lambda k, v: (k * 2, v) if k % 2 == 0 else None, "key bigint, value string", f"{out}/a"), "converted"),
    ]
    return kept_from(Bag.concat(parts).df, out)


@query("select min(s_suppkey) as k, min(s_suppkey) as k_only, min_by(s_name, s_suppkey) as v, 'raised' as mismatch, 'raised' as again from supplier")
def sequence_objects(spark, folder):
    out = scratch(spark)
    rows = Bag(table(spark, folder, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value")).coalesce(1).sortWithinPartitions("key"))
    sink = sequence.to_sequence(rows, out)
    persisting.persist(sink)
    row = (sequence.sequence_object(spark, LONG, STRING, out).run()[0], sequence.sequence_key_object(spark, LONG, STRING, out).run(), sequence.sequence_value_object(spark, LONG, STRING, out).run(), outcome(sequence.from_sequence(spark, STRING, STRING, out).run), outcome(lambda: persisting.persist(sink)))
    return kept_from(spark.createDataFrame([row], "k bigint, k_only bigint, v string, mismatch string, again string"), out)


@query("select n_regionkey as region, n_nationkey as k, n_name as v from nation")
def sequence_partitions(spark, folder):
    """A folder of keys and values for each region."""
    out = scratch(spark)
    rows = bag(spark, folder, "nation", "n_regionkey", "n_nationkey", "n_name", key="n_nationkey", value="n_name")
    persisting.persist(sequence.to_partitioned_sequence(rows, out, "n_regionkey"))
    got = sequence.from_sequence(spark, T.IntegerType(), STRING, f"{out}/*", with_path=True)
    return kept_from(got.map(F.element_at(F.split("path", "/"), -2).cast("int").alias("region"), F.col("key").alias("k"), F.col("value").alias("v")).df, out)


@query("select s_suppkey as k, s_name as name, s_nationkey as nation from supplier")
def payloads_in_sequences(spark, folder):
    """Structs as bytes in a sequence file, by an encoder and a decoder."""
    out = scratch(spark)
    rows = Bag(table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey"))
    packed = records.encoded(rows, ["s_suppkey", "s_name", "s_nationkey"], lambda t: f"{t[0]}|{t[1]}|{t[2]}".encode())
    persisting.persist(sequence.to_sequence(packed.map(F.lit(0).cast("bigint").alias("key"), F.col("payload").alias("value")), out))
    schema = T.StructType([T.StructField("k", LONG), T.StructField("name", STRING), T.StructField("nation", T.IntegerType())])

    def decode(b: bytes) -> tuple:
        k, name, nation = b.decode().split("|")
        return int(k), name, int(nation)

    got = records.decoded(sequence.from_sequence(spark, LONG, T.BinaryType(), out).map("value"), "value", decode, schema)
    return kept_from(got.map("record.k", "record.name", "record.nation").df, out)


class Seen(DoFn):
    def process(self, env, row) -> Iterable:
        self.context.count("rows", "seen")
        yield (row["o_orderkey"],)


@query("select count(*) as seen, count(*) filter (where o_orderkey % 2 = 0) as even, count(*) filter (where o_orderkey % 2 <> 0) as odd, count(*) as total from orders")
def joint_execution(spark, folder):
    """Two written lists and a value that come from one list, which runs once for all three."""
    out, counters = scratch(spark), Counters(spark)
    seen = bag(spark, folder, "orders", "o_orderkey").parallel_do(Seen(), "value bigint", counters=counters)
    even, odd = text.to_text(seen.filter("value % 2 = 0"), f"{out}/even"), text.to_text(seen.filter("value % 2 <> 0"), f"{out}/odd")
    (total,) = persisting.persist(even, odd, seen.length())
    row = (counters.value("rows", "seen"), text.from_text(spark, f"{out}/even").length().run(), text.from_text(spark, f"{out}/odd").length().run(), total)
    return kept_from(spark.createDataFrame([row], "seen bigint, even bigint, odd bigint, total bigint"), out)


@query("select count(*) as kept, 0 as remade, 1 as archived, 'raised' as checked, 2 as sinks, count(*) as downloaded from region")
def checkpoints_on_sinks(spark, folder):
    """A sink that is a checkpoint leaves a complete output alone until it expires, and then archives it; checks run before a sink; files come to this machine."""
    out = scratch(spark)
    names = bag(spark, folder, "region", "r_name")
    sink = lambda b, expiry=None: persisting.kept(text.to_text(b, f"{out}/t"), expiry)
    persisting.persist(sink(names))
    persisting.persist(sink(names.filter("false")))
    kept = text.from_text(spark, f"{out}/t").length().run()
    time.sleep(0.05)
    persisting.persist(sink(names.filter("false"), persisting.Expiry(0.01, persisting.keep_numbered)))

    def refuse(df: DataFrame) -> None:
        raise ValueError("refused")

    two = text.to_text(text.to_text(names, f"{out}/a"), f"{out}/b").update_sinks(lambda s: tuple(reversed(s)))
    persisting.persist(two)
    lines = 0
    for f in persisting.downloaded(spark, f"{out}/a", lambda name: name.startswith("part-"), f"{urlparse(out).path}/here"):
        with open(f) as g:
            lines += len(g.readlines())
    row = (kept, text.from_text(spark, f"{out}/t").length().run(), int(Files(spark, f"{out}/t-1").exists()), outcome(lambda: persisting.persist(persisting.checked(text.to_text(names, f"{out}/c"), refuse))), sum(Files(spark, f"{out}/{x}").exists() for x in "ab"), lines)
    return kept_from(spark.createDataFrame([row], "kept bigint, remade int, archived int, checked string, sinks int, downloaded bigint"), out)


@query("select count(*) as n, 'rows ' || count(*) as said, true as planned, true as timed, true as there, string_agg(r_name, ',' order by r_name) as lines from region")
def program_with_options(spark, folder):
    """A program that runs, one that only shows its plan, and the helpers of an interactive session."""
    out = scratch(spark)

    class Count(App):
        def session(self, o):
            return spark

        def run(self, session, args) -> None:
            self.show(table(session, args[0], "region"), lambda d: print("rows", d.count()))

    def said(*argv: str) -> str:
        with contextlib.redirect_stdout(io.StringIO()) as told:
            Count().main([folder, *argv])
        return told.getvalue()

    plain, planned = said("--times"), said("--plan-only")
    persisting.persist(text.to_text(bag(spark, folder, "region", "r_name"), f"{out}/r"))
    row = (table(spark, folder, "region").count(), plain.split("\n")[0], "Physical Plan" in planned and "rows " not in planned, plain.strip().endswith("s"), len(ls(spark, f"{out}/*")) == 1, ",".join(sorted(cat(spark, f"{out}/r"))))
    return kept_from(spark.createDataFrame([row], "n bigint, said string, planned boolean, timed boolean, there boolean, lines string"), out)


@query("select word, count(*) as n from (select unnest(string_split(text, ' ')) as word from documents) where length(word) between 1 and 5 group by 1")
def short_words(spark, folder):
    """Counts of short words, written and read again compressed."""
    out = scratch(spark)
    words = bag(spark, folder, "documents").map_flatten(F.split("text", " "), "word").filter("length(word) between 1 and 5").map(F.col("word").alias("key"), F.lit(1).alias("value"))
    persisting.persist(sequence_compressed(words.group_by_key().combine(red.SUM), out))
    return kept_from(sequence.from_sequence(spark, STRING, LONG, out).df.toDF("word", "n"), out)


def sequence_compressed(rows: Bag, out: str) -> Bag:
    return sequence.to_sequence(rows, out).update_sinks(lambda s: (*s[:-1], s[-1].compressed()))


@query("select station, time, temp, loaded_at from weather")
def avro_roundtrip(spark, folder):
    out = scratch(spark)
    persisting.persist(records.to_avro(bag(spark, folder, "weather").map("station", "time", "temp", F.col("loaded_at").cast("timestamp").alias("loaded_at")), out))
    return kept_from(records.from_avro(spark, out).map("station", "time", "temp", F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at")).df, out)


_HEAT = """{"type": "record", "name": "Heat", "fields": [{"name": "station", "type": ["string", "null"]}, {"name": "temp", "type": ["long", "null"]}, {"name": "unit", "type": "string", "default": "dC"}]}"""


@query("select station, max(temp) as warmest, count(*) as readings, 'dC' as unit, 'raised' as mismatch from weather where station is not null group by 1")
def avro_warmest(spark, folder):
    """A program on Avro files: written, read with a schema of fewer fields, wider numbers and a default, reduced, written and read again."""
    first, second = scratch(spark), scratch(spark)
    persisting.persist(records.to_avro(bag(spark, folder, "weather", "time", "temp", "station"), first))
    heat = records.from_avro(spark, first, schema=_HEAT).filter("station is not null")
    mismatch = outcome(lambda: records.from_avro(spark, first, schema=_HEAT.replace('"long"', '"boolean"')))
    out = Bag(heat.df, key="station").group_by_key().agg(red.MAXIMUM.of("temp").alias("warmest"), F.count(F.lit(1)).alias("readings"), F.min("unit").alias("unit"))
    persisting.persist(persisting.kept(records.to_avro(out.map("station", "warmest", "readings", "unit", F.lit(mismatch).alias("mismatch")), second)))
    got = kept_from(records.from_avro(spark, f"{second}/part-*").df, second)
    Files(spark, first).delete()
    return got


@query("select count(*) as n, min(n_name) as first, 1 as listed from nation")
def avro_objects(spark, folder):
    out = scratch(spark)
    rows = Bag(table(spark, folder, "nation").select("n_name", "n_nationkey", "n_regionkey").coalesce(1).sortWithinPartitions("n_name"))
    persisting.persist(records.to_avro(rows, out, compression="null"))
    row = (records.from_avro(spark, out).length().run(), records.avro_object(spark, f"{out}/*.avro").run()[0], len(records.avro_cat(spark, out, 1)))
    return kept_from(spark.createDataFrame([row], "n bigint, first string, listed int"), out)
