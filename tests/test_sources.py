import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import a_double, a_long, an_int
from millrace.operators.bag import Bag
from millrace.plans.app import App, cat, ls
from millrace.sources import persisting, records, sequence, text


def ints(spark, *xs):
    return Bag.of(spark, xs, "value int")


def test_text_overwrite_and_compression(spark, tmp_path):
    out = str(tmp_path / "t")
    persisting.persist(text.to_text(ints(spark, 1, 2, 3), out))
    with pytest.raises(Exception, match="exist"):
        persisting.persist(text.to_text(ints(spark, 4), out))
    persisting.persist(text.compressed(text.to_text(ints(spark, 4, 5), out, overwrite=True)))
    assert any(f.endswith(".gz") for f in os.listdir(out))
    assert text.codec_available(spark, "gzip") and not text.codec_available(spark, "no.such.Codec")
    assert sorted(text.from_text(spark, out).run()) == ["4", "5"]
    assert text.text_object(spark, out).run() in ("4", "5")
    assert sorted(cat(spark, out)) == ["4", "5"] and len(ls(spark, str(tmp_path / "*"))) == 1


def test_two_sinks_and_globs(spark, tmp_path):
    a, b = str(tmp_path / "a1"), str(tmp_path / "a2")
    persisting.persist(text.to_text(text.to_text(ints(spark, 1), a), b))
    assert text.from_text(spark, str(tmp_path / "a*")).run() == ["1", "1"]
    paths = {k for k, _ in text.from_text_with_path(spark, a, b).run()}
    assert len(paths) == 2


def test_missing_input(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        text.from_text(spark, str(tmp_path / "none"))
    assert text.from_text(spark, str(tmp_path / "none"), check=False).run() == []
    assert sequence.from_sequence(spark, T.LongType(), T.StringType(), str(tmp_path / "none"), check=False).run() == []


def test_delimited(spark, tmp_path):
    path = tmp_path / "in.txt"
    path.write_text("100,Ben,Lever,31\n101,Tom,Smith,old\n102,Rami\n,x,y,4\n103,Ann,Lee,40,,,\n")
    got = text.from_delimited(spark, {"id": (0, a_long), "first": (1, lambda c: c), "age": (3, an_int)}, str(path), separator=",")
    assert sorted(got.run()) == [(100, "Ben", 31), (103, "Ann", 40)]
    assert text.delimited_object(spark, {"id": (0, a_long), "age": (3, an_int)}, str(path), ",").run() == (100, 31)
    rows = Bag.of(spark, [(1, (2, ["a", "b"]), None)], "k int, v struct<n:int,l:array<string>>, z string")
    persisting.persist(text.to_delimited(rows, str(tmp_path / "out"), ";"))
    assert text.from_text(spark, str(tmp_path / "out")).run() == ["1;2;a;b;"]


def test_extractors(spark):
    got = spark.createDataFrame([(x,) for x in ["12", "-3", " 1", "1.5", "x", "", None, "99999999999", "1e3", "2d"]], "s string").select(an_int(F.col("s")).alias("i"), a_long(F.col("s")).alias("l"), a_double(F.col("s")).alias("d")).collect()
    assert [r.i for r in got] == [12, -3, None, None, None, None, None, None, None, None]
    assert got[7].l == 99999999999
    assert [r.d for r in got] == [12.0, -3.0, 1.0, 1.5, None, None, None, 99999999999.0, 1000.0, 2.0]


def test_partitioned_text(spark, tmp_path):
    out = str(tmp_path / "p")
    rows = Bag.of(spark, [("2014-01-22", "a"), ("2014-01-22", "b"), ("2014-01-23", "c"), ("2014-01-23", "d")], "day string, v string")
    persisting.persist(text.to_partitioned_text(rows, out, ["day"]))
    assert sorted(d for d in os.listdir(out) if d.startswith("day=")) == ["day=2014-01-22", "day=2014-01-23"]
    assert sorted(tuple(r) for r in spark.read.text(out).select("value", F.col("day").cast("string")).collect()) == [("a", "2014-01-22"), ("b", "2014-01-22"), ("c", "2014-01-23"), ("d", "2014-01-23")]


def test_sequences(spark, tmp_path):
    rows = Bag.of(spark, [(1, "x"), (2, "y")], "key bigint, value string")
    a, b, c, p = (str(tmp_path / x) for x in "abcp")
    persisting.persist(sequence.to_sequence(rows, a), sequence.keys_to_sequence(rows, b), sequence.values_to_sequence(rows, c))
    long, string = T.LongType(), T.StringType()
    assert sorted(sequence.from_sequence(spark, long, string, a).run()) == [(1, "x"), (2, "y")]
    assert sorted(sequence.keys_from_sequence(spark, long, T.NullType(), b).run()) == [1, 2]
    assert sorted(sequence.values_from_sequence(spark, T.NullType(), string, c).run()) == ["x", "y"]
    assert {r[1:] for r in sequence.from_sequence(spark, long, string, a, with_path=True).run()} == {(1, "x"), (2, "y")}
    assert sequence.sequence_object(spark, long, string, a).run() in ((1, "x"), (2, "y"))
    assert sequence.sequence_key_object(spark, long, string, a).run() in (1, 2) and sequence.sequence_value_object(spark, long, string, a).run() in ("x", "y")
    with pytest.raises(FileExistsError):
        persisting.persist(sequence.to_sequence(rows, a))
    with pytest.raises(Exception, match="expected"):
        sequence.from_sequence(spark, string, string, a).run()
    dated = Bag.of(spark, [("d1", 1, "x"), ("d2", 2, "y"), ("d2", 3, "z")], "day string, key bigint, value string")
    persisting.persist(sequence.to_partitioned_sequence(dated, p, "day"))
    assert sorted(sequence.from_sequence(spark, long, string, f"{p}/d2").run()) == [(2, "y"), (3, "z")]


def test_avro_with_or_without_the_module(spark, tmp_path):
    rows, out = Bag.of(spark, [("s", 5, 12)], "station string, time long, temp int"), str(tmp_path / "avro")
    persisting.persist(records.to_avro(rows, out))
    assert records.from_avro(spark, out).run() == [("s", 5, 12)]


def test_payloads(spark):
    rows = Bag.of(spark, [(1, "entity"), (2, None)], "id int, entity string")
    packed = records.encoded(rows, ["entity"], lambda t: b"" if t[0] is None else t[0].encode())
    out = records.decoded(packed, "payload", lambda b: (b.decode(),), T.StructType([T.StructField("entity", T.StringType())]))
    assert sorted(r.record.entity for r in out.df.collect()) == ["", "entity"]


def test_own_source(spark):
    source = records.own_source("squares_in_parts", "n bigint", lambda: [(0, 3), (3, 5)], lambda s: ((i * i,) for i in range(*s)))
    assert sorted(records.from_source(spark, source).run()) == [0, 1, 4, 9, 16]


def test_checkpoint(spark, tmp_path):
    path, made = str(tmp_path / "kept"), []

    def make():
        made.append(1)
        return ints(spark, 1, 2, 3)

    assert sorted(persisting.checkpointed(spark, path, make).run()) == [1, 2, 3]
    assert sorted(persisting.checkpointed(spark, path, make).run()) == [1, 2, 3] and len(made) == 1
    os.remove(f"{path}/_SUCCESS")  # left half written
    persisting.checkpointed(spark, path, make)
    assert len(made) == 2
    time.sleep(1.1)
    persisting.checkpointed(spark, path, make, persisting.Expiry(1.0, persisting.keep_numbered))
    assert len(made) == 3 and os.path.isdir(f"{path}-1")
    for _ in range(3):
        time.sleep(0.2)
        persisting.checkpointed(spark, path, make, persisting.Expiry(0.1, persisting.keep_last(2)))
    assert sorted(d for d in os.listdir(tmp_path) if d.startswith("kept-")) == ["kept-1", "kept-2"]


def test_app(spark, capsys):
    class Count(App):
        def run(self, session, args):
            self.show(session.range(int(args[0])).toDF("n"), lambda d: print("rows", d.count()))

    Count().main(["7", "--times"])
    assert "rows 7" in capsys.readouterr().out
    Count().main(["7", "--plan-only"])
    out = capsys.readouterr().out
    assert "Physical Plan" in out and "rows" not in out.split("==")[0]


def test_pandas_groups(spark):
    out = Bag.of(spark, [("a", 1), ("a", 2)], "key string, value int").group_by_key().combine_rows(lambda p: pd.DataFrame({"key": p.key[:1], "value": [int(p.value.sum())]}), "key string, value int")
    assert out.run() == [("a", 3)]
