import datetime
import io
import json
import os
import struct
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from millrace.operators.bag import Bag
from millrace.sources import avro, persisting, records

SCHEMA = "s string, n bigint, i int, d double, f float, b boolean, raw binary, day date, at timestamp, dec decimal(20,3), a array<struct<x:double,y:string>>, m map<string,array<bigint>>, r struct<k:int,inner:struct<z:string>>"
ROWS = [
    ("é", 2**53 + 1, -5, 0.5, 1.5, True, b"\x00\xff", datetime.date(1969, 12, 31), datetime.datetime(2024, 2, 29, 12, 0, 1, 250), Decimal("-12345.678"), [(1.0, "q"), (None, None)], {"k": [1, None], "": []}, (7, ("zz",))),
    (None,) * 13,
    ("", -(2**63), 2**31 - 1, -0.0, 0.0, False, b"", datetime.date(2500, 1, 1), datetime.datetime(1901, 1, 1), Decimal("0.001"), [], {}, (None, None)),
]


@settings(max_examples=200, deadline=None)
@given(st.integers(-(2**63), 2**63 - 1))
def test_whole_numbers(n):
    assert avro.read_long(io.BytesIO(avro.write_long(n))) == n


def test_numbers_of_the_specification():
    assert [avro.write_long(n) for n in (0, -1, 1, -2, 2, -64, 64)] == [b"\x00", b"\x01", b"\x02", b"\x03", b"\x04", b"\x7f", b"\x80\x01"]


@pytest.mark.parametrize("codec", ["null", "deflate", "zstandard"])
def test_round_trip(spark, tmp_path, codec):
    out = str(tmp_path / "a")
    rows = Bag(spark.createDataFrame(ROWS * 50, SCHEMA).repartition(3))
    persisting.persist(records.to_avro(rows, out, compression=codec))
    assert os.path.exists(f"{out}/_SUCCESS") and len([f for f in os.listdir(out) if f.endswith(".avro")]) == 3 and not [f for f in os.listdir(out) if "temporary" in f]
    got = records.from_avro(spark, out).df
    assert got.count() == 150
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.df.collect()))
    with pytest.raises(FileExistsError):
        persisting.persist(records.to_avro(rows, out))
    persisting.persist(records.to_avro(Bag(rows.df.limit(1)), out, overwrite=True))
    assert records.from_avro(spark, out).length().run() == 1


def test_splits_read_every_record_once(spark, tmp_path):
    out = str(tmp_path / "a")
    df = spark.range(40_000).selectExpr("id", "repeat(cast(id as string), 5) as s").coalesce(1)
    avro.write(df, out, codec="null")
    [path] = [os.path.join(out, f) for f in os.listdir(out) if f.endswith(".avro")]
    for size in (10_000, 65_536, 300_001, 1 << 30):
        parts = avro.splits_of([path], size)
        ids = [r["id"] for p in parts for r in avro.records_of(*p)]
        assert ids == list(range(40_000))
    assert avro.read(spark, [out], split=100_000).where("id % 2 = 0").count() == 20_000


def by_hand(path, schema, blocks, codec="null"):
    """A file as another writer would make it."""
    mark = bytes(range(16))
    text = json.dumps(schema).encode()
    with open(path, "wb") as f:
        f.write(b"Obj\x01" + avro.write_long(2))
        for k, v in ((b"avro.codec", codec.encode()), (b"avro.schema", text)):
            f.write(avro.write_long(len(k)) + k + avro.write_long(len(v)) + v)
        f.write(b"\x00" + mark)
        for n, body in blocks:
            f.write(avro.write_long(n) + avro.write_long(len(body)) + body + mark)


def test_unions_enums_and_fixed_values_of_other_writers(spark, tmp_path):
    schema = {
        "type": "record", "name": "Row", "namespace": "x.y",
        "fields": [{"name": "u", "type": ["int", {"type": "record", "name": "Pair", "fields": [{"name": "a", "type": "long"}, {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["LOW", "HIGH"]}}]}, "null"]}, {"name": "again", "type": ["null", "Pair"]}, {"name": "h", "type": {"type": "fixed", "name": "H", "size": 4}}, {"name": "t", "type": {"type": "long", "logicalType": "timestamp-millis"}}, {"name": "w", "type": ["float", "double"]}, {"name": "g", "type": {"type": "array", "items": "int"}}],
    }
    L = avro.write_long
    rest = b"\x01\x02\x03\x04" + L(1500) + L(0) + struct.pack("<f", 0.5) + L(-2) + L(2) + L(4) + L(5) + L(0)
    by_hand(f"{tmp_path}/x.avro", schema, [(2, L(0) + L(50) + L(0) + rest + L(1) + L(9) + L(1) + L(1) + L(8) + L(0) + rest), (0, b""), (1, L(2) + L(0) + rest)])
    got = records.from_avro(spark, f"{tmp_path}/*.avro").df
    assert got.schema["u"].dataType.simpleString() == "struct<member0:int,member1:struct<a:bigint,e:string>>" and got.schema["w"].dataType == T.DoubleType()
    rows = got.collect()
    assert [r.u if r.u is None else (r.u.member0, r.u.member1 and tuple(r.u.member1)) for r in rows] == [(50, None), (None, (9, "HIGH")), None]
    assert rows[1].again.e == "LOW" and rows[0].again is None and rows[0].h == b"\x01\x02\x03\x04" and rows[0].g == [4, 5] and rows[0].w == 0.5
    assert '"g": [4, 5]' in records.avro_cat(spark, f"{tmp_path}/x.avro")[0] and records.avro_object(spark, f"{tmp_path}/*.avro").run()[0].member0 == 50


def test_readers_schema(spark, tmp_path):
    out = str(tmp_path / "a")
    avro.write(spark.createDataFrame([(1, "x", 2.5)], "k int, s string, d double"), out)
    part = {"type": "record", "name": "R", "fields": [{"name": "k", "type": ["long", "null"]}, {"name": "new", "type": "string", "default": "?"}, {"name": "other", "aliases": ["s"], "type": ["null", "string"]}]}
    assert records.from_avro(spark, out, schema=json.dumps(part)).run() == [(1, "?", "x")]
    for field in ({"name": "s", "type": "int"}, {"name": "none", "type": "int"}):
        with pytest.raises(TypeError):
            records.from_avro(spark, out, schema=json.dumps({"type": "record", "name": "R", "fields": [field]}))
    assert records.from_avro(spark, str(tmp_path / "none"), schema=json.dumps(part), check=False).run() == []
    with pytest.raises(FileNotFoundError):
        records.from_avro(spark, str(tmp_path / "none"))


def test_bad_files_and_types(spark, tmp_path):
    (tmp_path / "bad.avro").write_bytes(b"nothing")
    with pytest.raises(ValueError, match="not an Avro"):
        records.from_avro(spark, f"{tmp_path}/bad.avro")
    with pytest.raises(TypeError):
        avro.avro_type(T.MapType(T.IntegerType(), T.StringType()))
    with pytest.raises(TypeError):
        avro.resolved({"type": "record", "name": "N", "fields": [{"name": "next", "type": ["null", "N"]}]})
    empty = spark.createDataFrame([], "k int")
    avro.write(empty, f"{tmp_path}/empty")
    assert records.from_avro(spark, f"{tmp_path}/empty").run() == []
