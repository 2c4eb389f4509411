"""Avro container files in pure Python, for sessions without Spark's own module: by the public specification of the format.

Files are read in splits at their synchronisation marks and written one per partition. Codecs: null, deflate and, with its library, zstandard. Executors reach files through Arrow's file systems (local and mounted
folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import datetime
import io
import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.rows import batches_of, columns_of
from millrace.sources.files import Files

# Fixed values of the format: the magic bytes and the size of a mark.
MAGIC, MARK = b"Obj\x01", 16
#: Bytes of a file that one task reads, and of a block that is written.
SPLIT, BLOCK = 64 << 20, 64 << 10

_EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)
_DAY = datetime.date(1970, 1, 1)
_SIMPLE = {"null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType()}
#: Which written types may be read as another one.
_PROMOTED = {"int": {"long", "float", "double"}, "long": {"float", "double"}, "float": {"double"}, "string": {"bytes"}, "bytes": {"string"}}


class SchemaError(TypeError):
    """The schema asked for does not fit the file's."""


def resolved(schema: Any, named: dict | None = None) -> Any:
    """A schema (parsed JSON) in which every name stands for its definition and every type is a dict or a list. A type that contains itself has no Spark type and raises."""
    named = {} if named is None else named
    if isinstance(schema, str):
        if schema in _SIMPLE:
            return {"type": schema}
        if schema not in named:
            raise SchemaError(f"unknown type {schema}")
        if named[schema] is None:
            raise SchemaError(f"{schema} contains itself")
        return named[schema]
    if isinstance(schema, list):
        return [resolved(s, named) for s in schema]
    kind = schema["type"]
    if isinstance(kind, (dict, list)):
        return resolved(kind, named)
    out = dict(schema)
    if kind in ("record", "error"):
        names = {schema["name"], f"{schema['namespace']}.{schema['name']}" if schema.get("namespace") else schema["name"]}
        named.update(dict.fromkeys(names))
        out["fields"] = [{**f, "type": resolved(f["type"], named)} for f in schema["fields"]]
        named.update(dict.fromkeys(names, out))
    elif kind == "array":
        out["items"] = resolved(schema["items"], named)
    elif kind == "map":
        out["values"] = resolved(schema["values"], named)
    elif kind in ("enum", "fixed"):
        named[schema["name"]] = out
        if schema.get("namespace"):
            named[f"{schema['namespace']}.{schema['name']}"] = out
    elif kind not in _SIMPLE:
        return resolved(kind, named)
    return out


def _branches(union: list) -> list:
    return [b for b in union if not (isinstance(b, dict) and b["type"] == "null")]


def spark_type(s: Any) -> T.DataType:
    """The Spark type of a resolved schema; a union of several types is a struct of member0, member1, ... of which one is there."""
    if isinstance(s, list):
        rest = _branches(s)
        if len(rest) == 1:
            return spark_type(rest[0])
        kinds = {b["type"] for b in rest}
        if kinds == {"int", "long"}:
            return T.LongType()
        if kinds == {"float", "double"}:
            return T.DoubleType()
        return T.StructType([T.StructField(f"member{k}", spark_type(b)) for k, b in enumerate(rest)]) if rest else T.NullType()
    kind, logical = s["type"], s.get("logicalType")
    if kind in ("record", "error"):
        return T.StructType([T.StructField(f["name"], spark_type(f["type"])) for f in s["fields"]])
    if kind == "array":
        return T.ArrayType(spark_type(s["items"]))
    if kind == "map":
        return T.MapType(T.StringType(), spark_type(s["values"]))
    if kind == "enum":
        return T.StringType()
    if kind in ("fixed", "bytes") and logical == "decimal":
        return T.DecimalType(s["precision"], s.get("scale", 0))
    if kind == "fixed":
        return T.BinaryType()
    if logical == "date":
        return T.DateType()
    if logical in ("timestamp-millis", "timestamp-micros"):
        return T.TimestampType()
    return _SIMPLE[kind]


def avro_type(t: T.DataType, name: str = "topLevelRecord", nullable: bool = False) -> Any:
    """The schema of a Spark type; what may be null is a union with null."""
    if nullable:
        return [avro_type(t, name), "null"]
    if isinstance(t, T.StructType):
        return {"type": "record", "name": name, "fields": [{"name": f.name, "type": avro_type(f.dataType, f"{name}_{f.name}", f.nullable)} for f in t.fields]}
    if isinstance(t, T.ArrayType):
        return {"type": "array", "items": avro_type(t.elementType, f"{name}_item", t.containsNull)}
    if isinstance(t, T.MapType):
        if not isinstance(t.keyType, T.StringType):
            raise SchemaError("keys of maps must be strings")
        return {"type": "map", "values": avro_type(t.valueType, f"{name}_value", t.valueContainsNull)}
    if isinstance(t, T.DecimalType):
        return {"type": "bytes", "logicalType": "decimal", "precision": t.precision, "scale": t.scale}
    if isinstance(t, T.DateType):
        return {"type": "int", "logicalType": "date"}
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return {"type": "long", "logicalType": "timestamp-micros"}
    if isinstance(t, (T.ByteType, T.ShortType)):
        return "int"
    for kind, own in _SIMPLE.items():
        if type(t) is type(own):
            return kind
    raise SchemaError(f"no Avro type for {t.simpleString()}")


# --- bytes


def read_long(b: io.BytesIO) -> int:
    shift = value = 0
    while True:
        byte = b.read(1)
        if not byte:
            raise EOFError
        value |= (byte[0] & 0x7F) << shift
        if byte[0] < 0x80:
            return (value >> 1) ^ -(value & 1)
        shift += 7


def write_long(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), bytearray()
    while n > 0x7F:
        out.append((n & 0x7F) | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _blocks(b: io.BytesIO, one: Callable) -> Iterator:
    while n := read_long(b):
        if n < 0:
            n = -n
            read_long(b)
        for _ in range(n):
            yield one(b)


def reader_of(s: Any) -> Callable[[io.BytesIO], Any]:
    """How a value of a resolved schema is read: records as dicts, maps as dicts, bytes as bytes."""
    if isinstance(s, list):
        each = [reader_of(b) for b in s]
        rest, merged = _branches(s), not isinstance(spark_type(s), T.StructType) or len(_branches(s)) == 1
        place = {k: rest.index(b) for k, b in enumerate(s) if not (isinstance(b, dict) and b["type"] == "null")}
        names = [f"member{k}" for k in range(len(rest))]

        def union(b: io.BytesIO) -> Any:
            k = read_long(b)
            v = each[k](b)
            return v if merged or k not in place else {n: v if n == names[place[k]] else None for n in names}

        return union
    kind, logical = s["type"], s.get("logicalType")
    if kind in ("record", "error"):
        fields = [(f["name"], reader_of(f["type"])) for f in s["fields"]]
        return lambda b: {n: f(b) for n, f in fields}
    if kind == "array":
        item = reader_of(s["items"])
        return lambda b: list(_blocks(b, item))
    if kind == "map":
        value = reader_of(s["values"])
        return lambda b: dict(_blocks(b, lambda c: (c.read(read_long(c)).decode(), value(c))))
    if kind == "enum":
        symbols = s["symbols"]
        return lambda b: symbols[read_long(b)]
    raw = {
        "null": lambda b: None, "boolean": lambda b: b.read(1) == b"\x01", "int": read_long, "long": read_long, "float": lambda b: struct.unpack("<f", b.read(4))[0], "double": lambda b: struct.unpack("<d", b.read(8))[0],
        "bytes": lambda b: b.read(read_long(b)), "string": lambda b: b.read(read_long(b)).decode(), "fixed": lambda b: b.read(s["size"]),
    }[kind]
    if logical == "decimal":
        scale = s.get("scale", 0)
        return lambda b: Decimal(int.from_bytes(raw(b), "big", signed=True)).scaleb(-scale)
    if logical == "date":
        return lambda b: _DAY + datetime.timedelta(days=raw(b))
    if logical in ("timestamp-millis", "timestamp-micros"):
        unit = 1000 if logical == "timestamp-millis" else 1
        return lambda b: _EPOCH + datetime.timedelta(microseconds=raw(b) * unit)
    return raw


def writer_of(s: Any) -> Callable[[Any], bytes]:
    """How a value is written; unions are those with null that ``avro_type`` makes."""
    if isinstance(s, list):
        null = next(k for k, b in enumerate(s) if b["type"] == "null")
        other = 1 - null
        inner, here, none = writer_of(s[other]), write_long(other), write_long(null)
        return lambda v: none if v is None else here + inner(v)
    kind, logical = s["type"], s.get("logicalType")
    if kind == "record":
        fields = [(f["name"], writer_of(f["type"])) for f in s["fields"]]
        return lambda v: b"".join(f(v[n]) for n, f in fields)
    if kind == "array":
        item = writer_of(s["items"])
        return lambda v: (write_long(len(v)) + b"".join(map(item, v)) if v else b"") + b"\x00"
    if kind == "map":
        value = writer_of(s["values"])
        text = lambda k: write_long(len(k.encode())) + k.encode()
        return lambda v: (write_long(len(v)) + b"".join(text(k) + value(x) for k, x in v.items()) if v else b"") + b"\x00"
    if logical == "decimal":
        scale = s.get("scale", 0)

        def decimal(v: Decimal) -> bytes:
            n = int(v.scaleb(scale))
            raw = n.to_bytes(n.bit_length() // 8 + 1, "big", signed=True)
            return write_long(len(raw)) + raw

        return decimal
    if logical == "date":
        return lambda v: write_long((v - _DAY).days)
    if logical == "timestamp-micros":
        return lambda v: write_long(round(((v if v.tzinfo else v.replace(tzinfo=datetime.timezone.utc)) - _EPOCH) / datetime.timedelta(microseconds=1)))
    return {
        "null": lambda v: b"", "boolean": lambda v: b"\x01" if v else b"\x00", "int": write_long, "long": write_long, "float": lambda v: struct.pack("<f", v), "double": lambda v: struct.pack("<d", v),
        "bytes": lambda v: write_long(len(v)) + bytes(v), "string": lambda v: write_long(len(v.encode())) + v.encode(),
    }[kind]


def unpacked(data: bytes, codec: str) -> bytes:
    if codec == "null":
        return data
    if codec == "deflate":
        return zlib.decompress(data, -15)
    if codec == "zstandard":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"codec {codec} is not supported")


def packed(data: bytes, codec: str) -> bytes:
    if codec == "null":
        return data
    if codec == "deflate":
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        return c.compress(data) + c.flush()
    if codec == "zstandard":
        import zstandard

        return zstandard.ZstdCompressor().compress(data)
    raise ValueError(f"codec {codec} is not supported")


# --- schemas of readers


def fitted(reader: Any, writer: Any) -> Callable[[Any], Any]:
    """What becomes of a value of the writer's schema under the reader's: fields by name, defaults for those that are not there, wider numbers. Raises SchemaError where they don't fit."""
    if isinstance(reader, list) or isinstance(writer, list):
        r, w = (_branches(x) if isinstance(x, list) else [x] for x in (reader, writer))
        if len(r) == 1 and len(w) == 1:
            one = fitted(r[0], w[0])
            return lambda v: None if v is None else one(v)
        if len(r) != len(w):
            raise SchemaError("unions differ")
        each = [fitted(a, b) for a, b in zip(r, w, strict=True)]
        return lambda v: v if not isinstance(v, dict) else {n: None if x is None else each[k](x) for k, (n, x) in enumerate(v.items())}
    a, b = reader["type"], writer["type"]
    if a != b and a not in _PROMOTED.get(b, ()):
        raise SchemaError(f"expected {a}, the file has {b}")
    if a == "record":
        there = {f["name"]: f["type"] for f in writer["fields"]}
        parts = []
        for f in reader["fields"]:
            name = next((n for n in (f["name"], *f.get("aliases", ())) if n in there), None)
            if name is None and "default" not in f:
                raise SchemaError(f"the file has no field {f['name']}")
            parts.append((f["name"], name, fitted(f["type"], there[name]) if name else None, f.get("default")))
        return lambda v: {n: f(v[src]) if f else default for n, src, f, default in parts}
    if a == "array":
        item = fitted(reader["items"], writer["items"])
        return lambda v: [item(x) for x in v]
    if a == "map":
        value = fitted(reader["values"], writer["values"])
        return lambda v: {k: value(x) for k, x in v.items()}
    if a == "fixed" and reader["size"] != writer["size"]:
        raise SchemaError("sizes of fixed values differ")
    if a != b:
        return {"float": float, "double": float, "string": lambda v: v.decode(), "bytes": lambda v: v.encode(), "long": lambda v: v}[a]
    return lambda v: v


# --- files


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def header(f: pa.NativeFile) -> tuple[Any, str, bytes, int]:
    """Schema, codec, mark and length of a file's head."""
    size = 1 << 16
    while True:
        f.seek(0)
        head = f.read(size)
        if head[:4] != MAGIC:
            raise ValueError("not an Avro file")
        b = io.BytesIO(head)
        b.seek(4)
        try:
            meta = dict(_blocks(b, lambda c: (c.read(read_long(c)).decode(), c.read(read_long(c)))))
            mark = b.read(MARK)
            if len(mark) == MARK:
                return json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), mark, b.tell()
        except EOFError:
            pass
        if len(head) < size:
            raise ValueError("the file's head is not whole")
        size *= 4


def records_of(path: str, start: int, end: int, reader: Any = None) -> Iterator[Any]:
    """Values of the blocks of a file that begin in [start, end): a block belongs to the split in which the mark before it ends."""
    system, inner = _open(path)
    with system.open_input_file(inner) as f:
        schema, codec, mark, first = header(f)
        schema = resolved(schema)
        read = reader_of(schema)
        change = fitted(reader, schema) if reader is not None else None
        size = f.size()
        at = first
        if start > first:  # the first mark that ends in the split
            at, window = max(first, start - MARK), b""
            f.seek(at)
            while True:
                more = f.read(1 << 20)
                if not more:
                    return
                window += more
                k = window.find(mark)
                if k >= 0:
                    at += k + MARK
                    break
                at += len(window) - MARK + 1
                window = window[-MARK + 1 :]
        while at < min(end, size):
            f.seek(at)
            ahead = io.BytesIO(f.read(32))
            n, length = read_long(ahead), read_long(ahead)
            body = at + ahead.tell()
            f.seek(body)
            block = io.BytesIO(unpacked(f.read(length), codec))
            for _ in range(n):
                v = read(block)
                yield change(v) if change else v
            at = body + length + MARK


def splits_of(files: Iterable[str], size: int = SPLIT) -> list[tuple[str, int, int]]:
    out = []
    for path in files:
        system, inner = _open(path)
        n = system.get_file_info(inner).size
        out += [(path, k, min(n, k + size)) for k in range(0, max(n, 1), size)]
    return out


def read(spark: SparkSession, paths: list[str], schema: str | None = None, check: bool = True, split: int = SPLIT) -> DataFrame:
    """Records of files (globs and folders too). schema: that of the reader, which may leave out fields; without it that of the first file. check: look at every file's schema before anything is run."""
    files = [f for p in paths for f in Files(spark, p).data_files()]
    own = []
    for f in files if check else files[:1]:
        system, inner = _open(f)
        with system.open_input_file(inner) as g:
            own.append(resolved(header(g)[0]))
    if schema is None and not own:
        return spark.createDataFrame([], T.StructType([]))
    wanted = resolved(json.loads(schema)) if schema is not None else own[0]
    for s in own:
        fitted(wanted, s)
    kind = spark_type(wanted)
    single = not isinstance(kind, T.StructType)
    rows = T.StructType([T.StructField("value", kind)]) if single else kind
    parts = splits_of(files, split)
    if not parts:
        return spark.createDataFrame([], rows)
    placed = spark.createDataFrame([(k, *p) for k, p in enumerate(parts)], "k int, path string, start bigint, stop bigint").repartitionById(len(parts), F.col("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield from batches_of(((v,) if single else tuple(v[n] for n in rows.names) for v in records_of(r["path"], r["start"], r["stop"], wanted)), rows)

    return placed.mapInArrow(run, rows)


def write(df: DataFrame, path: str, overwrite: bool = False, codec: str = "deflate", check: bool = True) -> None:
    """One file per partition. Tasks write below ``_temporary``; only files of tasks that were successful are moved to their place, and the success mark comes last."""
    spark, kind = df.sparkSession, df.schema
    target = Files(spark, path)
    if check and target.exists():
        if not overwrite:
            raise FileExistsError(path)
        target.delete()
    schema = avro_type(kind)
    encode = writer_of(resolved(schema))
    scratch = f"{path.rstrip('/')}/_temporary-{uuid.uuid4()}"
    Files(spark, scratch).make_folder()
    names = kind.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = _open(scratch)
        name, mark = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4()}.avro", os.urandom(MARK)
        meta = {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode()}
        head = MAGIC + write_long(len(meta)) + b"".join(write_long(len(k)) + k.encode() + write_long(len(v)) + v for k, v in meta.items()) + b"\x00" + mark
        with system.open_output_stream(f"{inner}/{name}") as f:
            f.write(head)
            held, n, size = [], 0, 0

            def flush() -> None:
                nonlocal n, size
                body = packed(b"".join(held), codec)
                f.write(write_long(n) + write_long(len(body)) + body + mark)
                held.clear()
                n = size = 0

            for b in batches:
                for row in zip(*columns_of(b, kind), strict=True):
                    held.append(encode(dict(zip(names, row, strict=True))))
                    n, size = n + 1, size + len(held[-1])
                    if size >= BLOCK:
                        flush()
            if n:
                flush()
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    written = [r.name for r in df.mapInArrow(run, "name string").collect()]
    for name in written:
        Files(spark, f"{scratch}/{name}").rename(f"{path.rstrip('/')}/{name}")
    Files(spark, scratch).delete()
    Files(spark, f"{path.rstrip('/')}/_SUCCESS").touch()
