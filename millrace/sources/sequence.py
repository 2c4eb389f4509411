"""Sequence files of keys and values, which Spark offers as RDDs only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.bag import Bag, Scalar
from millrace.sources.files import Files
from millrace.sources.text import present

_KIND = {T.IntegerType: int, T.LongType: int, T.ShortType: int, T.ByteType: int, T.DoubleType: float, T.FloatType: float, T.StringType: str, T.BooleanType: bool, T.BinaryType: (bytes, bytearray)}


def from_sequence(spark: SparkSession, key: T.DataType, value: T.DataType, *paths: str, check: bool = True, with_path: bool = False) -> Bag:
    """Keys and values (columns key, value; with_path adds path). A file whose keys or values are of another type raises TypeError when it is read."""
    schema = T.StructType([T.StructField("key", key), T.StructField("value", value)])
    there = present(spark, paths, check)
    if not there:
        return Bag(spark.createDataFrame([], T.StructType([*([T.StructField("path", T.StringType())] if with_path else []), *schema.fields])))
    kinds = _KIND.get(type(key), object), _KIND.get(type(value), object)

    def checked(row: tuple) -> tuple:
        for x, kind in zip(row, kinds, strict=True):
            if x is not None and not isinstance(x, kind):
                raise TypeError(f"expected {kind}, the file has {type(x)}")
        return row

    sc = spark.sparkContext
    if not with_path:
        return Bag(spark.createDataFrame(sc.sequenceFile(",".join(there)).map(checked), schema))
    # Spark tells no paths of sequence files, so each file is a source of its own, in one flat union
    files = [f for p in there for f in Files(spark, p).data_files()]
    located = T.StructType([T.StructField("path", T.StringType()), *schema.fields])
    rows = sc.union([sc.sequenceFile(f).map(lambda row, f=f: (f, *checked(row))) for f in files]) if files else []
    return Bag(spark.createDataFrame(rows, located))


def convert_sequence(spark: SparkSession, decode: Callable[[Any, Any], tuple | None], schema: T.StructType | str, *paths: str, check: bool = True) -> Bag:
    """Elements made by a function from the keys and values of sequence files; what it gives None for is left out."""
    there = present(spark, paths, check)
    if not there:
        return Bag(spark.createDataFrame([], schema))
    rows = spark.sparkContext.sequenceFile(",".join(there)).map(lambda kv: decode(*kv)).filter(lambda r: r is not None)
    return Bag(spark.createDataFrame(rows, schema))


def keys_from_sequence(spark: SparkSession, key: T.DataType, value: T.DataType, *paths: str, **options: bool) -> Bag:
    return Bag(from_sequence(spark, key, value, *paths, **options).df.drop("value"))


def values_from_sequence(spark: SparkSession, key: T.DataType, value: T.DataType, *paths: str, **options: bool) -> Bag:
    return Bag(from_sequence(spark, key, value, *paths, **options).df.drop("key"))


def sequence_object(spark: SparkSession, key: T.DataType, value: T.DataType, path: str) -> Scalar:
    """The first pair."""
    return Scalar(from_sequence(spark, key, value, path).df.limit(1), "raise")


def sequence_key_object(spark: SparkSession, key: T.DataType, value: T.DataType, path: str) -> Scalar:
    return sequence_object(spark, key, value, path).map("key")


def sequence_value_object(spark: SparkSession, key: T.DataType, value: T.DataType, path: str) -> Scalar:
    return sequence_object(spark, key, value, path).map("value")


@dataclass(frozen=True)
class SequenceSink:
    """key or value may be None: then only the other side is written, with a null beside it."""

    path: str
    key: str | None = "key"
    value: str | None = "value"
    overwrite: bool = False
    codec: str | None = None
    check: bool = True

    def compressed(self, codec: str = "gzip") -> SequenceSink:
        return replace(self, codec={"gzip": "org.apache.hadoop.io.compress.GzipCodec", "bzip2": "org.apache.hadoop.io.compress.BZip2Codec"}.get(codec, codec))

    def __call__(self, df: DataFrame) -> None:
        files = Files(df.sparkSession, self.path)
        if self.check and files.exists():
            if not self.overwrite:
                raise FileExistsError(self.path)
            files.delete()
        key, value = self.key, self.value
        names = [c for c in (key, value) if c]
        rows = df.select(*names).rdd.map(lambda r: (r[key] if key else None, r[value] if value else None))
        rows.saveAsSequenceFile(self.path, self.codec)


def to_sequence(bag: Bag, path: str, overwrite: bool = False) -> Bag:
    return bag.add_sink(SequenceSink(path, bag.key, bag.value, overwrite))


def keys_to_sequence(bag: Bag, path: str, overwrite: bool = False) -> Bag:
    return bag.add_sink(SequenceSink(path, bag.key, None, overwrite))


def values_to_sequence(bag: Bag, path: str, overwrite: bool = False) -> Bag:
    return bag.add_sink(SequenceSink(path, None, bag.value, overwrite))


def to_partitioned_sequence(bag: Bag, path: str, partition: str, overwrite: bool = False, keys: bool = True, values: bool = True) -> Bag:
    """One folder per value of the partition column, of keys and values or one of them.

    Spark has no writer that does this in one go, so partitions are written one after the other, each reading its own rows of a copy that is kept; their number has no limit.
    """

    def write(df: DataFrame) -> None:
        held = df.persist()
        try:
            for (p,) in held.select(partition).distinct().toLocalIterator():
                SequenceSink(f"{path}/{p}", bag.key if keys else None, bag.value if values else None, overwrite)(held.where(F.col(partition).eqNullSafe(F.lit(p))))
        finally:
            held.unpersist()

    return bag.add_sink(write)
