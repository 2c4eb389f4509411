"""Binary record formats: Avro, Thrift payloads through a decoder, and sources of one's own."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.operators.bag import Bag, Scalar
from millrace.sources import avro
from millrace.sources.text import present


def avro_available(spark: SparkSession) -> bool:
    try:
        spark.sparkContext._jvm.org.apache.spark.sql.execution.datasources.DataSource.lookupDataSource("avro", spark._jsparkSession.sessionState().conf())
    except Exception:
        return False
    return True


def from_avro(spark: SparkSession, *paths: str, schema: str | None = None, check: bool = True) -> Bag:
    """Records of Avro files, by Spark's module where it is on the class path and otherwise by the package's own reader.

    schema: a reader schema (JSON), which may name some of the fields only; one that doesn't fit the files raises. check: whether every path must be there and every file's schema is looked at before anything runs.
    """
    there = present(spark, paths, check)
    if not there:
        if schema is None:
            raise FileNotFoundError("no Avro file, and no schema for an empty list")
        return Bag(spark.createDataFrame([], avro.spark_type(avro.resolved(json.loads(schema)))))
    if avro_available(spark):
        reader = spark.read.format("avro")
        return Bag((reader.option("avroSchema", schema) if schema else reader).load(there))
    return Bag(avro.read(spark, there, schema, check))


def avro_object(spark: SparkSession, path: str) -> Scalar:
    """The first record of the files that a path or pattern stands for."""
    return Scalar(from_avro(spark, path).df.limit(1), "raise")


def avro_cat(spark: SparkSession, path: str, lines: int = 20) -> list[str]:
    """The first records of Avro files as JSON."""
    return [json.dumps(r.asDict(recursive=True), default=str) for r in from_avro(spark, path).df.limit(lines).collect()]


@dataclass(frozen=True)
class AvroSink:
    path: str
    overwrite: bool = False
    codec: str = "deflate"
    check: bool = True

    def compressed(self, codec: str = "deflate") -> AvroSink:
        return replace(self, codec=codec)

    def __call__(self, df: DataFrame) -> None:
        if avro_available(df.sparkSession):
            mode = "overwrite" if self.overwrite else "errorifexists" if self.check else "append"
            df.write.format("avro").mode(mode).option("compression", self.codec).save(self.path)
        else:
            avro.write(df, self.path, self.overwrite, self.codec, self.check)


def to_avro(bag: Bag, path: str, overwrite: bool = False, compression: str | None = None) -> Bag:
    """Avro files of the list's columns; ``persisting.kept`` makes the sink a checkpoint."""
    return bag.add_sink(AvroSink(path, overwrite, compression or "deflate"))


def decoded(bag: Bag, payload: str, decode: Callable[[bytes], tuple], schema: T.StructType) -> Bag:
    """Records out of a binary column (Thrift structs, say), by a decoder that gives a tuple of the schema's fields; null payloads give a null record."""

    @F.pandas_udf(schema)
    def read(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode(bytes(x)) if x is not None else (None,) * len(schema) for x in s], columns=schema.names)

    return Bag(bag.df.select(*[c for c in bag.df.columns if c != payload], read(F.col(payload)).alias("record")))


def encoded(bag: Bag, fields: list[str], encode: Callable[[tuple], bytes]) -> Bag:
    """The named columns of each element as one binary column ``payload``."""

    @F.pandas_udf("binary")
    def write(f: pd.DataFrame) -> pd.Series:
        return pd.Series([encode(t) for t in f.itertuples(index=False, name=None)])

    return Bag(bag.df.select(write(F.struct(*fields)).alias("payload")))


class Split(InputPartition):
    def __init__(self, value: Any) -> None:
        self.value = value


def own_source(name: str, schema: str, splits: Callable[[], list], read: Callable[[Any], Iterator[tuple]]) -> type[DataSource]:
    """A source of one's own, to be given to ``from_source``: splits() says what can be read side by side, read(split) gives the rows of one."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [Split(s) for s in splits()]

        def read(self, partition: Split) -> Iterator[tuple]:
            return read(partition.value)

    columns = schema

    class Own(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return columns

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return Reader()

    return Own


def from_source(spark: SparkSession, source: type[DataSource], **options: str) -> Bag:
    spark.dataSource.register(source)
    return Bag(spark.read.format(source.name()).options(**options).load())
