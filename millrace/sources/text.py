"""Text in and out: plain, with paths, delimited, partitioned, compressed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import field, fields
from millrace.operators.bag import Bag, Scalar
from millrace.sources.files import Files


def present(spark: SparkSession, paths: tuple[str, ...], check: bool) -> list[str]:
    """The paths (globs and folders too). With check, one that stands for nothing raises FileNotFoundError; without, it is left out."""
    out = []
    for p in paths:
        if Files(spark, p).matches():
            out.append(p)
        elif check:
            raise FileNotFoundError(p)
    return out


def from_text(spark: SparkSession, *paths: str, check: bool = True) -> Bag:
    """Lines of text files; compression goes by the file's ending."""
    there = present(spark, paths, check)
    return Bag(spark.read.text(there) if there else spark.createDataFrame([], "value string"))


def from_text_with_path(spark: SparkSession, *paths: str, check: bool = True) -> Bag:
    """Each line (value) with the path of its file (key)."""
    there = present(spark, paths, check)
    if not there:
        return Bag(spark.createDataFrame([], "key string, value string"))
    return Bag(spark.read.text(there).select(F.col("_metadata.file_path").alias("key"), "value"))


def from_delimited(spark: SparkSession, columns: dict[str, tuple[int, Callable[[Column], Column]]], *paths: str, separator: str = "\t", check: bool = True) -> Bag:
    """Columns taken from the fields of each line: name to (field number, extractor). A line of which one of them isn't defined is dropped."""
    parts = from_text(spark, *paths, check=check).df.select(fields(F.col("value"), separator).alias("f"))
    out = parts.select(*[extract(field(F.col("f"), k)).alias(name) for name, (k, extract) in columns.items()])
    return Bag(out.dropna())


def text_object(spark: SparkSession, path: str) -> Scalar:
    """The first line of the first file."""
    return Scalar(from_text(spark, path).df.limit(1), "raise")


def delimited_object(spark: SparkSession, columns: dict[str, tuple[int, Callable[[Column], Column]]], path: str, separator: str = "\t") -> Scalar:
    """The first line for which all columns are defined."""
    return Scalar(from_delimited(spark, columns, path, separator=separator).df.limit(1), "raise")


def codec_available(spark: SparkSession, codec: str) -> bool:
    """Whether a compression codec (a short name such as gzip, or a class) is there."""
    names = {"gzip": "GzipCodec", "bzip2": "BZip2Codec", "deflate": "DefaultCodec", "snappy": "SnappyCodec", "lz4": "Lz4Codec", "zstd": "ZStandardCodec"}
    try:
        spark.sparkContext._jvm.org.apache.hadoop.util.ReflectionUtils.newInstance(spark.sparkContext._jvm.java.lang.Class.forName(f"org.apache.hadoop.io.compress.{names[codec]}" if codec in names else codec), spark.sparkContext._jsc.hadoopConfiguration())
    except Exception:
        return False
    return True


def _flat(c: Column, kind: T.DataType, separator: str) -> Column:
    """A value as text: the fields of structs and the elements of arrays one behind the other."""
    if isinstance(kind, T.StructType):
        return F.concat_ws(separator, *[F.coalesce(_flat(c.getField(f.name), f.dataType, separator), F.lit("")) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(c, lambda x: _flat(x, kind.elementType, separator)), separator, "")
    return c.cast("string")


def flat_line(df: DataFrame, separator: str) -> Column:
    return F.concat_ws(separator, *[F.coalesce(_flat(F.col(f"`{f.name}`"), f.dataType, separator), F.lit("")) for f in df.schema.fields])


@dataclass(frozen=True)
class TextSink:
    """Where and how a list is written. overwrite: replace what is there; without it, an existing path is an error. separator: None writes single values as they are."""

    path: str
    overwrite: bool = False
    separator: str | None = None
    compression: str | None = None
    partitions: tuple[str, ...] = ()
    check: bool = True

    def compressed(self, codec: str = "gzip") -> TextSink:
        return replace(self, compression=codec)

    def __call__(self, df: DataFrame) -> None:
        rest = df.drop(*self.partitions) if self.partitions else df
        line = (F.col(f"`{rest.columns[0]}`").cast("string") if len(rest.columns) == 1 and self.separator is None else flat_line(rest, self.separator if self.separator is not None else ",")).alias("value")
        writer = df.select(line, *self.partitions).write.mode("overwrite" if self.overwrite else "errorifexists" if self.check else "append")
        if self.compression:
            writer = writer.option("compression", self.compression)
        if self.partitions:
            writer = writer.partitionBy(*self.partitions)
        writer.text(self.path)


def to_text(bag: Bag, path: str, overwrite: bool = False) -> Bag:
    return bag.add_sink(TextSink(path, overwrite))


def to_delimited(bag: Bag, path: str, separator: str = "\t", overwrite: bool = False) -> Bag:
    """One line per element, its columns, fields and list elements separated; nothing is quoted."""
    return bag.add_sink(TextSink(path, overwrite, separator))


def to_partitioned_text(bag: Bag, path: str, partitions: list[str], overwrite: bool = False, separator: str = "\t") -> Bag:
    """One folder per value of the partition columns (name=value), the other columns as lines."""
    return bag.add_sink(TextSink(path, overwrite, separator, partitions=tuple(partitions)))


def compressed(bag: Bag, codec: str = "gzip") -> Bag:
    """Compresses the sink that was added last."""
    return bag.update_sinks(lambda s: (*s[:-1], s[-1].compressed(codec)))
