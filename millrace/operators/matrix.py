"""Sparse linear algebra over a chosen multiplication and addition.

A matrix is a frame of entries (row, col, value), a vector one of (idx, value); missing entries contribute nothing. Products are a join on the inner index and one aggregation, for any pair of
a multiplication of columns and a Reduction as addition.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.reductions import SUM, Reduction
from millrace.session import small

Times = Callable[[Column, Column], Column]


def times(a: Column, b: Column) -> Column:
    return a * b


@dataclass(frozen=True)
class Vector:
    df: DataFrame

    def by_matrix(self, m: Matrix, mult: Times = times, add: Reduction = SUM) -> Vector:
        """The row vector times the matrix: entry j is the sum over i of v(i) m(i, j)."""
        return m.transpose().by_vector(self, lambda x, y: mult(y, x), add)

    def dense(self, size: int | None = None, zero: object = 0) -> Vector:
        """Every index from 0 to the largest (or size - 1), with zero where there was nothing. Position is index."""
        top = self.df.agg(F.coalesce(F.max("idx"), F.lit(-1)).alias("top")).select(F.explode(F.when(F.col("top") >= 0, F.sequence(F.lit(0).cast("long"), F.col("top").cast("long")))).alias("idx")) if size is None else self.df.sparkSession.range(size).withColumnRenamed("id", "idx")
        value = self.df.select(F.col("idx").alias("i"), "value")
        return Vector(top.join(value, F.col("idx") == F.col("i"), "left").select("idx", F.coalesce("value", F.lit(zero)).alias("value")))

    def in_memory(self) -> Vector:
        """The vector counted, and broadcast in products if it is small enough; otherwise left to a shuffle join."""
        return Vector(small(self.df))


@dataclass(frozen=True)
class Matrix:
    df: DataFrame

    @staticmethod
    def from_rows(df: DataFrame, row: str, entries: str) -> Matrix:
        """From a row id and an array of (col, value) structs."""
        return Matrix(df.select(F.col(row).alias("row"), F.inline(entries)).toDF("row", "col", "value"))

    @staticmethod
    def generated(inner: DataFrame, entries: Callable[[Column], Column]) -> Matrix:
        """A right operand whose row of each inner index (column idx) is made by an expression: an array of (col, value) structs, the same each time it is evaluated."""
        return Matrix(inner.select(F.col("idx").alias("row"), F.inline(entries(F.col("idx")))).toDF("row", "col", "value"))

    def transpose(self) -> Matrix:
        return Matrix(self.df.select(F.col("col").alias("row"), F.col("row").alias("col"), "value"))

    def by_matrix(self, other: Matrix, mult: Times = times, add: Reduction = SUM) -> Matrix:
        """Entry (i, j) is the sum over k of a(i, k) b(k, j)."""
        r = other.df.select(F.col("row").alias("k"), F.col("col").alias("j"), F.col("value").alias("y"))
        products = self.df.join(r, F.col("col") == F.col("k")).select("row", F.col("j").alias("col"), mult(F.col("value"), F.col("y")).alias("p"))
        return Matrix(products.groupBy("row", "col").agg(add.of("p").alias("value")))

    def by_vector(self, v: Vector, mult: Times = times, add: Reduction = SUM) -> Vector:
        """Entry i is the sum over j of m(i, j) v(j); rows that meet no entry of the vector are not there."""
        r = v.df.select("idx", F.col("value").alias("y"))
        return Vector(self.df.join(r, F.col("col") == F.col("idx")).select(F.col("row"), mult(F.col("value"), F.col("y")).alias("p")).groupBy(F.col("row").alias("idx")).agg(add.of("p").alias("value")))

    def by_dense_vector(self, v: Vector, zero: object = 0, mult: Times = times, add: Reduction = SUM) -> Vector:
        """As by_vector, but every row of the matrix has an entry: zero if it meets none of the vector."""
        met = self.by_vector(v, mult, add).df.select(F.col("idx").alias("i"), "value")
        rows = self.df.select(F.col("row").alias("idx")).distinct()
        return Vector(rows.join(met, F.col("idx") == F.col("i"), "left").select("idx", F.coalesce("value", F.lit(zero)).alias("value")))

    def by_function(self, entries: Callable[[Column], Column], mult: Times = times, add: Reduction = SUM) -> Matrix:
        """Times a matrix that is given by a function from the inner index to a row; each needed row is made once."""
        inner = self.df.select(F.col("col").alias("idx")).distinct()
        return self.by_matrix(Matrix.generated(inner, entries), mult, add)
