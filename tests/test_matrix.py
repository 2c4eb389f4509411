import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import reductions as red
from millrace.operators.matrix import Matrix, Vector

RNG = np.random.default_rng(8)


def random(n, m, k):
    out = np.zeros((n, m), int)
    out[RNG.integers(0, n, k), RNG.integers(0, m, k)] = RNG.integers(1, 50, k)
    return out


def sparse(spark, a):
    return Matrix(spark.createDataFrame([(int(i), int(j), int(a[i, j])) for i, j in zip(*np.nonzero(a))], "row int, col int, value long"))


def dense(df, shape):
    out = np.zeros(shape, int)
    for r in df.collect():
        out[tuple(r[:-1])] = r.value
    return out


def test_products(spark):
    a, b, v = random(20, 15, 60), random(15, 12, 50), random(15, 1, 6)[:, 0]
    w = random(20, 1, 7)[:, 0]
    vec = lambda x: Vector(spark.createDataFrame([(int(i), int(x[i])) for i in np.flatnonzero(x)], "idx int, value long"))
    assert (dense(sparse(spark, a).by_matrix(sparse(spark, b)).df, (20, 12)) == a @ b).all()
    assert (dense(sparse(spark, a).by_vector(vec(v).in_memory()).df, (20,)) == a @ v).all()
    assert (dense(vec(w).by_matrix(sparse(spark, a)).df, (15,)) == w @ a).all()
    assert (dense(sparse(spark, a).transpose().df, (15, 20)) == a.T).all()
    full = sparse(spark, a).by_dense_vector(vec(v), 0).df
    assert full.count() == (a != 0).any(1).sum() and (dense(full, (20,)) == a @ v).all()


def test_position_is_index_in_a_dense_vector(spark):
    v = Vector(spark.createDataFrame([(4, 7), (1, 5)], "idx long, value int"))
    assert [r.value for r in v.dense().df.orderBy("idx").collect()] == [0, 5, 0, 0, 7]
    assert v.dense(7).df.count() == 7
    assert Vector(spark.createDataFrame([], "idx long, value int")).dense().df.count() == 0


def test_order_of_a_multiplication_that_does_not_commute(spark):
    m = Matrix(spark.createDataFrame([(0, 0, 5)], "row int, col int, value int"))
    v = Vector(spark.createDataFrame([(0, 3)], "idx int, value int"))
    assert m.by_vector(v, lambda a, b: a - b).df.first().value == 2
    assert v.by_matrix(m, lambda a, b: a - b).df.first().value == -2


def test_min_plus_and_rows_from_a_function(spark):
    a = sparse(spark, np.array([[1, 4], [0, 2]]))
    got = {(r.row, r.col): r.value for r in a.by_matrix(a, lambda x, y: x + y, red.MINIMUM).df.collect()}
    assert got == {(0, 0): 2, (0, 1): 5, (1, 1): 4}
    by = a.by_function(lambda i: F.array(F.struct(F.lit(9).alias("c"), (i + 1).alias("v"))))
    assert {(r.row, r.col): r.value for r in by.df.collect()} == {(0, 9): 1 + 8, (1, 9): 4}


def test_rows(spark):
    df = spark.createDataFrame([(1, [(0, 2.0), (3, 4.0)])], "r int, e array<struct<c:int,v:double>>")
    assert {tuple(r) for r in Matrix.from_rows(df, "r", "e").df.collect()} == {(1, 0, 2.0), (1, 3, 4.0)}


@pytest.mark.parametrize("op", ["by_matrix"])
def test_empty(spark, op):
    none = Matrix(spark.createDataFrame([], "row int, col int, value int"))
    assert getattr(none, op)(none).df.count() == 0
