import pytest

from millrace.plans.programs import page_rank, shortest_paths, similarity


def test_page_rank(spark):
    links = [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]
    got = {r.id: r.rank for r in page_rank(spark.createDataFrame(links, "src int, dst int"), damping=0.5, rounds=1).collect()}
    assert got == pytest.approx({1: 0.5, 2: 0.5 + 0.5 / 3, 3: 0.5 + 0.5 * (1 / 3 + 1 / 2), 4: 0.5 + 0.5 * (1 / 3 + 1 / 2 + 1)})
    settled = {r.id: r.rank for r in page_rank(spark.createDataFrame(links, "src int, dst int"), tolerance=1e-9).collect()}
    assert settled[1] == 0.5 and settled[2] == pytest.approx(7 / 12) and settled[3] == pytest.approx(0.5 + 0.5 * (0.5 / 3 + 7 / 24))
    assert page_rank(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_shortest_paths(spark):
    edges = ["AB", "AC", "CD", "CE", "DE", "FG", "EF", "GE"]
    both = spark.createDataFrame([tuple(e) for e in edges] + [(e[1], e[0]) for e in edges], "src string, dst string")
    got = {r.id: r.distance for r in shortest_paths(both, spark.createDataFrame([("A",)], "id string")).collect()}
    assert got == {"A": 0, "B": 1, "C": 1, "D": 2, "E": 2, "F": 3, "G": 3}
    assert shortest_paths(both, spark.createDataFrame([], "id string")).count() == 0


def test_similarity(spark):
    df = spark.createDataFrame([("k", 1.0, 2.0), ("k", 2.0, 4.0), ("k", 3.0, 6.0), ("one", 1.0, 1.0)], "k string, x double, y double")
    got = {r.k: r for r in similarity(df, "k").collect()}
    assert got["k"].correlation == pytest.approx(1) and got["k"].cosine == pytest.approx(1)
    assert got["one"].correlation is None
