import math
from fractions import Fraction

import numpy as np
import pytest

from millrace.llm.quantiles import merge, percentiles, summarise

P = {"lo": "0", "p05": "0.05", "mid": "0.5", "p95": "0.95", "hi": "1"}


def brute(values):
    v = sorted(values)
    return tuple(v[max(1, math.ceil(Fraction(p) * len(v))) - 1] for p in P.values())


def frame(spark, rows, kind="int"):
    return spark.createDataFrame([(*r, 0, 0, 0) for r in rows], f"station string, temp {kind}, g int, q int, block int")


def check(spark, rows, kind="int", settle=4):
    got = percentiles(summarise(frame(spark, rows, kind), ["station"], "temp"), "station", P, settle=settle, blocks=6).collect()
    want = {}
    for s, v in rows:
        if v is not None and v == v:
            want.setdefault(s, []).append(v)
    assert {r.station: (r.n, r.lo, r.p05, r.mid, r.p95, r.hi) for r in got} == {s: (len(v), *brute(v)) for s, v in want.items()}


def test_integers_with_ties_nulls_and_a_hot_group(spark):
    rng = np.random.default_rng(4)
    rows = [("hot" if k % 3 else f"s{k % 13}", int(rng.normal(50, 30))) for k in range(4000)]
    check(spark, rows + rows[:100] + [("s1", None), ("none", None), (None, 5), (None, 7), ("one", 9)])


def test_doubles_need_many_rounds(spark):
    rng = np.random.default_rng(5)
    check(spark, [("a" if k % 2 else "b", float(rng.lognormal(0, 3))) for k in range(2500)] + [("a", float("nan"))], "double")


def test_all_equal_and_settled_at_once(spark):
    check(spark, [("a", 3)] * 500 + [("b", k) for k in range(7)], settle=64)


def test_parts_merge_and_resolution_bounds_the_error(spark):
    rng = np.random.default_rng(6)
    rows = [("a", float(x)) for x in rng.normal(0, 10, 1500)]
    parts = [summarise(frame(spark, rows[k::3], "double"), ["station"], "temp", resolution=0.5) for k in range(3)]
    r = percentiles(merge(*parts, keys=["station"]), "station", P, settle=8).first()
    assert r.n == 1500 and [r.lo, r.p05, r.mid, r.p95, r.hi] == pytest.approx(list(brute([v for _, v in rows])), abs=0.25 + 1e-9)


def test_nothing(spark):
    assert percentiles(summarise(frame(spark, []), ["station"], "temp"), "station", P).count() == 0


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_one_group_of_all_rows_with_and_without_broadcast(spark, broadcast):
    rng = np.random.default_rng(8)
    values = np.round(rng.lognormal(0, 2, 30_000), 4).tolist()
    rows = [("all", v) for v in values] + [("few", v) for v in values[:9]] + [(f"s{k % 3}", v) for k, v in enumerate(values[:900])] + [(None, v) for v in values[:300]]
    df = spark.createDataFrame(rows, "station string, temp double")
    got = percentiles(summarise(df, ["station"], "temp"), "station", P, settle=16, blocks=7, block=500, broadcast=broadcast).collect()
    want = {}
    for s, v in rows:
        want.setdefault(s, []).append(v)
    assert {r.station: (r.n, r.lo, r.p05, r.mid, r.p95, r.hi, r.error_bound) for r in got} == {s: (len(v), *brute(v), 0.0) for s, v in want.items()}


def test_the_bound_goes_with_the_summary(spark, tmp_path):
    rows = [("a", k / 7) for k in range(3000)]
    coarse, fine = (summarise(frame(spark, rows, "double"), ["station"], "temp", resolution=r) for r in (0.5, 0.25))
    coarse.write.parquet(f"{tmp_path}/coarse")
    out = percentiles(merge(spark.read.parquet(f"{tmp_path}/coarse"), fine, keys=["station"]), "station", P)
    assert out.first().error_bound == 0.25
    assert percentiles(fine, "station", P).first().error_bound == 0.125


@pytest.mark.parametrize("kind", ["decimal(12,3)", "date", "float", "smallint"])
def test_other_kinds_of_values(spark, kind):
    df = spark.range(500).selectExpr("'a' as station", f"cast({'date_add(date 2020-01-01, cast(id as int))'.replace('date 2020-01-01', 'date' + chr(39) + '2020-01-01' + chr(39)) if kind == 'date' else '(id * 37) % 500'} as {kind}) as temp")
    r = percentiles(summarise(df, ["station"], "temp"), "station", P, settle=8).first()
    v = sorted(x.temp for x in df.collect())
    assert (r.lo, r.p05, r.mid, r.p95, r.hi) == brute(v)
