import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators.rolling import calendar_day, day_number, rolling_totals


def test_calendar(spark):
    days = [20240229, 20230229, 20230431, 20231301, 20230100, 0, 20000101, 19000229, 20000229, None, -5, 10101, 99991231]
    got = [r.d for r in spark.createDataFrame([(d,) for d in days], "x int").select(day_number(calendar_day(F.col("x"))).alias("d")).collect()]
    assert got == [20240229, None, None, None, None, None, 20000101, None, 20000229, None, None, 10101, 99991231]


def brute(rows, windows):
    df = pd.DataFrame([r[:3] for r in rows if None not in r[:3] and np.isfinite(r[2])], columns=["e", "d", "v"])
    out = {}
    for e, g in df.groupby("e"):
        for d in range(g.d.min(), g.d.max() + 1):
            out[e, d] = [x for w in windows for x in (int(((g.d <= d) & (g.d > d - w)).sum()), round(float(g.v[(g.d <= d) & (g.d > d - w)].sum()), 6))]
    return out


@pytest.mark.parametrize(("windows", "tile"), [((7, 30), 256), ((2, 5), 8), ((1, 40), 16)])
def test_totals_equal_brute_force(spark, windows, tile):
    rng = np.random.default_rng(3)
    rows = [(f"s{rng.integers(4)}", int(19000 + rng.integers(300)), float(rng.integers(0, 900)) / 8) for _ in range(250)]
    rows += [("s1", 19003, 0.0)] * 3 + [(None, 19000, 1.0), ("s1", None, 1.0), ("s1", 19100, None), ("s2", 19900, 2.0), ("only", 5, 1.5), ("old", -400, 1.0), ("old", -300, 2.0), ("nan", 3, float("nan")), ("inf", 3, float("inf"))]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "sym string, d int, v double, tile int, n int, total int")
    got = rolling_totals(df, "sym", "d", "v", windows, tile_days=tile, pack=2).collect()
    assert {(r.sym, r.day): [x for w in windows for x in (r[f"n_{w}"], round(r[f"sum_{w}"], 6))] for r in got} == brute(rows, windows)
    assert len(got) == len(brute(rows, windows))
    for r in got:
        n, s = r[f"n_{windows[1]}"], r[f"sum_{windows[1]}"]
        assert r[f"avg_{windows[1]}"] == (s / n if n else None)


def test_no_rows(spark):
    assert rolling_totals(spark.createDataFrame([], "a string, d int, v double"), "a", "d", "v").count() == 0
    with pytest.raises(ValueError):
        rolling_totals(spark.createDataFrame([], "a string, d int, v double"), "a", "d", "v", (0,))


def test_day_numbers_are_days(spark):
    r = spark.sql("select 20240105 as x").select(calendar_day(F.col("x")).alias("d")).first()
    assert r.d == (dt.date(2024, 1, 5) - dt.date(1970, 1, 1)).days
