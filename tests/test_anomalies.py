import numpy as np
import pytest

from millrace.operators.anomalies import esd_limits, excursions, implausible, limit_of_run

COLS = "station string, time bigint, temp int, kind string, runs int, tile int, reason string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], COLS)


def series(n, seed, step=600, base=100, amplitude=80):
    rng = np.random.default_rng(seed)
    t = 1_700_000_000 + np.cumsum(rng.integers(step - 30, step + 30, n))
    return t, np.rint(base + amplitude * np.sin(2 * np.pi * t / 86400) + np.cumsum(rng.normal(0, 1.5, n)) + rng.normal(0, 2, n)).astype(int)


def test_esd_limits_of_the_literature():
    # Rosner's example: n = 54, alpha = 0.05
    assert esd_limits(54, 3, 0.05) == pytest.approx([3.159, 3.151, 3.144], abs=0.01)


def test_limit_of_run():
    assert limit_of_run(1000, 0.02) == 8
    assert 14 <= limit_of_run(600, 0.4) <= 16


def test_excursions_and_lasting_changes():
    t, x = series(900, 1)
    x = x.astype(float)
    clean = excursions(t, x, 3, 0.001, 1.2, 0.7, 2.0)
    assert not clean.any()
    y = x.copy()
    y[300] += 150
    y[500:503] -= [160, 140, 120]
    y[700:] += 150  # a lasting step
    marked = np.flatnonzero(excursions(t, y, 3, 0.001, 1.2, 0.7, 2.0))
    assert marked.tolist() == [300, 500, 501, 502]


def test_planted_cases_are_found_over_partitions_and_tiles(spark):
    rows, want = [], set()
    for k, s in enumerate(["a", "b", "hot"]):
        n = 4000 if s == "hot" else 500
        t, x = series(n, k + 2)
        for i in range(40, n - 60, 180):
            x[i] += 200
            want.add((s, int(t[i]), "spike"))
        for i in range(100, n - 60, 500):
            x[i : i + 14] = x[i]
            x[i - 1] += x[i - 1] == x[i]  # else the run is longer than planted
            x[i + 14] += x[i + 14] == x[i]
            want |= {(s, int(a), "frozen") for a in t[i : i + 14]}
        x[20] = 9999
        want.add((s, int(t[20]), "range"))
        rows += [(s, int(a), int(b)) for a, b in zip(t, x)]
    rows += rows[:50] + [(None, 1, 1), ("a", None, 1), ("a", 1_700_000_100, None), ("few", 5, 10), ("few", 6, 400)]
    got = implausible(frame(spark, rows), "station", "time", "temp", -900, 600, tile=256, halo=64, partitions=9).collect()
    found = {(r.station, r.time, r.reason) for r in got}
    assert len(found) == len(got)
    assert {x for x in want if x[2] != "spike"} == {x for x in found if x[2] != "spike"}
    spikes, hit = {x for x in want if x[2] == "spike"}, {x for x in found if x[2] == "spike"}
    assert len(spikes & hit) >= 0.9 * len(spikes) and len(hit - spikes) <= 2


def test_a_null_does_not_break_a_run_and_one_run_may_fill_many_partitions(spark):
    rows = [("s", 600 * k, 50) for k in range(3000)] + [("s", 600 * 1500 + 1, None)] + [("s", -600 * k, k % 37 + 100) for k in range(1, 900)]
    got = implausible(frame(spark, rows), "station", "time", "temp", -900, 600, partitions=8).where("reason = 'frozen'").count()
    assert got == 3000


def test_no_rows(spark):
    assert implausible(frame(spark, []), "station", "time", "temp", -900, 600).count() == 0
    assert implausible(frame(spark, [(None, 1, 1), ("a", None, None)]), "station", "time", "temp", -900, 600).count() == 0
