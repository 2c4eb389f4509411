import numpy as np
import pytest

from millrace.operators.regrid import regrid

COLS = "station string, time bigint, temp int, kind string, pid int, cell int, source string, value double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3.0) for r in rows], COLS)


def brute(rows, step, hold, low, high):
    out = {}
    for s in {r[0] for r in rows if None not in r}:
        own = sorted((t, v) for a, t, v in rows if a == s and t is not None and v is not None)
        cells = {c: [0, 0.0, 0] for c in range(own[0][0] // step, own[-1][0] // step + 1)}
        for k, (t, v) in enumerate(own):
            cells[t // step][2] += 1
            end = min(own[k + 1][0] if k + 1 < len(own) else (t // step + 1) * step, t + hold)
            if low <= v <= high:
                for c in range(t // step, (end - 1) // step + 1 if end > t else t // step):
                    sec = min(end, (c + 1) * step) - max(t, c * step)
                    cells[c][0] += sec
                    cells[c][1] += sec * v
        for c, (sec, w, n) in cells.items():
            out[s, c * step] = (round(w / sec, 6) if sec else None, round(sec / step, 6), n, "read" if n else "held" if sec else "missing")
    return out


def test_grid_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in ("a", "b", "hot"):
        t = -5000 + int(rng.integers(9000))
        for _ in range(600 if s == "hot" else 60):
            t += int(rng.choice([0, 60, 700, 3600, 4000, 40000]))
            rows.append((s, t, int(rng.choice([10, 20, 30, 9999]))))
    rows += rows[:20] + [(None, 5, 5), ("a", None, 5), ("a", 7, None), ("one", 3700, 4), ("bad", 10, -9999), ("bad", 9000, -9999)]
    got = regrid(frame(spark, rows), "station", "time", "temp", 3600, 10800, -900, 600, partitions=7).collect()
    mine = {(r.station, r.slot): (None if r.value is None else round(r.value, 6), round(r.coverage, 6), r.n_readings, r.state) for r in got}
    assert len(mine) == len(got)
    assert mine == brute(rows, 3600, 10800, -900, 600)


def test_no_rows(spark):
    assert regrid(frame(spark, []), "station", "time", "temp").count() == 0
    assert regrid(frame(spark, [(None, 1, 1), ("a", None, 1)]), "station", "time", "temp").count() == 0


def test_long_silence_is_marked(spark):
    got = regrid(frame(spark, [("a", 0, 10), ("a", 3600 * 100 + 5, 30)]), "station", "time", "temp", hold=7200).orderBy("slot").collect()
    assert [r.state for r in got] == ["read", "held", *["missing"] * 98, "read"]
    assert got[-1].value == 30 and got[-1].coverage == pytest.approx(3595 / 3600)
