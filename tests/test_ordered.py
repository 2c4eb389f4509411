import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.operators.ordered import any_changed, chain, changed, edges, fresh, groups, numbered, with_offsets


def test_changed_treats_nulls_and_nan_as_equal():
    a = pa.array([None, None, 1.0, 1.0, float("nan"), float("nan"), None])
    assert changed(a, None).tolist() == [True, False, True, False, True, False, True]
    assert changed(a, a[6]).tolist() == [False, False, True, False, True, False, True]
    assert any_changed([pa.array([1, 1]), pa.array(["a", "b"])], None).tolist() == [True, True]


def test_fresh_ignores_case():
    assert fresh(["PID", "pid_1"], "pid") == "pid_2"


def test_groups_joins_batches():
    t = pa.table({"k": [1, 1, 2, 2, 2, 3], "v": range(6)})
    parts = t.slice(0, 1).to_batches() + t.slice(1, 2).to_batches() + t.slice(3, 3).to_batches()
    assert [g.column(1).to_pylist() for g in groups(iter(parts), 1)] == [[0, 1], [2, 3, 4], [5]]


def positions(spark, rows, amount=None, partitions=7):
    df = spark.createDataFrame(rows, "g string, o int, w bigint")
    out, at = numbered(df, ["g"], [F.col("o").asc_nulls_first()], amount=amount, partitions=partitions)
    out, off = with_offsets(out, chain(edges(out, ["g"], at["pid"], at["gid"], F.lit(1) if amount is None else F.col(amount))), at["pid"], at["gid"])
    return out.select("g", "o", "w", (F.col(at["place"]) + F.col(off)).alias("x"))


def test_positions_over_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(None if k % 17 == 0 else "hot" if k % 3 else f"g{k % 11}", k, int(rng.integers(1, 9))) for k in range(2000)]
    got = positions(spark, rows).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.o):
        by.setdefault(r.g, []).append(r.x)
    assert sum(map(len, by.values())) == 2000
    assert all(v == list(range(1, len(v) + 1)) for v in by.values())


def test_running_sums_over_partitions(spark):
    rows = [("hot" if k % 3 else f"g{k % 5}", k, k % 7) for k in range(1500)]
    want, run = {}, {}
    for g, o, w in rows:
        run[g] = run.get(g, 0) + w
        want[o] = run[g]
    assert {r.o: r.x for r in positions(spark, rows, "w").collect()} == want


def test_nothing(spark):
    assert positions(spark, []).count() == 0
