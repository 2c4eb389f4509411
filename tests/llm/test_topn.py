import numpy as np
import pytest

from millrace.llm.topn import top_n

COLS = "user int, movie int, rating int, pid int, gid int, place int, position int, offset int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], COLS)


def brute(rows, n):
    best = {}
    for u, m, r in rows:
        if (u, m) not in best or best[u, m] is None or (r is not None and r > best[u, m]):
            best[u, m] = r
    out = set()
    for u in {u for u, _ in best}:
        own = sorted(((m, r) for (v, m), r in best.items() if v == u), key=lambda x: (x[1] is None, -(x[1] or 0), x[0] is None, x[0] or 0))
        out |= {(u, m, r, k + 1) for k, (m, r) in enumerate(own[:n])}
    return out


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_equals_brute_force(spark, partitions):
    rng = np.random.default_rng(2)
    rows = [(7 if k % 3 == 0 else int(rng.integers(40)), int(rng.integers(300)), int(rng.integers(1, 6))) for k in range(3000)]
    rows += rows[:100] + [(None, 1, 5), (None, 2, 5), (3, None, 5), (4, 5, None), (4, 5, 2), (99, 1, None), (99, 2, None)]
    got = top_n(frame(spark, rows), "user", "movie", "rating", 5, partitions=partitions).collect()
    assert {(r.user, r.movie, r.rating, r.position) for r in got} == brute(rows, 5)
    assert len(got) == len(brute(rows, 5))


def test_one_group_of_ties_over_many_partitions(spark):
    rows = [(1, k, 3) for k in range(2000)]
    for n in (1, 5, 1999, 2500):
        got = sorted(r.movie for r in top_n(frame(spark, rows), "user", "movie", "rating", n, partitions=12).collect())
        assert got == list(range(min(n, 2000)))


def test_names_and_nothing(spark):
    out = top_n(frame(spark, [(1, 2, 3)]), "position", "movie", "rating", 1)
    assert out.columns == ["position", "movie", "rating", "position_1"]
    assert top_n(frame(spark, []), "user", "movie", "rating", 5).count() == 0
    with pytest.raises(ValueError):
        top_n(frame(spark, []), "user", "movie", "rating", 0)
