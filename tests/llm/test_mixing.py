import pytest
from pyspark.sql import functions as F

from millrace.llm.mixing import Node, mix, reachable_total, share_out, tidy

RECORDS = "doc bigint, source string, lang string, n bigint, whole int, rest double, o int, times int, pid int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0, 3, 4, 5) for r in rows], RECORDS)


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shortage_goes_to_siblings_before_others():
    a = Node(0.5, children={"x": Node(0.9, 10, 1), "y": Node(0.1, 1000, 1)})
    b = Node(0.5, children={"z": Node(1.0, 1000, 1)})
    share_out([a, b], 400)
    assert (a.budget, b.budget) == (200, 200)
    assert (a.children["x"].budget, a.children["y"].budget) == (10, 190)
    c = Node(0.5, children={"x": Node(1.0, 10, 2)})
    share_out([c, b], 400)
    assert (c.budget, b.budget) == (20, 380)
    share_out([c, b], 10**9)
    assert (c.budget, b.budget) == (20, 1000)
    assert reachable_total([c, b, Node(0.3)]) == 40


def test_shares_repeats_and_report(spark):
    rows = [(k, "big", "en" if k % 3 else None, 10 + k % 7) for k in range(3000)] + [(k, "small", "en", 20) for k in range(10_000, 10_050)] + [(1, None, "en", 5), (2, "other", "en", 5), (None, "big", "en", 5), (3, "big", "en", 0)]
    uses, report = mix(frame(spark, rows), targets(spark, [("big", 0.7, 1), ("small", 0.2, 3), ("none", 0.1, 2)]), "doc", "source", "lang", "n")
    got = {r.source: r for r in report.collect()}
    assert got["none"].mixed_tokens == 0 and got["none"].n_records == 0
    assert got["small"].mixed_tokens == 3000 and got["small"].most_times == 3
    assert got["big"].actual_share == pytest.approx(7 / 9, abs=0.005) and got["big"].most_times == 1
    used = uses.collect()
    assert sum(r.n * r.times for r in used) == sum(r.mixed_tokens for r in got.values())
    assert all(r.doc is not None and r.source in ("big", "small") for r in used)
    assert len({r.doc for r in used}) == len(used)


def test_given_total_and_same_choice_again(spark):
    rows = [(k, f"s{k % 2}", "en", 10) for k in range(400)]
    t = targets(spark, [("s0", 0.25, 1), ("s1", 0.75, 2)])
    first, report = mix(frame(spark, rows), t, "doc", "source", "lang", "n", total=3000.0)
    again, _ = mix(frame(spark, rows).repartition(9), t, "doc", "source", "lang", "n", total=3000.0)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    assert {r.source: r.mixed_tokens for r in report.collect()} == {"s0": 750, "s1": 2250}
    assert {r.times for r in first.where("source = 's1'").collect()} == {1, 2}


def test_nothing_and_bad_targets(spark):
    uses, report = mix(frame(spark, []), targets(spark, [("a", 1.0, 1)]), "doc", "source", "lang", "n")
    assert uses.count() == 0 and report.first().actual_share == 0.0
    for bad in ([("a", None, 1)], [("a", 0.5, 1), ("a", 0.5, 1)], [(None, 1.0, 1)]):
        with pytest.raises(ValueError):
            mix(frame(spark, []), targets(spark, bad), "doc", "source", "lang", "n")


def test_tidy(spark):
    got = spark.createDataFrame([(x,) for x in ["EN", " en-x ", "und", "", None, "lab_share "]], "s string").select(tidy(F.col("s")).alias("t")).collect()
    assert [r.t for r in got] == ["en", "en", None, None, None, "lab_share"]


def test_an_epoch_counts_all_targets(spark, tmp_path):
    from millrace.llm.queries import p8_shares_epoch

    docs = [(k, "word " * 9, "en", f"s{k}") for k in range(1500)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    targets(spark, [(f"s{k}", 1 / 1500, 2) for k in range(1500)]).write.parquet(f"{tmp_path}/source_targets.parquet")
    got = p8_shares_epoch(spark, str(tmp_path)).collect()
    assert len(got) == 1500 and all(r.budget_tokens == pytest.approx(r.available_tokens) for r in got)


def test_tree_of_any_depth(spark):
    rows = [(k, "a", "rare", 10) for k in range(20)] + [(1000 + k, "a", "large", 10) for k in range(200)] + [(2000 + k, "b", "large", 10) for k in range(200)] + [(3000 + k, "c", "large", 10) for k in range(20)] + [(4000 + k, "d", "large", 10) for k in range(200)]
    df = frame(spark, rows).withColumn("leaf", F.struct("lang", (F.col("doc") % 2).alias("half")))
    t = spark.createDataFrame([("a", 0.25, 1, "x"), ("b", 0.25, 1, "x"), ("c", 0.25, 1, "y"), ("d", 0.25, 1, "y")], "source string, target_share double, max_repeats int, domain string")
    uses, report = mix(df, t, "doc", "source", "leaf", "n", total=3200.0, domain="domain", weigh=lambda path, held: 1.0 if len(path) == 2 else held)
    # c runs short: its domain makes up for it; a's rare language runs short: the other one makes up for it, by halves
    assert {r.source: r.mixed_tokens for r in report.collect()} == {"a": 800, "b": 800, "c": 200, "d": 1400}
    got = {(r.lang, r.half): r.n for r in uses.where("source = 'a'").groupBy("leaf.lang", "leaf.half").agg(F.sum(F.col("n") * F.col("times")).alias("n")).collect()}
    assert got == {("rare", 0): 100, ("rare", 1): 100, ("large", 0): 300, ("large", 1): 300}
