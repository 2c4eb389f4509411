from pyspark.sql import functions as F

from millrace.functions import nonempty as ne


def cases():
    A, B = F.col("a"), F.col("b")
    return {
        "flat_map": (ne.flat_map(A, lambda x: F.array(x, x * 10)), [3, 30, 1, 10, 2, 20]), "ap": (ne.ap(A, lambda x: x + 1, lambda x: -x), [4, 2, 3, -3, -1, -2]), "append": (ne.append(A, B), [3, 1, 2, 7, 8]),
        "prepend": (ne.prepend(F.lit(9), A), [9, 3, 1, 2]), "first": (ne.first(A), 3), "last": (ne.last(A), 2), "tail": (ne.tail(A), [1, 2]), "init": (ne.init(A), [3, 1]), "zip": (ne.zip_(A, B), [(3, 7), (1, 8)]),
        "zip_all": (ne.zip_all(A, B, F.lit(0), F.lit(0)), [(3, 7), (1, 8), (2, 0)]), "zip_with_index": (ne.zip_with_index(B), [(7, 0), (8, 1)]), "filter": (ne.filter_(A, lambda x: x > 1), [3, 2]), "filter_not": (ne.filter_not(A, lambda x: x > 1), [1]),
        "collect": (ne.collect(A, lambda x: x > 1, lambda x: x * 2), [6, 4]), "find": (ne.find(A, lambda x: x < 3), 1), "find none": (ne.find(A, lambda x: x > 9), None), "collect_first": (ne.collect_first(A, lambda x: x < 3, lambda x: x + 5), 6),
        "partition": (ne.partition(A, lambda x: x > 2), ([3], [1, 2])), "index_where": (ne.index_where(A, lambda x: x < 3), 1), "no index": (ne.index_where(A, lambda x: x > 9), -1), "index_of": (ne.index_of(A, F.lit(2)), 2), "index_of none": (ne.index_of(A, F.lit(9)), -1),
        "take_while": (ne.take_while(A, lambda x: x > 2), [3]), "drop_while": (ne.drop_while(A, lambda x: x > 2), [1, 2]), "drop_while all": (ne.drop_while(A, lambda x: x > 0), []), "span": (ne.span(A, lambda x: x > 2), ([3], [1, 2])), "take": (ne.take(A, F.lit(2)), [3, 1]),
        "take many": (ne.take(A, F.lit(9)), [3, 1, 2]), "take none": (ne.take(A, F.lit(-1)), []), "drop": (ne.drop(A, F.lit(2)), [2]), "slice": (ne.slice_(A, F.lit(1), F.lit(3)), [1, 2]), "pad_to": (ne.pad_to(A, F.lit(5), F.lit(0)), [3, 1, 2, 0, 0]),
        "fold_left": (ne.fold_left(A, F.lit(10), lambda x, y: x - y), 4), "reduce_left": (ne.reduce_left(A, lambda x, y: x - y), 0), "scan_left": (ne.scan_left(A, F.lit(0), lambda x, y: x + y), [0, 3, 4, 6]), "scan_left1": (ne.scan_left1(A, lambda x, y: x + y), [3, 4, 6]),
        "for_all": (ne.for_all(A, lambda x: x > 0), True), "exists": (ne.exists(A, lambda x: x > 2), True), "count": (ne.count(A, lambda x: x > 1), 2), "contains": (ne.contains(A, F.lit(1)), True), "same": (ne.same_elements(A, A), True), "not same": (ne.same_elements(A, B), False),
        "single": (ne.single(F.lit(4)), [4]), "many": (ne.many(F.lit(4), F.lit(5)), [4, 5]), "from": (ne.counted_from(F.lit(4), F.lit(3)), [4, 5, 6]), "iterate": (ne.iterate(F.lit(1), lambda x: x * 2, 4), [1, 2, 4, 8]),
        "map_values": (ne.map_values(ne.association(F.lit("k"), A), lambda x: x + 1), ("k", [4, 2, 3])), "bimap": (ne.bimap(ne.association(F.lit("k"), B), F.upper, lambda x: -x), ("K", [-7, -8])),
        "zip_assoc": (ne.zip_associations(ne.association(F.lit("k"), A), ne.association(F.lit("k"), B)), ("k", [(3, 7), (1, 8)])), "product_key": (ne.product_key(ne.association(F.lit("k"), B), ne.association(F.lit("j"), B)), (("k", "j"), [(7, 7), (7, 8), (8, 7), (8, 8)])),
    }


def plain(x):
    return [plain(y) for y in x] if isinstance(x, list) else tuple(map(plain, x)) if isinstance(x, tuple) else x


def test_functions(spark):
    df = spark.createDataFrame([([3, 1, 2], [7, 8])], "a array<int>, b array<int>")
    row = df.select(*[c.alias(k) for k, (c, _) in cases().items()]).first().asDict()
    assert {k: plain(v) for k, v in row.items()} == {k: v for k, (_, v) in cases().items()}


def test_null_arrays(spark):
    row = spark.createDataFrame([(None,)], "a array<int>").select(ne.index_where(F.col("a"), lambda x: x > 1).alias("i"), ne.take(F.col("a"), F.lit(1)).alias("t"), ne.find(F.col("a"), lambda x: x > 1).alias("f")).first()
    assert tuple(row) == (None, None, None)
