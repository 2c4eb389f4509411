import json
import random

import numpy as np
import pytest

from millrace.llm.leakage import in_order, leaks, words

NOUNS = "lantern kettle harbor meadow sparrow copper window garden ledger bucket pillow cedar violin marble tunnel orchard".split()
VERBS = "lifts paints guards follows sorts carries mixes rents".split()


def passage(seed, n=6):
    r = random.Random(seed)
    return " ".join(f"The {r.choice(NOUNS)} of {r.choice(['Orda', 'Tavel', 'Kamar', 'Wengol'])} {r.choice(VERBS)} {r.randint(10, 99)} {r.choice(NOUNS)}s while the {r.choice(NOUNS)} {r.choice(VERBS)} a {r.choice(NOUNS)}." for _ in range(n))


FILLER = "We load the table and plot a histogram of every column before fitting the first model to it. "
ITEM = "Read the passage and answer.\n"


def found(spark, docs, items, kind="same"):
    d = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in docs], "doc bigint, text string, item int, share int, pos int")
    i = spark.createDataFrame([(k, t, 1) for k, t in items], "id bigint, body string, h int")
    return sorted(((r.doc, r.id) for r in leaks(d, i, "doc", "text", "id", "body").where(f"kind = '{kind}'").collect()), key=str)


def test_words_see_through_layouts():
    want = "each dry kettle held 3 060 sacks".split()
    for t in ["Each dry kettle held 3.060 sacks", "# EACH DRY\n# KETTLE held 3.060 sacks", "<div><b>Each</b> dry <em>kettle</em>\n held 3.060 sacks</div>", json.dumps("Each dry\nkettle held \t3.060 sacks"), json.dumps(json.dumps("Each dry\nkettle held 3.060 sacks")), "['Each', 'dry', 'kettle', 'held', '3.060', 'sacks']", "&quot;Each&quot; dry kettle held 3.060 sacks", "\\u0045ach dry kettle held 3.060 sacks"]:
        assert words(t) == want


def test_in_order():
    doc, item = np.array([1, 2, 3, 4, 900, 901]), np.array([5, 1, 2, 3, 4, 5])
    assert in_order(doc, item, 300)[0] == 3
    assert in_order(doc, item, 1000)[0] == 5


def test_leaks_in_many_shapes(spark):
    items = [(k, ITEM + passage(k)) for k in range(4)]
    p = passage(0)
    w = p.split(" ")
    changed = " ".join(x if k % 19 else "other" for k, x in enumerate(w))
    docs = [
        (0, FILLER * 3 + p + FILLER), (1, FILLER + p.upper().replace(" ", "\n# ")), (2, json.dumps({"source": [x + "\n" for x in p.split(". ")]})), (3, FILLER + " ".join(w[: len(w) // 2]) + FILLER), (4, " ".join(f"<b>{x}</b>" for x in w)),
        (5, FILLER + changed), (6, FILLER + " ".join(w[: len(w) // 2]) + "\nIn [3]:" + FILLER * 4 + " ".join(w[len(w) // 2 :])), (7, repr(w)), (10, FILLER * 20), (11, ITEM * 5), (12, " ".join(w[:9])), (13, None), (14, ""), (15, passage(77)), (16, passage(78) + passage(79)), (None, p), (17, p), (17, p),
        (18, FILLER * 20000 + p),
    ]
    got = found(spark, docs, items)
    assert got == sorted([(k, 0) for k in (0, 1, 2, 3, 4, 5, 6, 7, None, 17, 17, 18)], key=str)


def test_copies_short_and_empty_items(spark):
    items = [(1, ITEM + passage(1)), (2, ITEM + passage(1).upper()), (3, ITEM + "too short"), (4, None), (5, ""), (6, passage(2))]
    assert found(spark, [(1, passage(1)), (2, passage(2)), (3, "too short")], items) == [(1, 1), (1, 2), (2, 6)]


def test_changed_values_are_reported_as_such(spark):
    p = passage(5)
    numbers = {x for x in p.split() if x.isdigit()}
    other = p
    for x in numbers:
        other = other.replace(f" {x} ", f" 5{x} ")
    for a, b in (("Orda", "Zulpin"), ("Tavel", "Brimo"), ("Kamar", "Quell"), ("Wengol", "Ysolt")):
        other = other.replace(a, b)
    assert found(spark, [(1, other)], [(1, ITEM + p)], "reparameterised") == [(1, 1)]
    assert found(spark, [(1, other)], [(1, ITEM + p)]) == []


@pytest.mark.parametrize(("docs", "items"), [([], [(1, ITEM + "x " * 50)]), ([(1, "a b c d e f g")], []), ([], [])])
def test_nothing(spark, docs, items):
    assert found(spark, docs, items) == []


def look_alike(text):
    """The same words with other names and numbers."""
    for a, b in (("Orda", "Zulpin"), ("Tavel", "Brimo"), ("Kamar", "Quell"), ("Wengol", "Ysolt")):
        text = text.replace(a, b)
    return " ".join(str(int(x) % 89 + 110 + k) if x.isdigit() else x for k, x in enumerate(text.split(" ")))


@pytest.mark.parametrize("apart", [0, 1, 6, 25])
@pytest.mark.parametrize("part", ["first", "last"])
def test_look_alike_does_not_hide_a_passage(spark, apart, part):
    p = passage(5)
    w = p.split(" ")
    half = " ".join(w[: len(w) // 2] if part == "first" else w[len(w) // 2 :])
    gap = " " + FILLER * apart
    docs = [(1, half), (2, look_alike(p)), (3, half + gap + look_alike(p)), (4, look_alike(p) + gap + half), (5, look_alike(p) + gap + look_alike(p))]
    assert found(spark, docs, [(1, ITEM + p)]) == [(1, 1), (3, 1), (4, 1)]


# --- numbers, scripts without spaces, repetitions

HAN = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜金生丽水玉出昆冈剑号巨阙珠称夜光果珍李柰菜重芥姜海咸河淡鳞潜羽翔"


def rows_of_numbers(seed, rows=40):
    r = random.Random(seed)
    return "\n".join(f"row {k} value {r.randint(0, 999)} {r.randint(0, 999)} {r.random():.4f}" for k in range(rows))


def unspaced(seed, n=120):
    r = random.Random(seed)
    return "".join(r.choice(HAN) for _ in range(n))


def only_numbers(seed, n=150):
    r = random.Random(seed)
    return " ".join(str(r.randint(0, 99_999)) for _ in range(n))


def other_numbers(text, by=7):
    """Each number replaced by another one, the same wherever it stands."""
    import re

    return re.sub(r"\d+", lambda m: str(int(m[0]) * 3 + by), text)


KINDS = {"ordinary": passage, "rows of numbers": rows_of_numbers, "unspaced": unspaced, "only numbers": only_numbers}


@pytest.mark.parametrize("broadcast", [0, 200_000])
@pytest.mark.parametrize("kind", KINDS)
def test_copies_of_every_kind_of_text(spark, kind, broadcast):
    make = KINDS[kind]
    items = [(k, ITEM + make(k)) for k in range(6)]
    docs = [(k, FILLER * 2 + make(k) + "\n" + FILLER) for k in range(6)] + [(10 + k, FILLER + make(k)[len(make(k)) // 2 :]) for k in range(6)] + [(20 + k, make(100 + k)) for k in range(6)]
    d = spark.createDataFrame(docs, "doc bigint, text string")
    i = spark.createDataFrame(items, "id bigint, body string")
    got = {(r.doc, r.id) for r in leaks(d, i, "doc", "text", "id", "body", broadcast=broadcast).where("kind = 'same'").collect()}
    assert got == {(k, k) for k in range(6)} | {(10 + k, k) for k in range(6)}


@pytest.mark.parametrize("kind", ["ordinary", "rows of numbers"])
def test_other_values_in_every_kind_of_text(spark, kind):
    text = KINDS[kind](3)
    assert found(spark, [(1, FILLER + other_numbers(text) + FILLER)], [(1, ITEM + text)], "reparameterised") == [(1, 1)] or kind == "ordinary"
    if kind == "ordinary":
        assert found(spark, [(1, look_alike(text))], [(1, ITEM + text)]) == []


def test_unspaced_text_with_other_values(spark):
    text = "某商店有12个苹果和7个梨，小明买了3个苹果，又买了2个梨，请问商店还剩下多少水果，小明一共拿走多少水果，列出算式并写出答案"
    assert found(spark, [(1, FILLER + text)], [(1, ITEM + text)]) == [(1, 1)]
    other = text.replace("12", "95").replace("7", "48").replace("3", "26").replace("2个", "11个")
    got = found(spark, [(1, FILLER + other)], [(1, ITEM + text)]) + found(spark, [(1, FILLER + other)], [(1, ITEM + text)], "reparameterised")
    assert got == [(1, 1)]


def test_a_passage_of_repetitions_in_a_long_log(spark):
    log = "\n".join(f"row {k} value {k * 7919 % 100_003} {k % 13} 0 0 0 0 0 0" for k in range(30_000))
    lines = log.split("\n")
    items = [(1, ITEM + "\n".join(lines[20_000:20_060])), (2, ITEM + "0 " * 200), (3, ITEM + "\n".join(f"row {k} value {k * 31 % 97} 5 0 0 0 0 0 0" for k in range(60)))]
    docs = [(1, log), (2, FILLER + "0 " * 90 + FILLER), (3, FILLER)]
    got = found(spark, docs, items)
    assert (1, 1) in got and (2, 2) in got and not [p for p in got if p[0] == 3 or p == (2, 1)]


def test_words_at_once_are_the_words_one_by_one():
    from millrace.llm.leakage import _mixed, running, spans, word_hashes

    rng = random.Random(3)
    alphabet = list("ab Z_9.,;\n\t\\n&lt;<b>é日本ไทยß½٣́​😀") + ["\\u0041", "&amp;", "<div>", "</p>", "ﬁ", "ｱ"]
    for _ in range(300):
        t = "".join(rng.choice(alphabet) for _ in range(60))
        h, number = word_hashes(t)
        own = words(t)
        assert len(h) == len(own)
        assert [int(word_hashes(w)[0][0]) for w in own] == h.tolist() if own else True
        assert number.tolist() == [w[0].isnumeric() for w in own]
    assert len({int(word_hashes(str(k))[0][0]) for k in range(20_000)}) == 20_000
    x = np.arange(50, dtype=np.uint64)
    s = running(np.concatenate([x, x]))
    assert spans(s, np.array([3]), np.array([9])) == spans(s, np.array([53]), np.array([59])) and _mixed(x).dtype == np.uint64


def test_many_windows_and_a_frequent_one(spark):
    # more windows of items than are broadcast, and one stretch of words that all texts and items have
    stock = "the committee of the northern province has approved the annual budget for the repair of roads"

    def own(seed, n=30):
        r = random.Random(seed)
        return " ".join("".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(n))

    items = [(k, f"{ITEM}{own(k)} {stock} {own(1000 + k, 20)}") for k in range(300)]
    docs = [(k, f"{FILLER}{stock}. {own(k) if k % 10 == 0 else FILLER}") for k in range(300)]
    d, i = spark.createDataFrame(docs, "doc bigint, text string"), spark.createDataFrame(items, "id bigint, body string")
    got = sorted((r.doc, r.id) for r in leaks(d, i, "doc", "text", "id", "body", broadcast=1000).where("kind = 'same'").collect())
    assert got == [(k, k) for k in range(0, 300, 10)]
