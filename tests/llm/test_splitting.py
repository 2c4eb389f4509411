import random

import numpy as np
import pytest

from millrace.llm import tokens as tok
from millrace.llm.splitting import cuts_by_doubling, split, split_items

WORDS = "alpha beta don't naïve x1 == (y) 3.14 日本 längst\t\t foo_bar ''' ,".split(" ")


def text(seed, n=3000):
    r = random.Random(seed)
    return "".join(r.choice(WORDS) + r.choice([" ", " ", " ", "\n", "\n\n", "  ", "\n    "]) for _ in range(n))


def check(t, starts, limit, overlap):
    pieces = split(t, starts, limit, overlap)
    ids = tok.encode(t)
    if len(ids) <= limit:
        assert pieces == [(0, len(t), len(ids), "end")]
        return pieces
    assert pieces[0][0] == 0 and pieces[-1][1] == len(t)
    whole = "".join(t[max(a, prev) : b] for (a, b, _, _), prev in zip(pieces, [0, *[p[1] for p in pieces[:-1]]], strict=True))
    assert whole == t
    for p in pieces:
        assert tok.count(t[p[0] : p[1]]) == p[2] <= limit
    for p, q in zip(pieces, pieces[1:]):
        assert q[0] < p[1] < q[1]
        assert overlap <= tok.count(t[q[0] : p[1]]) + 2 and tok.count(t[q[0] : p[1]]) <= overlap + 6
    return pieces


@pytest.mark.parametrize("seed", range(6))
def test_pieces_cover_and_overlap(seed):
    check(text(seed), None, 300, 20)
    check(text(seed), [100, 2000, 5000, None, 10**9, 0], 300, 20)


@pytest.mark.parametrize("t", ["a" * 20000, "日本語" * 3000, "\n" * 9000, " " * 9000 + "x", "x " * 5000, "é" * 4000 + "\n\n" + "b" * 4000, "", "z", "😀" * 2500])
def test_texts_without_boundaries(t):
    check(t, None, 200, 16)


def test_cells_are_preferred():
    cell = "# %%\n" + "print('hello world')\n" * 60
    pieces = check(cell * 8, None, 1000, 50)
    assert {p[3] for p in pieces[:-1]} == {"cell"}


def test_doubling_follows_successors():
    succ = np.array([2, 2, 5, 4, 6, 6, 6])
    assert cuts_by_doubling(succ).tolist() == [0, 2, 5, 6]


def test_chunks_do_not_change_tokens(monkeypatch):
    t = text(9)
    whole = tok.encode(t).tolist()
    monkeypatch.setattr(tok, "_CHUNK", 500)
    assert tok.encode(t).tolist() == whole and tok.count(t) == len(whole)


def test_items(spark):
    rows = [(1, text(1), [50, 700]), (2, "short", None), (3, None, None), (4, "", []), (None, text(2), None), (5, text(1), None), (5, text(1), None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc bigint, text string, starts array<int>, piece int, boundary int")
    got = split_items(df, "doc", "text", "starts", 300, 20).collect()
    assert {r.doc for r in got} == {1, None, 5}
    for r in got:
        assert r.text == (text(2) if r.doc is None else text(1))[r.start_at : r.end_at] and r.n_tokens <= 300
    assert sorted(r.piece for r in got if r.doc == 1) == list(range(sum(r.doc == 1 for r in got)))
    assert sum(r.doc == 5 for r in got) == 2 * len(split(text(1), None, 300, 20))
    assert split_items(df.limit(0), "doc", "text", None).count() == 0


def test_counts(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, "")], "id int, text string")
    assert {r.id: r.n_tokens for r in tok.with_token_counts(df, "text", ["id"]).collect()} == {1: 3, 2: 0, 3: 0}


@pytest.mark.parametrize("blob", ["QUJD" * 4000, "0.125 " * 3000])
def test_lines_before_a_huge_line_end_a_piece(blob):
    lines = "".join(f"value_{k} = load({k})\n" for k in range(12))
    pieces = check(lines + blob + "\n" + lines, None, 300, 20)
    at = len(lines) - 1
    assert (pieces[0][1], pieces[0][3]) == (at, "line") and tok.count(lines[:at]) < 150


def test_pieces_between_boundaries_are_as_long_as_can_be():
    for p in check("x" + "ab1" * 30000, None, 300, 20)[:-1]:
        assert p[2] >= 300 - 8 - 6


def test_long_blanks_before_a_boundary_are_not_cut():
    t = "".join(f"line {k} of the text" + " " * (600 if k % 5 == 0 else 1) + "\n" for k in range(400))
    for p in check(t, None, 1000, 20)[:-1]:
        assert p[3] == "line" and not t[p[1] - 1].isspace()


def test_every_boundary_is_in_the_table():
    from millrace.llm.splitting import _white, boundaries

    t = "ab cd  ef\n\ngh ij"
    at, kind = boundaries(t, None, np.array([2, 5, 9, 10, 13, 16]), _white(t))
    assert at.tolist() == [2, 5, 9, 10, 13, 16] and kind.tolist() == [1, 1, 3, 0, 1, 5]


def test_trial_pieces_are_within_the_limit():
    from millrace.llm.splitting import _by_trial

    for t in ("a" * 3000, text(3), "😀" * 900, "日本語" * 900, " " * 2000):
        pieces = _by_trial(t, 100, 8, tok.RANKS)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(t) and all(tok.count(t[p[0] : p[1]]) == p[2] <= 100 for p in pieces)
        assert all(q[0] <= p[1] and q[1] > p[1] for p, q in zip(pieces, pieces[1:]))
