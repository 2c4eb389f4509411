"""Splitting oversized items at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import tokens as tok

#: Kinds of boundary from weakest to strongest.
KINDS = ("token", "space", "line", "paragraph", "cell", "end")
#: Where cell starts aren't given: marks of scripts, sessions, tagged cells and notebook JSON.
CELL_MARK = re.compile(r"^(?:# ?%%|In ?\[[ \d]*\]:|Out ?\[[ \d]*\]:|<cell\b|<\w+ cell\b|\[\w+ cell\b)|\{\s*\"cell_type\"", re.M)
PARAGRAPH = re.compile(r"\n[ \t\r]*(?=\n)")
#: A line of the text, or of a source string inside JSON.
LINE = re.compile(r"\n|(?<=\\n\",)|(?<=\\n)(?=\")")


def _white(text: str) -> np.ndarray:
    """Which characters are white space."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.flatnonzero(np.bincount(codes, minlength=1))
    return np.isin(codes, [c for c in seen.tolist() if chr(c).isspace()])


def boundaries(text: str, starts: list[int] | None, token_ends: np.ndarray, white: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places (in characters) where the text may be cut, ascending, and their kinds. token_ends: places where a token and a character end.

    A place after white space is moved to the end of the last non-blank before it, however far that is: a cut there leaves tokens as they are, and the white space leads the next piece.
    """
    n = len(text)
    cells = np.array(sorted({s for s in starts if s is not None and 0 < s < n}) if starts else [m.start() for m in CELL_MARK.finditer(text) if m.start()], np.int64)
    paragraphs = np.array([m.start() for m in PARAGRAPH.finditer(text)], np.int64)
    lines = np.array([m.start() for m in LINE.finditer(text)], np.int64)
    solid = np.concatenate([[0], np.maximum.accumulate(np.where(white, 0, np.arange(1, n + 1)))])  # for each place the end of the last non-blank before it
    level = np.zeros(n + 1, np.int8)
    level[token_ends] = 1
    level[np.flatnonzero(white[1:] & ~white[:-1]) + 1] = 2
    for places, kind in ((lines, 3), (paragraphs, 4), (cells, 5)):
        at = solid[places]
        at = at[at > 0]
        level[at] = np.maximum(level[at], kind)
    level[0], level[n] = 0, 6
    at = np.flatnonzero(level)
    return at, level[at].astype(int) - 1


def cuts_by_doubling(successor: np.ndarray) -> np.ndarray:
    """The nodes on the way from node 0 to the last node, given each node's successor: the table is squared until it leads from 0 to the end."""
    path, jump, end = np.array([0]), successor, len(successor) - 1
    while path[-1] != end:
        path = np.union1d(path, jump[path])
        jump = jump[jump]
    return path


def split(text: str, starts: list[int] | None, limit: int, overlap: int, path: str = tok.RANKS, fill: float = 0.5) -> list[tuple[int, int, int, str]]:
    """Pieces (start, end, tokens, kind of the boundary at the end) of a text; one piece if it is within the limit. Places are in characters.

    Every piece, tokenised on its own, has at most ``limit`` tokens. The strongest of cell, paragraph and line that leaves a piece at least ``fill`` full is taken,
    the farthest of that kind; where none does, the farthest of the three that is more than the overlap on, and only without such a one a blank or a token's end. A piece begins ``overlap`` tokens (or, inside a character, the least number more) before the end of the piece before it.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    ids = tok.encode(text, path)
    if len(ids) <= limit:
        return [(0, len(text), len(ids), "end")]
    ends = np.cumsum(tok.encoder(path)[1][ids])  # in bytes
    if len(text) == ends[-1]:
        place, whole = ends, np.ones(len(ends), bool)
    else:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        begins = np.append((raw & 0xC0) != 0x80, True)
        place, whole = np.concatenate([[0], np.cumsum(begins[:-1])])[ends], begins[ends]
    place_of = np.concatenate([[0], place])  # characters that begin before the end of the k-th token
    whole = np.concatenate([[True], whole])
    back = np.maximum.accumulate(np.where(whole, np.arange(len(whole)), 0))  # the last token end that is a character's end
    white = _white(text)
    at, kind = boundaries(text, starts, place[whole[1:]], white)
    at = np.concatenate([[0], at[at > 0]])
    kind = np.concatenate([[0], kind[-(len(at) - 1) :]])
    full = place_of[back]
    lo = back[np.searchsorted(full, at, side="right") - 1]  # tokens that end at or before the place, without those that end inside the next character
    hi = np.searchsorted(place_of, at, side="left")  # tokens needed to get there
    begin = back[np.maximum(lo - overlap, 0)]  # token at which a piece begins that follows a cut here
    begin[0] = 0
    edge = (at == 0) | (at == len(text))
    safe = edge | (~white[np.maximum(at - 1, 0)] & white[np.minimum(at, len(text) - 1)])
    safe_at, safe_lo = at[safe], lo[safe]
    for slack in (8, 32, 128, limit // 4, limit // 2):
        successor = _successors(lo, hi, kind, begin, limit - slack, int(fill * limit))
        nodes = cuts_by_doubling(successor)
        pieces = []
        for a, b in zip(nodes[:-1].tolist(), nodes[1:].tolist(), strict=True):
            s, e = int(place_of[begin[a]]) if a else 0, int(at[b])
            pieces.append((s, e, _tokens(text, s, e, safe_at, safe_lo, path), KINDS[kind[b]]))
        if all(p[2] <= limit for p in pieces):
            return pieces
    return _by_trial(text, limit, overlap, path)


def _by_trial(text: str, limit: int, overlap: int, path: str) -> list[tuple[int, int, int, str]]:
    """Pieces of a text whose tokens change so much where it is cut that no slack was enough: one after the other, each shortened until it is within the limit on its own."""
    pieces, s, n = [], 0, len(text)
    while True:
        e = min(n, s + limit)  # a character is a token at least, or part of one
        while (k := tok.count(text[s:e], path)) > limit:
            e = s + max(1, (e - s) * limit // (k + 1))
        pieces.append((s, e, k, "end" if e == n else "token"))
        if e == n:
            return pieces
        s = max(s + 1, e - overlap)


def _successors(lo: np.ndarray, hi: np.ndarray, kind: np.ndarray, begin: np.ndarray, most: int, least: int) -> np.ndarray:
    """Joins every boundary to its farthest legal successor: the strongest natural kind first, at least ``least`` tokens on; then any natural one
    with which the next piece begins later; then a blank at least ``least`` on; otherwise whatever is farthest."""
    n = len(lo)
    reach = np.searchsorted(hi, begin + most, side="right") - 1  # the farthest boundary of any kind
    out = np.maximum(reach, np.minimum(np.arange(n) + 1, n - 1))
    undecided = out < n - 1
    natural, blank = KINDS.index("line"), KINDS.index("space")
    steps = [(kind == k, least) for k in range(len(KINDS) - 2, natural - 1, -1)] + [((kind >= natural) & (kind < len(KINDS) - 1), None), (kind == blank, least)]
    for some, on in steps:
        own = np.flatnonzero(some)
        if len(own):
            last = np.searchsorted(own, reach, side="right") - 1
            candidate = own[np.maximum(last, 0)]
            enough = begin[candidate] > begin if on is None else lo[candidate] - begin >= on
            take = undecided & (last >= 0) & (candidate > np.arange(n)) & enough
            out[take] = candidate[take]
            undecided &= ~take
    return out


def _tokens(text: str, s: int, e: int, at: np.ndarray, lo: np.ndarray, path: str) -> int:
    """Tokens of text[s:e] on its own: only what lies outside the first and last safe boundary is tokenised again."""
    g, h = np.searchsorted(at, s), np.searchsorted(at, e, side="right") - 1
    if h <= g:
        return tok.count(text[s:e], path)
    return tok.count(text[s : at[g]], path) * (s < at[g]) + int(lo[h] - lo[g]) + tok.count(text[at[h] : e], path) * (at[h] < e)


def split_items(df: DataFrame, ident: str, text: str, starts: str | None, limit: int = 4096, overlap: int = 128, path: str = tok.RANKS, carry_text: bool = True) -> DataFrame:
    """Pieces of every item of more than ``limit`` tokens: ``ident, piece, start_at, end_at, n_tokens, boundary, text``.

    piece counts from 0; start_at and end_at are characters; boundary is the kind of place at which the piece ends (cell, paragraph, line, space, token,
    or the item's end). starts: a column of arrays of places where the item's parts (cells) begin; null or missing ones are found by marks.

    Method: per item, every boundary is joined to its farthest legal successor, overlap included, and the successor table is squared until all greedy cuts are derived,
    so that the rounds grow with the logarithm of the number of pieces. Items are independent rows; a token is at least a byte, so what has no more bytes than ``limit`` is skipped unread.

    Defined results: null and empty texts and items within the limit have no pieces; items with a null or repeated ident are split like others, each row on its own. Whole texts
    are tokenised, in parts that don't change the tokens. Extra columns are left out; output names don't depend on them.
    """
    cells = F.col(f"`{starts}`").cast("array<int>") if starts else F.lit(None).cast("array<int>")
    long = df.where(F.octet_length(F.col(f"`{text}`")) > limit).select(F.col(f"`{ident}`").alias("__i"), F.col(f"`{text}`").alias("__t"), cells.alias("__c"))
    schema = T.StructType(
        [T.StructField(ident, df.schema[ident].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start_at", T.LongType()), T.StructField("end_at", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("boundary", T.StringType()), *([T.StructField("text", T.StringType())] if carry_text else [])]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                whole = b.column(1)[r].as_py()
                pieces = split(whole, b.column(2)[r].as_py(), limit, overlap, path)
                if len(pieces) > 1:
                    k = len(pieces)
                    cols = [b.column(0).take(pa.array([r] * k)), pa.array(range(k), pa.int32()), *(pa.array([p[j] for p in pieces], t) for j, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.int32()), (3, pa.string())))]
                    if carry_text:
                        cols.append(pa.array([whole[p[0] : p[1]] for p in pieces], pa.string()))
                    yield pa.RecordBatch.from_arrays(cols, schema.names)

    return long.mapInArrow(run, schema)
