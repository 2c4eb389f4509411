"""Evaluation texts leaking into training text: template windows, slots and passages in order."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.tokens import chunks
from millrace.operators.ordered import groups
from millrace.operators.skew import skew_join
from millrace.session import cut

#: Words of a window (a shingle).
WINDOW = 5
#: Words of a window that must not be placeholders for it to stand as a template. A window with fewer of them is taken by its own words instead, and again as far as that many such words reach.
CONTENT = 3
#: The most words that a window is drawn out to.
REACH = 25
#: A window that an item repeats more often is paired by its ordinal, and by its own words besides.
REPEATS = 8
#: Windows of items up to which their table is broadcast (some hundred bytes each); with more it is a shuffle join that splits frequent windows.
BROADCAST_WINDOWS = 200_000
#: Bitmaps have at least 64 bits for each entry, but never more than this; beyond it they let more through and lose nothing.
MOST_BITS = 28

_TAG = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>")
_UNICODE = re.compile(r"\\+u([0-9a-f]{4})")
_ESCAPE = re.compile(r"\\+[nrt]")
#: Scripts that put no spaces between words; each of their characters counts as a word.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
_APART = "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED)
_WORD = re.compile(rf"(?![_{_APART}])\w(?:(?![_{_APART}])\w)*|(?!_)[{_APART}](?<=\w)")
#: A word in capitals' case inside a sentence: behind a word or a comma, or behind an underscore.
_NAME = regex.compile(r"(?<=[\p{Ll}\p{Lo},;:] )\p{Lu}\p{Ll}+|(?<=_)\p{Lu}\p{Ll}+")
#: A word right behind a number, in the same line.
_UNIT = regex.compile(r"\p{N}[\p{N}.,]* ?(\p{L}[\p{L}\p{M}]*)")

# What a word is, in the last three bits of its code: a word of the items' own, a typed placeholder, or a word that no item has (which may stand for a name).
PLAIN, NUMBER, NAME, UNIT, UNKNOWN = range(5)


def bare(text: str) -> str:
    """A text in lower case without escapes, entities and tags."""
    text = text.lower()
    if "\\" in text:
        text = _UNICODE.sub(lambda m: chr(int(m[1], 16)).lower(), text)
        text = _ESCAPE.sub(" ", text)
    if "&" in text:
        text = html.unescape(text).lower()
    if "<" in text:
        text = _TAG.sub(" ", text)
    return text


def words(text: str) -> list[str]:
    """Words of a text without letter case, spacing, punctuation, escapes, entities, tags and comment marks."""
    return _WORD.findall(bare(text))


def passage(text: str | None) -> str:
    """An item's text behind its first line, the stock instruction; a text of a single line is all passage."""
    head, newline, rest = (text or "").partition("\n")
    return rest if newline else head


_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)
_tables: dict = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, ..., base ** n modulo 2 ** 64."""
    have = _tables.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n, 1 << 17), base, np.uint64)
        have = _tables[base] = np.concatenate([np.ones(1, np.uint64), np.cumprod(steps)])
    return have


def _classes() -> np.ndarray:
    """Of every character: 0 no part of words, 1 part of a word, 2 a word of its own; 4 more for digits and other numerals."""
    if "classes" not in _tables:
        out = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            if chr(c).isalnum():
                out[c] = 1 + 4 * chr(c).isnumeric()
        for a, b in UNSPACED:
            out[a : b + 1] += (out[a : b + 1] > 0).astype(np.uint8)
        _tables["classes"] = out
    return _tables["classes"]


def _letters() -> np.ndarray:
    if "letters" not in _tables:
        _tables["letters"] = _mixed(np.arange(0x110000, dtype=np.uint64) + _MIX)
    return _tables["letters"]


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of stretches, from running sums of hashes times powers: the same for the same stretch wherever it stands."""
    return (sums[end] - sums[start]) * _powers(_BACK, len(sums))[start]


def windows_of_five(sums: np.ndarray) -> np.ndarray:
    """``spans`` of the five words from each word on."""
    return (sums[WINDOW:] - sums[:-WINDOW]) * _powers(_BACK, len(sums))[: len(sums) - WINDOW]


def running(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(_BASE, len(values))[: len(values)], out=out[1:])
    return out


def own_sums(codes: np.ndarray) -> np.ndarray:
    """Running sums for windows by their own words."""
    return running(codes.astype(np.uint64) ^ _MIX)


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """61-bit hashes of a text's words, in one go over its characters, and which words begin with a numeral."""
    codes = np.frombuffer(bare(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    kind = _classes()[codes]
    inside, own = kind & 3 > 0, kind & 3 == 2
    joint = inside[1:] & inside[:-1]  # the character belongs to the word of the one before
    if own.any():
        joint &= ~own[1:] & ~own[:-1]
    edge = inside.copy()
    edge[1:] &= ~joint
    start = np.flatnonzero(edge)
    edge = inside
    edge[:-1] &= ~joint
    end = np.flatnonzero(edge) + 1
    return spans(running(_letters()[codes]), start, end) >> np.uint64(3), kind[start] & 4 > 0


#: Characters that are brought to words at a time, so that arrays stay in the processor's cache.
_PART = 1 << 14


def all_word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    parts = [word_hashes(x) for x in chunks(text, _PART)]
    return parts[0] if len(parts) == 1 else (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


class Marks:
    """Flags of 61-bit hashes in a table of bytes: a hash may show flags of another one too, but never lacks its own."""

    def __init__(self, entries: int) -> None:
        self.bits = int(min(MOST_BITS - 2, max(16, np.ceil(np.log2(64 * max(1, entries))))))
        self.held = np.zeros(1 << self.bits, np.uint8)

    def put(self, h: np.ndarray, k: int) -> None:
        self.held[(h >> np.uint64(61 - self.bits)).astype(np.int64)] |= np.uint8(1 << k)

    def of(self, h: np.ndarray) -> np.ndarray:
        return self.held[(h >> np.uint64(61 - self.bits)).astype(np.int64)]


class Bits:
    """A set of 61-bit hashes as a bitmap: it may hold more than was put in, never less."""

    def __init__(self, entries: int) -> None:
        self.bits = int(min(MOST_BITS, max(16, np.ceil(np.log2(64 * max(1, entries))))))
        self.held = np.zeros(1 << (self.bits - 3), np.uint8)
        self.empty = True

    def put(self, h: np.ndarray) -> None:
        at = (h >> np.uint64(61 - self.bits)).astype(np.int64)
        np.bitwise_or.at(self.held, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        self.empty = self.empty and not len(h)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(61 - self.bits)).astype(np.int64)
        return (self.held[at >> 3] >> (at & 7)) & 1 > 0

    def places(self, h: np.ndarray) -> np.ndarray:
        """Which of the hashes are there."""
        return np.zeros(0, np.int64) if self.empty else np.flatnonzero(self.has(h))


def put_all(rows: DataFrame, put: Callable[[np.ndarray, int], None]) -> None:
    """Puts hashes (h, k) into a table; they pass through the driver in pieces and only the table stays."""
    held: dict[int, list[int]] = {}
    for n, r in enumerate(rows.toLocalIterator(), 1):
        held.setdefault(r.k, []).append(r.h)
        if n % 100_000 == 0:
            for k, h in held.items():
                put(np.array(h, np.uint64), k)
            held = {}
    for k, h in held.items():
        put(np.array(h, np.uint64), k)


#: What a word is by its flags: known, name, unit.
_KIND = np.array([UNKNOWN if not f & 1 else NAME if f & 2 else UNIT if f & 4 else PLAIN for f in range(8)], np.int64)


def coded(h: np.ndarray, number: np.ndarray, marks: Marks) -> np.ndarray:
    """Codes of words: their hash, and what they are in the last three bits."""
    return ((h.astype(np.int64) & ((1 << 60) - 1)) << 3) | np.where(number, NUMBER, _KIND[marks.of(h)])


def canonical(codes: np.ndarray) -> np.ndarray:
    """Codes with numbers, names and units replaced by typed placeholders; words that no item has stand for names."""
    kind = codes & 7
    return np.where(kind == PLAIN, codes, np.where(kind == UNKNOWN, NAME, kind))


def ordinals(h: np.ndarray, at: np.ndarray, far: int) -> np.ndarray:
    """For each window the how manyth of its hash it is, counted anew after a step of more than ``far`` words."""
    order = np.lexsort((at, h))
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (np.diff(at[order]) > far)]) if len(h) else np.zeros(0, bool)
    place = np.arange(len(h))
    out = np.empty(len(h), np.int64)
    out[order] = place - np.maximum.accumulate(np.where(new, place, 0)) if len(h) else place
    return out


def nth(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The hash of the n-th window of a hash."""
    return _mixed(h + _MIX * (n.astype(np.uint64) + np.uint64(1))) >> np.uint64(3)


def template_windows(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, hash, whether by its own words) of the windows of a text.

    A window of five words, three of which are no placeholders, is hashed with its placeholders. Of another one its own words are hashed; and drawn out to the third word that is no placeholder, if it isn't
    farther than ``REACH`` words, it is hashed with its placeholders again: so rows of numbers have templates as well, and no window is left out.
    """
    n = len(codes) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(bool)
    full, long, reach = _shapes(codes)
    general = running(canonical(codes).astype(np.uint64))
    h = np.concatenate([np.where(full, windows_of_five(general), windows_of_five(own_sums(codes))), spans(general, long, reach)]) >> np.uint64(3)
    return np.concatenate([np.arange(n), long]), np.concatenate([np.full(n, WINDOW), reach - long]), h, np.concatenate([~full, np.zeros(len(long), bool)])


def _shapes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows of five are templates; the first words of those that are drawn out, and where these end."""
    plain = codes & 7 == PLAIN
    upto = np.concatenate([[0], np.cumsum(plain)])
    full = upto[WINDOW:] - upto[:-WINDOW] >= CONTENT
    at = np.flatnonzero(~full)
    where = np.append(np.flatnonzero(plain), np.full(CONTENT, 1 << 60))
    reach = where[np.minimum(upto[at] + CONTENT - 1, len(where) - 1)] + 1
    ok = reach - at <= REACH
    return full, at[ok], reach[ok]


def exact_windows(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows of five that begin at these words, by their own words."""
    return spans(own_sums(codes), at, at + WINDOW) >> np.uint64(3)


def packed(codes: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """The codes of windows, as a binary column."""
    upto = np.cumsum(size)
    rows = codes[np.repeat(at - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]
    return pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.concatenate([[0], upto]) * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def item_windows(codes: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, hash) of the windows by which an item is sought: one that it repeats often stands with its ordinal, and by its own words (again with its ordinal, if these are repeated often too)."""
    first, size, h, exact = template_windows(codes)
    _, which, times = np.unique(h, return_inverse=True, return_counts=True)
    often = times[which] > REPEATS
    out = [(first[~often], size[~often], h[~often]), (first[often], size[often], nth(h[often], ordinals(h[often], first[often], far)))]
    again = np.flatnonzero(often & ~exact & (size == WINDOW))
    if len(again):
        g = exact_windows(codes, first[again])
        _, which, times = np.unique(g, return_inverse=True, return_counts=True)
        many = times[which] > REPEATS
        out += [(first[again[~many]], size[again[~many]], g[~many]), (first[again[many]], size[again[many]], nth(g[many], ordinals(g[many], first[again[many]], far)))]
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def text_windows(codes: np.ndarray, there: Bits, often: Bits, far: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, hash) of the windows of a text that may be an item's. often: hashes that items have with ordinals."""
    if len(codes) < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    full, long, reach = _shapes(codes)
    general, three = running(canonical(codes).astype(np.uint64)), np.uint64(3)
    out, many = [], []
    # only stretches of words that items have can be an item's by their own words
    strange = np.concatenate([[0], np.cumsum(codes & 7 == UNKNOWN)])
    five, own = np.flatnonzero(full), np.flatnonzero(strange[WINDOW:] == strange[:-WINDOW])
    for first, end, h in ((five, five + WINDOW, general), (own, own + WINDOW, own_sums(codes)), (long, reach, general)):
        h = spans(h, first, end) >> three
        for found, keep in ((there, out), (often, many)):
            at = found.places(h)
            keep.append((first[at], end[at] - first[at], h[at]))
    again = tuple(np.concatenate([m[k] for m in many]) for k in range(3))
    if len(again[0]):
        g = nth(again[2], ordinals(again[2], again[0], far))
        ok = there.has(g)
        out.append((again[0][ok], again[1][ok], g[ok]))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def chains(doc: np.ndarray, item: np.ndarray, far: int) -> Iterator[np.ndarray]:
    """Matches (word of the text, word of the item): of each stretch without a step over ``far`` words of the text, which of them make the most that can be kept with both ascending."""
    order = np.lexsort((-item, doc))
    doc, item = doc[order], item[order]
    for a, b in _stretches(doc, far):
        tails: list[int] = []
        ends: list[int] = []
        back = np.full(b - a, -1)
        for k in range(a, b):
            p = bisect_left(tails, item[k])
            back[k - a] = ends[p - 1] if p else -1
            if p == len(tails):
                tails.append(int(item[k]))
                ends.append(k - a)
            else:
                tails[p], ends[p] = int(item[k]), k - a
        k, chain = ends[-1] if ends else -1, []
        while k >= 0:
            chain.append(k + a)
            k = int(back[k])
        yield order[np.array(chain[::-1], int)]


def in_order(doc: np.ndarray, item: np.ndarray, far: int) -> tuple[int, np.ndarray]:
    """The longest of the chains: how many matches, and which."""
    best = max(chains(doc, item, far), key=len)
    return len(best), best


def _faithful(doc: np.ndarray, item: np.ndarray, equal: np.ndarray, slot: np.ndarray, slots_equal: float) -> np.ndarray:
    """Which matches lie in runs of one shift between text and item, of at least two windows' equal words, whose own slots agree."""
    shift = doc - item
    order = np.lexsort((doc, shift))
    new = (np.diff(shift[order]) != 0) | (np.diff(doc[order]) > 2 * WINDOW)
    run = np.zeros(len(doc), np.int64)
    run[order] = np.concatenate([[0], np.cumsum(new)])
    slots, agreed, words_ = (np.bincount(run, weights=w) for w in (slot, slot & equal, equal))
    return np.flatnonzero(((slots > 0) & (agreed >= slots_equal * slots) & (words_ >= 2 * WINDOW))[run])


def verdict(doc: np.ndarray, item: np.ndarray, has: np.ndarray, own: np.ndarray, slot: np.ndarray, length: int, least: float, template: float, slots_equal: float, far: int) -> tuple[float, float, float, str] | None:
    """(share, template_share, slot_agreement, kind) of a text and an item, or None. doc, item: places of the words that some matched windows bring together; has, own: their codes; slot: whether the item's word is one.

    Every stretch of the text is judged on its own, as a whole and by its runs of agreeing slots only, so that a look-alike does not hide a passage that stands beside it; the best verdict holds.
    """
    equal = has == own
    order = np.argsort(doc, kind="stable")
    same, changed = [], []
    for a, b in _stretches(doc[order], far):
        whole = order[a:b]
        for rows in (whole, whole[_faithful(doc[whole], item[whole], equal[whole], slot[whole], slots_equal)]):
            if len(rows) < least * length:
                continue
            e = rows[equal[rows]]
            share = in_order(doc[e], item[e], far)[0] / length
            every, chain = in_order(doc[rows], item[rows], far)
            chain = rows[chain]
            inside = chain[slot[chain]]
            agree = float(np.mean(equal[inside])) if len(inside) else 1.0
            if share >= least and agree >= slots_equal:
                same.append((share, every / length, agree, "same"))
            elif every / length >= template:
                values: dict[int, set] = {}
                for u, v in zip(own[chain].tolist(), has[chain].tolist(), strict=True):
                    values.setdefault(u, set()).add(v)
                if all(len(v) == 1 for v in values.values()):
                    changed.append((share, every / length, agree, "reparameterised"))
    return max(same) if same else max(changed, key=lambda r: r[1]) if changed else None


def _stretches(doc: np.ndarray, far: int) -> Iterator[tuple[int, int]]:
    edge = np.concatenate([[0], np.flatnonzero(np.diff(doc) > far) + 1, [len(doc)]])
    return zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)


def _vocabulary(items: DataFrame) -> DataFrame:
    """(h, k) of the items' words: k is 0 for every word, 1 for names (in capitals' case inside a sentence half of the time at least), 2 for units (behind a number a third of the time at least)."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("h", "n", "name", "unit")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, n, name, unit = [], [], [], []
            for x in b.column(1):
                body = passage(x.as_py())
                own = all_word_hashes(body)[0]
                named, behind = [word_hashes(w)[0] for w in _NAME.findall(body)], [word_hashes(w)[0][:1] for w in _UNIT.findall(body)]
                h += [own, *named, *behind]
                sizes = [len(own), sum(map(len, named)), sum(map(len, behind))]
                for out, k in ((n, 0), (name, 1), (unit, 2)):
                    out.append(np.repeat(np.arange(3) == k, sizes).astype(np.int64))
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (h, n, name, unit)], schema.names)

    found = items.mapInArrow(run, schema).groupBy("h").agg(F.sum("n").alias("n"), F.sum("name").alias("name"), F.sum("unit").alias("unit"))
    kinds = F.array(F.lit(0), F.when(F.col("name") * 2 >= F.col("n"), 1), F.when(F.col("unit") * 3 >= F.col("n"), 2))
    return found.select("h", F.explode(F.array_compact(kinds)).alias("k"))


def _marks(rows: DataFrame) -> Marks:
    rows = cut(rows)
    marks = Marks(rows.where("k = 0").count())
    put_all(rows, marks.put)
    return marks


def _bitmaps(rows: DataFrame, n: int) -> list[Bits]:
    rows = cut(rows)
    sizes = dict(rows.groupBy("k").count().collect())
    bits = [Bits(sizes.get(k, 0)) for k in range(n)]
    put_all(rows, lambda h, k: bits[k].put(h))
    return bits


def leaks(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, least: float = 1 / 3, template: float = 2 / 3, slots_equal: float = 0.6, far: int = 300, broadcast: int = BROADCAST_WINDOWS) -> DataFrame:
    """Pairs of text and leaked item: ``doc_id, item_id, share, template_share, slot_agreement, kind``.

    share: part of the item's words that stand in the text in the item's order, steps of at most ``far`` words of the text between neighbours (a passage may go on in a nearby cell).
    template_share: the same with numbers, names and units taken as equal; slot_agreement: part of these slots that do hold the item's own value.
    kind ``same``: share is at least ``least`` and slot_agreement at least ``slots_equal`` (look-alikes share a template's words but not its slots). kind ``reparameterised``: it is not that, but
    template_share is at least ``template`` and each value of the item is replaced by the same value wherever it occurs.

    Method: texts and items are brought to words; numbers, names and units become typed placeholders, by rule: a word that begins with a numeral, one that the items write as a name half of the time or behind a number a third of the
    time at least, and in texts one that no item has. Windows are hashed (see ``template_windows``: no window is left out) and joined by hash; windows of texts that can't be an item's are dropped before by a bitmap
    of bounded size. What a join brings together is one text's words beside one item's; the slots of the matched windows then
    decide which words really are equal. Each stretch of the text without a step over ``far`` words is judged by its longest ascending chains, and again by those of its runs whose own slots agree;
    the pair is reported if one of them is a leak, with the figures of the one of greatest share.

    Skew: items of equal words are sought once and expanded at the end; a window that an item repeats is paired by its ordinal, so a text of repetitions meets it once for each of its words at most. With more than
    ``broadcast`` windows of items their table is not broadcast: the join is one that splits windows which many texts have, windows that many items share are brought in only for pairs that agree in
    others too (see ``_met_by_rare_windows``; none that could be a leak is lost), and a text's part with one item is a key of its own.

    Defined results: null and empty texts have no pairs, nor have items of fewer than five words (a character of a script without spaces is a word). Items with equal passages are both reported.
    A repeated or null doc_id is a text of its own each time, so a pair may then occur twice. Texts of any length are read whole. Extra columns are left out.
    """
    spark = docs.sparkSession
    items = items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{item_text}`").alias("text"))
    vocabulary = spark.sparkContext.broadcast(_marks(_vocabulary(items)))
    item_kind, doc_kind = items.schema["item"].dataType, docs.schema[doc_id].dataType

    def codes_of(text: str) -> np.ndarray:
        return coded(*all_word_hashes(text), vocabulary.value)

    # items of equal words are one passage
    member_schema = T.StructType([T.StructField("item", item_kind), T.StructField("passage", T.BinaryType()), T.StructField("codes", T.BinaryType())])

    def members_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [codes_of(passage(x.as_py())).tobytes() for x in b.column(1)]
            ok = pa.array([len(r) >= 8 * WINDOW for r in raw], pa.bool_())
            key = [np.frombuffer(r, np.uint64) for r in raw]
            key = [bytes(np.array([_mixed(running(k)[-1:])[0], _mixed(running(k ^ _MIX)[-1:])[0]], np.uint64).tobytes()) for k in key]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key, pa.binary()), pa.array(raw, pa.binary())], member_schema.names).filter(ok)

    members = cut(items.mapInArrow(members_of, member_schema))
    i_schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("plain", T.BooleanType()), T.StructField("passage", T.BinaryType()), T.StructField("ik", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("of", T.IntegerType()), T.StructField("item_words", T.BinaryType())])

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, k = TaskContext.get().partitionId(), 0
        for b in batches:
            for r in range(b.num_rows):
                raw = np.frombuffer(b.column(1)[r].as_py(), np.int64)
                first, size, h = item_windows(raw, far)
                n, k = len(h), k + 1
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(np.ones(n, bool)), b.column(0).take(pa.array([r] * n)), pa.array(np.full(n, (pid << 32) + k)), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(np.full(n, len(raw), np.int32)), packed(raw, first, size)], i_schema.names)
                # the hashes of which this item has ordinals
                often = np.unique(np.concatenate([_often(raw, False), _often(raw, True)]))
                m = len(often)
                if m:
                    zero = pa.array(np.zeros(m, np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(often.astype(np.int64)), pa.array(np.zeros(m, bool)), b.column(0).take(pa.array([r] * m)), pa.array(np.zeros(m, np.int64)), zero, zero, zero, pa.array([b""] * m, pa.binary())], i_schema.names)

    everything = cut(members.groupBy("passage").agg(F.first("codes").alias("codes")).mapInArrow(windows_of, i_schema))
    windows = everything.where("plain").drop("plain")
    bitmap = spark.sparkContext.broadcast(_bitmaps(everything.select("h", F.when(F.col("plain"), 0).otherwise(1).alias("k")).distinct(), 2))
    d_schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc", doc_kind), T.StructField("pos", T.IntegerType()), T.StructField("dh", T.LongType()), T.StructField("doc_words", T.BinaryType())])

    def doc_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            for r in range(b.num_rows):
                row += 1
                if not b.column(1)[r].is_valid:
                    continue
                raw = codes_of(b.column(1)[r].as_py())
                first, size, h = text_windows(raw, *bitmap.value, far)
                n = len(h)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row)), b.column(0).take(pa.array([r] * n)), pa.array(first.astype(np.int32)), pa.array(h.astype(np.int64)), packed(raw, first, size)], d_schema.names)

    hits = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{doc_text}`")).mapInArrow(doc_windows, d_schema)
    few = windows.limit(broadcast + 1).count() <= broadcast
    columns = ["row", "ik", "doc", "pos", "doc_words", "passage", "at", "of", "item_words"]
    if few:
        met = hits.join(F.broadcast(windows), F.col("dh") == F.col("h")).select(*columns)
    else:
        met = _met_by_rare_windows(cut(hits), windows, least, columns)
    if not few:  # else a text's rows still follow one another
        met = met.repartition("row", "ik").sortWithinPartitions("row", "ik")
    out = T.StructType([T.StructField("doc", doc_kind), T.StructField("passage", T.BinaryType()), T.StructField("share", T.DoubleType()), T.StructField("template_share", T.DoubleType()), T.StructField("slot_agreement", T.DoubleType()), T.StructField("kind", T.StringType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 1 if few else 2):
            g = g.filter(pa.array(np.equal(*(_sizes(g.column(k)) for k in (4, 8)))))  # windows of other sizes only share a hash
            if not g.num_rows:
                continue
            ik, pos, at, of = (g.column(k).to_numpy().astype(np.int64) for k in (1, 3, 6, 7))
            size = _sizes(g.column(4))
            a, b = (np.frombuffer(b"".join(g.column(k).to_pylist()), np.int64) for k in (4, 8))
            inner = np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size)
            p, i, from_ = np.repeat(pos, size) + inner, np.repeat(at, size) + inner, np.repeat(np.arange(len(ik)), size)
            _, which = np.unique(ik, return_inverse=True)
            # words of each item that some window covers, and those of them that are equal: an upper bound that settles most pairs
            span = int((at + size).max())
            key = which[from_] * span + i
            covered, same_ = np.zeros((int(which.max()) + 1) * span, bool), np.zeros((int(which.max()) + 1) * span, bool)
            covered[key] = True
            same_[key[a == b]] = True
            length = np.zeros(int(which.max()) + 1)
            length[which] = of
            by = lambda x: x.reshape(-1, span).sum(1) / length
            wanted = (by(same_) >= least) | (by(covered) >= template)
            order = np.argsort(which[from_], kind="stable")
            bounds = np.searchsorted(which[from_][order], np.arange(len(length) + 1))
            for w in np.flatnonzero(wanted).tolist():
                rows = order[bounds[w] : bounds[w + 1]]
                _, once = np.unique(p[rows] * (1 << 24) + i[rows], return_index=True)
                rows = rows[once]
                found_ = verdict(p[rows], i[rows], a[rows], b[rows], b[rows] & 7 != PLAIN, int(length[w]), least, template, slots_equal, far)
                if found_:
                    r = int(from_[rows[0]])
                    yield pa.RecordBatch.from_arrays([g.column(2).slice(r, 1), g.column(5).slice(r, 1), *(pa.array([v]) for v in found_)], out.names)

    found = met.mapInArrow(judge, out).withColumnRenamed("passage", "p")
    ids = members.select("passage", "item")
    ids = F.broadcast(ids) if few else ids
    return found.join(ids, F.col("p") == F.col("passage")).select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "share", "template_share", "slot_agreement", "kind")


def _met_by_rare_windows(hits: DataFrame, windows: DataFrame, least: float, columns: list[str]) -> DataFrame:
    """Windows of texts beside equal windows of items, for all pairs of which anything but an item's commonest windows agrees.

    An item's windows that most items have are put aside, the commonest first, as long as together they cover less of it than the part ``least``: a pair in which only they agree is no leak whatever they say,
    so nothing is lost. The rest meets the texts' windows in a join that splits frequent ones; to the pairs that come of it, the windows put aside are then brought back.
    """
    common = windows.groupBy(F.col("h").alias("ch")).agg(F.count_distinct("ik").alias("items"))
    counted = skew_join(windows, common, "h", "ch").drop("ch").repartition("ik").sortWithinPartitions("ik", F.col("items").desc(), "h", "at")
    schema = T.StructType([*windows.schema.fields, T.StructField("aside", T.BooleanType())])
    names = schema.names

    def put_aside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups((b.select(["ik", *(c for c in b.schema.names if c != "ik")]) for b in batches), 1):
            col = {c: g.column(k) for k, c in enumerate(g.schema.names)}
            at, size, items, of = (col[c].to_numpy().astype(np.int64) for c in ("at", "size", "items", "of"))
            covered, aside = np.zeros(int(of[0]), bool), np.zeros(g.num_rows, bool)
            h = col["h"].to_numpy()
            bounds = np.append(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])), len(h))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):  # all windows of one hash at once
                more = covered.copy()
                for k in range(a, b):
                    more[at[k] : at[k] + size[k]] = True
                if items[a] < 2 or more.sum() >= least * of[0]:
                    break
                covered = more
                aside[a:b] = True
            yield pa.RecordBatch.from_arrays([*(col[c] for c in names[:-1]), pa.array(aside)], names)

    marked = cut(counted.mapInArrow(put_aside, schema))
    met = cut(skew_join(hits, marked.where("not aside"), "dh", "h").select(*columns))
    pairs = met.select("row", "ik").distinct()
    often = marked.where("aside").select(F.col("h").alias("oh"), "passage", F.col("ik").alias("oik"), "at", "of", "item_words")
    wanted = skew_join(pairs, often, "ik", "oik").withColumnRenamed("row", "prow")
    back = hits.join(wanted, (F.col("row") == F.col("prow")) & (F.col("dh") == F.col("oh"))).select(*columns)
    return met.unionByName(back)


def _sizes(words_: pa.Array) -> np.ndarray:
    """Words of packed windows."""
    return np.diff(np.frombuffer(words_.buffers()[1], np.int32)[words_.offset : words_.offset + len(words_) + 1]).astype(np.int64) // 8


def _often(codes: np.ndarray, own: bool) -> np.ndarray:
    """Hashes of windows that an item repeats so often that it has them with ordinals; own: those of windows by their own words."""
    first, size, h, exact = template_windows(codes)
    hashes, which, times = np.unique(h, return_inverse=True, return_counts=True)
    if not own:
        return hashes[times > REPEATS]
    again = first[(times[which] > REPEATS) & ~exact & (size == WINDOW)]
    hashes, times = np.unique(exact_windows(codes, again), return_counts=True)
    return hashes[times > REPEATS]
