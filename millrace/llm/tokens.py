"""Sizes in tokens of a public tokenizer (byte-level BPE from a file of ranks)."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the tokenizer files; every operator takes the file's path as a parameter.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that goes with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[str, tuple] = {}
#: A token never holds a white-space character after another character, so a text may be cut before such a white space without changing its tokens.
_SAFE = re.compile(r"\S(?=\s)")
_CHUNK = 1 << 16


def encoder(path: str) -> tuple:
    """The encoder of a file of ranks and the byte length of each token, loaded once per process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            lengths[rank] = len(piece)
        _loaded[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _loaded[path]


def chunks(text: str, size: int | None = None) -> Iterator[str]:
    """The text in parts whose tokens, put together, are those of the whole; keeps the work on very long texts in proportion."""
    at, size = 0, size or _CHUNK
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if m is None:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


def encode(text: str, path: str = RANKS) -> np.ndarray:
    enc = encoder(path)[0]
    parts = [np.asarray(enc.encode_ordinary(x), np.int64) for x in chunks(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def count(text: str, path: str = RANKS) -> int:
    enc = encoder(path)[0]
    return sum(len(enc.encode_ordinary(x)) for x in chunks(text))


def with_token_counts(df: DataFrame, text: str, keep: list[str], name: str = "n_tokens", path: str = RANKS) -> DataFrame:
    """Columns ``keep`` and the number of tokens of column ``text``: whole texts; 0 for null and empty ones."""
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [count(x.as_py(), path) if x.is_valid else 0 for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), pa.array(n, pa.int64())], schema.names)

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)
