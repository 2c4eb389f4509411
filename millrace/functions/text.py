"""Field extractors and splitting with the rules of delimited text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fields(line: Column, separator: str) -> Column:
    """The line split at a regular expression; empty fields at the end don't count, but a line without separator is one field."""
    parts = F.split(line, separator)
    n = F.size(parts)
    kept = F.array_max(F.transform(parts, lambda x, i: F.when(x != "", i + 1).otherwise(0)))
    return F.when(n == 1, parts).otherwise(F.slice(parts, 1, F.coalesce(kept, F.lit(0))))


def field(parts: Column, k: int) -> Column:
    """The k-th field from 0, null if there is none."""
    return F.get(parts, k)


def an_int(text: Column) -> Column:
    """A whole number of 32 bits, null where the text isn't one (blanks and decimals are not)."""
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("int"))


def a_long(text: Column) -> Column:
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint"))


_DECIMAL = r"\A\s*[+-]?(NaN|Infinity|[0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?)[dDfF]?\s*\z"


def a_double(text: Column) -> Column:
    """A floating point number as the platform's parser reads it: surrounding blanks and a type letter are allowed."""
    return F.when(text.rlike(_DECIMAL), F.regexp_replace(F.trim(text), "[dDfF]$", "").try_cast("double"))


def a_float(text: Column) -> Column:
    return a_double(text).cast("float")
