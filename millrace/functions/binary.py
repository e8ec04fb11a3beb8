"""Functions of byte strings, by their hexadecimal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pairs(c: Column) -> Column:
    return F.regexp_extract_all(F.hex(c), F.lit("(..)"), F.lit(1))


def _join(pairs: Column) -> Column:
    return F.unhex(F.array_join(pairs, ""))


def add(c: Column, data: bytes, index: int = 0, end: bool = False) -> Column:
    """Insert bytes at a position, counted from the start or the end."""
    n = F.octet_length(c)
    at = n - index if end else F.lit(index)
    return F.concat(F.substring(c, F.lit(1), at), F.lit(data), F.substring(c, at + 1, n))


def at(c: Column, start: int, stop: int | None = None) -> Column:
    """Bytes start to stop (inclusive); negative positions count from the end."""
    n = F.octet_length(c)
    a = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    b = n - 1 if stop is None else F.lit(stop) if stop >= 0 else n + stop
    return F.substring(c, a + 1, F.greatest(b - a + 1, F.lit(0)))


def length(c: Column) -> Column:
    return F.octet_length(c)


def reverse(c: Column) -> Column:
    return _join(F.reverse(_pairs(c)))


def _places(c: Column, pattern: bytes) -> Column:
    """All byte positions at which the pattern stands."""
    n = len(pattern)
    last = F.octet_length(c) - n
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.substring(c, k + 1, F.lit(n)) == F.lit(pattern))).otherwise(F.slice(F.array(F.lit(0)), 1, 0))


def index_of(c: Column, pattern: bytes, end: bool = False) -> Column:
    """First (or last) position of a pattern; -1 if absent."""
    found = _places(c, pattern)
    return F.when(F.size(found) > 0, (F.array_max if end else F.array_min)(found)).otherwise(-1)


def index_of_all(c: Column, pattern: bytes) -> Column:
    return _places(c, pattern)


def replace(c: Column, find: bytes, by: bytes, all_: bool = False) -> Column:
    """Replace the first place of a pattern, or all, left to right."""
    h, p, r = F.hex(c), find.hex().upper(), by.hex().upper()
    whole = f"\\A((?:..)*?){p}"
    if not all_:
        return F.unhex(F.regexp_replace(h, whole, f"$1{r}"))
    return F.unhex(F.regexp_replace(h, f"\\G((?:(?!{p})..)*){p}", f"$1{r}"))


def remove(c: Column, pattern: bytes, all_: bool = False, end: bool = False) -> Column:
    """Remove the first (or last) place of a pattern, or all."""
    if not end or all_:
        return replace(c, pattern, b"", all_)
    k = index_of(c, pattern, end=True)
    return F.when(k < 0, c).otherwise(F.concat(F.substring(c, F.lit(1), k), F.substring(c, k + len(pattern) + 1, F.octet_length(c))))


def split(c: Column, separator: bytes) -> Column:
    """Pieces between separators, left to right."""
    p = separator.hex().upper()
    marked = F.regexp_replace(F.hex(c), f"\\G((?:(?!{p})..)*){p}", "$1,")
    return F.transform(F.split(marked, ","), F.unhex)


def starts_with(c: Column, pattern: bytes) -> Column:
    return F.startswith(c, F.lit(pattern))


def ends_with(c: Column, pattern: bytes) -> Column:
    return F.endswith(c, F.lit(pattern))


def collect(c: Column, separator: bytes = b"") -> Column:
    """Items of a list of byte strings as one."""
    return F.unhex(F.array_join(F.transform(c, F.hex), separator.hex().upper()))
