"""Pieces of texts that the word pattern of a vocabulary treats alike wherever they stand, and a memo of what each gives."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from millrace.llm.words import merged, words_of

#: White space beyond ASCII, in UTF-8 (fixed values).
WIDE_SPACES = "\x85\xa0                　"

_TWO, _THREE = (np.array([int.from_bytes(c.encode(), "big") for c in WIDE_SPACES if len(c.encode()) == n]) for n in (2, 3))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[0] = 255  # no byte separates: a piece ends at its cuts only; 0xFF never occurs in UTF-8


def lone_spaces(raw: np.ndarray) -> np.ndarray:
    """Positions of the spaces between two characters that are no white space: the pattern always starts a word there."""
    if len(raw) < 3:
        return np.empty(0, np.int64)
    space = _SPACE[raw]
    at = np.flatnonzero((raw[1:-1] == 0x20) & ~space[:-2] & ~space[2:]) + 1
    wide = (raw[at - 1] >= 128) | (raw[at + 1] >= 128)
    some = at[wide]
    if not len(some):
        return at
    padded = np.pad(raw, 3)
    b = lambda k: padded[some + 3 + k].astype(np.int64)  # noqa: E731  the byte k after the space
    before, after = b(-2) << 8 | b(-1), b(1) << 8 | b(2)
    odd = np.isin(before, _TWO) | np.isin(after, _TWO) | np.isin(b(-3) << 16 | before, _THREE) | np.isin(after << 8 | b(3), _THREE)
    keep = np.ones(len(at), bool)
    keep[np.flatnonzero(wide)[odd]] = False
    return at[keep]


class Pieces:
    """The pieces of a string column: bytes raw[start:end], a hash, and `first`, the piece with which each row begins.

    A text is cut before every lone space and around every special string, so that the words of its pieces, in order, are its words.
    """

    def __init__(self, column: pa.Array, specials: dict[str, int]):
        found = [s for s in specials if len(column) and pc.any(pc.match_substring(column, s)).as_py()]

        def cut(raw: np.ndarray, rows: np.ndarray) -> np.ndarray:
            self.raw = raw
            at = lone_spaces(raw)
            if not found:
                return at
            either = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(found, key=len, reverse=True)))
            more = [k + int(a) for a, b in zip(rows[:-1], rows[1:], strict=True) for m in either.finditer(raw[a:b].tobytes()) for k in m.span()]
            inside = [k for a, b in zip(more[::2], more[1::2], strict=True) for k in range(a + 1, b)]
            return merged(np.setdiff1d(at, inside), np.array(more, np.int64))

        self.raw = np.empty(0, np.uint8)
        w = words_of(column, _TABLE, cut=cut)
        self.start, self.end, self.hash, self.first = w.start, w.end, w.hash, w.first

    def text(self, k: int) -> str:
        return self.raw[self.start[k] : self.end[k]].tobytes().decode("utf-8", "surrogatepass")


class Ragged:
    """Short lists of numbers, one after the other."""

    def __init__(self):
        self.flat, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of these lists in order, and the length of each."""
        size = self.size[which]
        upto = np.cumsum(size)
        at = np.repeat(self.start[which] - upto + size, size)
        at += np.arange(len(at))
        return self.flat[at], size


class Memo:
    """What each piece gives, as a short list of numbers; at most about `limit` numbers are remembered.

    `make` gets pieces and returns their numbers in order, and how many each has.
    """

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int):
        self.make, self.limit = make, limit
        self.forget()

    def forget(self) -> None:
        self.keys, self.rows = np.empty(0, np.uint64), np.empty(0, np.int64)  # sorted hashes, and their rows in self.made
        self.made = Ragged()

    def of(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all pieces in order, and where those of each row begin (one more than rows)."""
        h = pieces.hash
        order = np.argsort(h)
        ranked = h[order]
        new = np.ones(len(h), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        names, one = ranked[new], order[new]
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        known = self._known(names)
        if not known.all():
            if len(self.made.flat) + np.count_nonzero(~known) > self.limit:
                self.forget()
                known = np.zeros(len(names), bool)
            fresh = names[~known]
            self._insert(fresh, len(self.made.size) + np.arange(len(fresh)))
            self.made.add(*self.make([pieces.text(k) for k in one[~known].tolist()]))
        out, size = self.made.take(self.rows[np.searchsorted(self.keys, names)][which])
        return out, np.concatenate([[0], np.cumsum(size)])[pieces.first]

    def _known(self, names: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(names), bool)
        place = np.minimum(np.searchsorted(self.keys, names), len(self.keys) - 1)
        return self.keys[place] == names

    def _insert(self, keys: np.ndarray, rows: np.ndarray) -> None:
        place = np.searchsorted(self.keys, keys)
        self.keys, self.rows = np.insert(self.keys, place, keys), np.insert(self.rows, place, rows)
