"""Reading a byte-level BPE vocabulary file and splitting texts the way it expects."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import regex

#: The word pattern of byte-level BPE vocabularies of this family (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_words = regex.compile(PATTERN).findall


def byte_symbols() -> dict[str, int]:
    """Printable stand-in -> byte: printable Latin-1 characters stand for themselves, the rest
    are numbered upwards from U+0100 in byte order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(other)}


@dataclass
class Vocabulary:
    """What an executor needs of a vocabulary file; its size is that of the file (a few MB), whatever the data."""

    tokens: list[bytes]  # id -> bytes
    ranks: dict[int, int]  # left id * base + right id -> rank
    pairs: list[tuple[int, int, int]]  # rank -> (left id, right id, merged id)
    base: int
    byte_ids: list[int]  # byte -> id
    specials: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        """The same as arrays."""
        self.byte_table = np.array(self.byte_ids, np.int32)
        keys = np.fromiter(self.ranks, np.int64, len(self.ranks))
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], np.fromiter(self.ranks.values(), np.int64, len(keys))[order]
        pair = self.byte_table.astype(np.int64)
        self.byte_ranks = self.rank_array(pair[:, None] * self.base + pair[None, :])

    def rank_array(self, keys: np.ndarray) -> np.ndarray:
        """Ranks of pairs, given as left id * base + right id; -1 where a pair is none."""
        at = np.searchsorted(self._keys, keys)
        at[at == len(self._keys)] = 0
        return np.where(self._keys[at] == keys, self._ranks[at], -1) if len(self._keys) else np.full(keys.shape, -1)

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        """Read a tokenizers .json file with a byte-level BPE model and no normaliser."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") or pre.get("add_prefix_space"):
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        to_byte = byte_symbols()
        vocab: dict[str, int] = model["vocab"]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        base = max([*vocab.values(), *specials.values()]) + 1
        tokens = [b""] * base
        for s, i in vocab.items():
            if s not in specials:
                tokens[i] = bytes(to_byte[c] for c in s)
        for s, i in specials.items():
            tokens[i] = s.encode()
        ranks, pairs = {}, []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            pairs.append((vocab[a], vocab[b], vocab[a + b]))
            ranks.setdefault(vocab[a] * base + vocab[b], rank)
        byte_ids = [0] * 256
        for s, b in to_byte.items():
            byte_ids[b] = vocab[s]
        return cls(tokens, ranks, pairs, base, byte_ids, specials)


def piece_words(piece: str) -> list[str]:
    """The words of a piece. Letters alone, or with one closing mark, need no pattern search."""
    body = piece[1:] if piece[0] == " " else piece
    if body.isalpha():
        return [piece]
    if body[-1:] in (",", ".") and body[:-1].isalpha():
        return [piece[:-1], piece[-1]]
    return _words(piece)
