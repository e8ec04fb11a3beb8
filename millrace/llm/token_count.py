"""Operator 2: token counts by heap-and-linked-list merging, with no identifiers emitted."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe_vocab import Vocabulary, piece_words
from millrace.llm.common import field_type
from millrace.llm.pieces import Memo, Pieces
from millrace.llm.words import slices


def merged_length(word: bytes, vocab: Vocabulary) -> int:
    """Symbols left after merging: initial symbols minus merges.

    A heap holds (rank, position) of adjacent pairs; a doubly linked list holds the symbols.
    The lowest rank, leftmost first, is popped and merged until no known pair is left.
    """
    n = len(word)
    if n < 2:
        return n
    ranks, pairs, base = vocab.ranks, vocab.pairs, vocab.base
    sym = [vocab.byte_ids[b] for b in word]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []  # rank * n + position, so one comparison orders by rank, then position
    for i in range(n - 1):
        rank = ranks.get(sym[i] * base + sym[i + 1])
        if rank is not None:
            heap.append(rank * n + i)
    heapify(heap)
    left = n
    while heap:
        rank, i = divmod(heappop(heap), n)
        a, b, merged = pairs[rank]
        j = after[i]
        if sym[i] != a or j == n or sym[j] != b:
            continue  # a neighbour has merged since this entry was pushed
        sym[i], sym[j] = merged, -1
        k = after[i] = after[j]
        left -= 1
        if k < n:
            before[k] = i
            rank = ranks.get(merged * base + sym[k])
            if rank is not None:
                heappush(heap, rank * n + i)
        h = before[i]
        if h >= 0:
            rank = ranks.get(sym[h] * base + merged)
            if rank is not None:
                heappush(heap, rank * n + h)
    return left


class _Counter:
    """Token counts of texts; remembers at most about `limit` words and `limit` pieces."""

    def __init__(self, vocab: Vocabulary, limit: int):
        self.vocab, self.limit = vocab, limit
        self.words: dict[str, int] = {}
        self.pieces = Memo(self._counts, limit)

    def _word(self, word: str) -> int:
        n = self.words.get(word)
        if n is None:
            if len(self.words) >= self.limit:
                self.words.clear()
            n = self.words[word] = merged_length(word.encode("utf-8", "surrogatepass"), self.vocab)
        return n

    def _counts(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n = [1 if p in self.vocab.specials else sum(map(self._word, piece_words(p))) for p in pieces]
        return np.array(n, np.int64), np.ones(len(n), np.int64)

    def column(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; a special string inside a text is one token, null has none."""
        n, rows = self.pieces.of(Pieces(texts, self.vocab.specials))
        upto = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        return np.diff(upto[rows])

    def text(self, text: str) -> int:
        return int(self.column(pa.array([text], pa.string()))[0])


def token_counts(df: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, memo: int = 500_000) -> DataFrame:
    """Count the tokens of every whole text.

    Returns (id_col, n_bytes long, n_tokens long, over_limit boolean), one row per input row.
    Null and empty texts count 0; null ids are kept as they are; repeated rows stay repeated;
    other columns of the input are ignored, whatever their names. No shuffle. `memo` bounds
    the distinct words and pieces that a Python worker remembers.
    """
    vocab = df.sparkSession.sparkContext.broadcast(Vocabulary.load(vocab_path))
    id_type = field_type(df, id_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo_ = _Counter(vocab.value, memo)
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(memo_.column(part.column(2)), pa.int64())], ["id", "n_bytes", "n_tokens"])

    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInArrow(count, f"id {id_type.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
