"""Small tables with awkward rows, and brute-force versions of the operators."""

from __future__ import annotations

from collections import defaultdict

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

#: Nulls, empty and blank texts, repeated rows, a null id, a long text.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "One  two three"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (8, "é ß\x00 漢字 " * 3), (9, "w" + " w2 w3" * 3000)]


def documents(spark, rows):
    """A documents table; further columns have names that operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id long, score string")


class Groups:
    """Union-find."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def shingles(text, width):
    words = (text or "").encode().translate(LOW).split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def near_duplicates(rows, width, percent):
    """id -> (set size, component) by comparing all pairs."""
    sets = {i: shingles(t, width) for i, t in rows if i is not None}
    by_set = defaultdict(list)
    for i, s in sets.items():
        by_set[s].append(i)
    groups = Groups()
    kinds = [(s, min(ids)) for s, ids in by_set.items() if s]
    for s, ids in by_set.items():
        for i in ids:
            groups.find(i)
            if s:
                groups.join(i, min(ids))
    for k, (a, i) in enumerate(kinds):
        for b, j in kinds[k + 1 :]:
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                groups.join(i, j)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}
