"""A BK-tree under Levenshtein distance that is searched by whole blocks of strings at once."""

import numpy as np


def levenshtein(a: str, b: str) -> int:
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def damerau(a: str, b: str) -> int:
    """The unrestricted Damerau-Levenshtein distance (a metric, other than the restricted form)."""
    big = len(a) + len(b)
    seen: dict[str, int] = {}
    d = [[big] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        column = 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), column
            cost = int(x != y)
            if not cost:
                column = j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        seen[x] = i
    return d[-1][-1]


class Block:
    """Strings as a matrix of character codes, ready for bit-parallel distances."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.length = np.array([len(t) for t in texts], dtype=np.int64)
        codes = np.zeros((len(texts), max(1, int(self.length.max(initial=0)))), dtype=np.uint32)
        for i, t in enumerate(texts):
            codes[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
        self.chars, self.codes = np.unique(codes, return_inverse=True)
        self.codes = self.codes.reshape(codes.shape)

    def distances(self, pattern: str, rows: np.ndarray) -> np.ndarray:
        """Levenshtein distances of pattern to the given rows; bit vectors in one machine word, so up to 63 characters."""
        if not pattern:
            return self.length[rows]
        if len(pattern) > 63:
            return np.array([levenshtein(pattern, self.texts[r]) for r in rows], dtype=np.int64)
        m = len(pattern)
        masks = np.zeros(len(self.chars), dtype=np.uint64)
        for i, c in enumerate(pattern):
            masks[self.chars == ord(c)] |= np.uint64(1 << i)
        codes, length = self.codes[rows], self.length[rows]
        one, top, full = np.uint64(1), np.uint64(1 << (m - 1)), np.uint64((1 << m) - 1)
        pv, mv = np.full(len(rows), full), np.zeros(len(rows), dtype=np.uint64)
        score = np.full(len(rows), m, dtype=np.int64)
        for j in range(int(length.max(initial=0))):
            live = j < length
            eq = masks[codes[:, j]]
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (~(xh | pv) & full)
            mh = pv & xh
            score += np.where(live & ((ph & top) != 0), 1, 0) - np.where(live & ((mh & top) != 0), 1, 0)
            ph = ((ph << one) | one) & full
            mh = (mh << one) & full
            pv, mv = np.where(live, (mh | (~(xv | ph) & full)) & full, pv), np.where(live, ph & xv, mv)
        return score


class BKTree:
    """Children hang on their distance to the parent; a child at distance c can lead to a hit within r of a string
    at distance d from the parent only if |d - c| <= r."""

    def __init__(self, words: list[str]):
        self.words = list(dict.fromkeys(words))
        self.children: list[dict[int, int]] = [{} for _ in self.words]
        block = Block(self.words)
        # The first word of each part is the node that the others of the part hang below, by their distance to it.
        parts = [np.arange(len(self.words))] if self.words else []
        while parts:
            part = parts.pop()
            node, rest = int(part[0]), part[1:]
            if not len(rest):
                continue
            word = self.words[node]
            if len(rest) < 6:
                d = np.array([levenshtein(word, self.words[r]) for r in rest])
            else:
                d = block.distances(word, rest)
            order = np.argsort(d, kind="stable")
            cuts = np.flatnonzero(np.diff(d[order])) + 1
            for group in np.split(order, cuts):
                self.children[node][int(d[group[0]])] = int(rest[group[0]])
                parts.append(rest[group])

    def search(self, block: Block, radius: int) -> list[tuple[int, int, int]]:
        """Every (row of the block, index of the word, distance) with a distance of at most radius."""
        hits: list[tuple[int, int, int]] = []
        if not self.words or not block.texts:
            return hits
        stack = [(0, np.arange(len(block.texts)))]
        while stack:
            node, rows = stack.pop()
            d = block.distances(self.words[node], rows)
            near = d <= radius
            hits.extend((int(r), node, int(x)) for r, x in zip(rows[near], d[near]))
            for c, child in self.children[node].items():
                live = np.abs(d - c) <= radius
                if live.any():
                    stack.append((child, rows[live]))
        return hits
