"""The nearest of many sparse vectors for each of many others, held to what each has found so far.

Vectors of unit length made of counts (words, say) are q * u with small whole numbers u, q being their least number. A block
of such vectors is held as bytes, a row a dimension; a query adds up the rows of its own dimensions, and queries in the order
of their commonest dimensions share the sums they begin with. Sums stay within a byte, as |u * v| is at most the product of
the lengths. Other vectors are multiplied as they are."""

import json

import numpy as np

#: Lengths, in whole numbers, up to which a query and a vector are added up as bytes: their product stays below 127.
QUERY_LENGTH, LENGTH = 8.0, 15.8
#: Vectors in the first and in the largest block, queries between two looks at what is found, steps of what queries need.
FIRST, BLOCK, BATCH, STEP = 1 << 11, 1 << 17, 512, 1.02


def sparse(m: np.ndarray) -> tuple:
    """(ends, dims, weights) of the rows of a matrix."""
    r, d = np.nonzero(m)
    return np.searchsorted(r, np.arange(len(m) + 1)), d.astype(np.int32), m[r, d].astype(np.float64)


def joined(parts: list[tuple]) -> tuple:
    ends = [parts[0][0]] if parts else [np.zeros(1, np.int64)]
    for e, _, _ in parts[1:]:
        ends.append(e[1:] + ends[-1][-1])
    return np.concatenate(ends), *(np.concatenate([p[i] for p in parts]) if parts else np.empty(0, t) for i, t in ((1, np.int32), (2, np.float64)))


def _at(ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): the places of the numbers of the rows, and which of them each belongs to."""
    n = np.diff(ends)[rows]
    return np.repeat(np.arange(len(rows)), n), np.repeat(ends[:-1][rows] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


def dense(s: tuple, rows: np.ndarray, dims: int) -> np.ndarray:
    row, at = _at(s[0], rows)
    out = np.zeros((len(rows), dims))
    out[row, s[1][at]] = s[2][at]
    return out


def counts(s: tuple, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, u, ok): the least number of each row (1 for none), each number as a multiple of it, and whether all of these are
    whole and the length of u is at most `most`."""
    ends, _, w = s
    n = np.diff(ends)
    some, first = n > 0, ends[:-1][n > 0]
    q, ok = np.ones(len(n)), np.zeros(len(n), bool)
    if len(w):
        q[some] = np.minimum.reduceat(np.abs(w), first)
    x = w / np.repeat(q, n)
    u = np.round(x)
    if len(w):
        ok[some] = (np.maximum.reduceat(np.abs(x - u), first) < 1e-9) & (np.add.reduceat(x * x, first) <= most * most)
    return q, np.clip(u, -127, 127).astype(np.int8), ok


class Nearest:
    """The k best vectors for each query so far: score (to 6 places) at least `least`, ties by the vectors' order."""

    def __init__(self, queries: tuple, k: int, least: float, dims: int):
        self.s, self.k, self.least, self.dims, n = queries, k, least, dims, len(queries[0]) - 1
        self.score, self.order, self.ids = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64), {}
        ends, d, _ = queries
        self.q, u, ok = counts(queries, QUERY_LENGTH)
        ok &= least > 1e-3
        seen, often = np.bincount(d, minlength=dims), np.empty(dims, np.int64)
        often[np.argsort(-seen, kind="stable")] = np.arange(dims)
        rank, known, e = often[d], {}, ends.tolist()
        self.terms = {}
        for i in np.flatnonzero(ok).tolist():
            a, b = e[i], e[i + 1]
            self.terms[i] = [known.setdefault(t, t) for t in sorted(zip(rank[a:b].tolist(), d[a:b].tolist(), u[a:b].tolist()))]
        self.by_counts = np.array(sorted(self.terms, key=self.terms.get), np.int64)
        self.others = np.flatnonzero(~ok & (np.diff(ends) > 0 if least > 0 else True))
        self.parts: list = []
        self.waiting, self.block = 0, FIRST

    def add(self, s: tuple, order: np.ndarray, ids: list) -> None:
        """More vectors, as rows of s, with their order and their ids."""
        for a in range(0, len(order), BLOCK):
            part = slice(a, a + BLOCK)
            ends = s[0][a : a + BLOCK + 1]
            self.parts.append(((ends - ends[0], *(x[ends[0] : ends[-1]] for x in s[1:])), order[part], ids[part]))
            self.waiting += len(order[part])
            if self.waiting >= self.block:
                self.flush()

    def flush(self) -> None:
        """Takes in what was added."""
        if not self.waiting:
            return
        s, order = joined([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts])
        ids = [x for p in self.parts for x in p[2]]
        self.parts, self.waiting, self.block = [], 0, min(BLOCK, 2 * self.block)
        q, u, ok = counts(s, LENGTH)
        if len(self.by_counts) and ok.any():
            self._add_up(s, np.flatnonzero(ok), q, u, order)
        for own, rows in ((self.by_counts, np.flatnonzero(~ok)), (self.others, np.arange(len(order)))):
            for a in range(0, len(rows) * bool(len(own)), 4096):
                part = rows[a : a + 4096]
                m = dense(s, part, self.dims)
                for i in range(0, len(own), BATCH):
                    x = own[i : i + BATCH]
                    score = np.round(dense(self.s, x, self.dims) @ m.T, 6)
                    to, at = np.nonzero(score >= self._bound(x)[:, None])
                    self._keep(x[to], order[part[at]], score[to, at])
        kept = np.unique(self.order[self.order >= 0])
        by = np.argsort(order)
        at = np.minimum(np.searchsorted(order[by], kept), len(by) - 1)
        new = by[at][order[by[at]] == kept]
        self.ids = {o: self.ids[o] for o in kept.tolist() if o in self.ids} | {o: ids[i] for o, i in zip(order[new].tolist(), new.tolist())}

    def _bound(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(self.least, self.score[x, -1])

    def _add_up(self, s: tuple, rows: np.ndarray, q: np.ndarray, u: np.ndarray, order: np.ndarray) -> None:
        n, q, order = len(rows), q[rows], order[rows]
        row, at = _at(s[0], rows)
        held = np.zeros((self.dims, n), np.int8)
        held[s[1][at], row] = u[at]
        sums, enough, needs, before = [np.zeros(n, np.int8)], np.empty(n, bool), {}, []
        for a in range(0, len(self.by_counts), BATCH):
            x = self.by_counts[a : a + BATCH]
            steps = np.floor(np.log((self._bound(x) - 1e-6) / self.q[x]) / np.log(STEP)).astype(int).tolist()
            to, found, got = [], [], []
            for i, step in zip(x.tolist(), steps):
                terms = self.terms[i]
                k = 0
                for t, b in zip(terms, before):
                    if t is not b:
                        break
                    k += 1
                for j in range(k, len(terms)):
                    if j + 1 == len(sums):
                        sums.append(np.empty(n, np.int8))
                    _, d, c = terms[j]
                    add = np.add if c > 0 else np.subtract
                    add(sums[j], held[d], sums[j + 1])
                    for _ in range(abs(c) - 1):
                        add(sums[j + 1], held[d], sums[j + 1])
                before = terms
                if step not in needs:
                    needs[step] = np.clip(np.ceil(STEP**step / q - 1e-6), -127, 127).astype(np.int8)
                np.greater_equal(sums[len(terms)], needs[step], enough)
                at = np.flatnonzero(enough)
                if len(at):
                    to.append(np.full(len(at), i))
                    found.append(at)
                    got.append(sums[len(terms)][at])
            if to:
                x, at = np.concatenate(to), np.concatenate(found)
                score = np.round(np.concatenate(got) * (self.q[x] * q[at]), 6)
                ok = score >= self._bound(x)
                self._keep(x[ok], order[at[ok]], score[ok])

    def _keep(self, x: np.ndarray, order: np.ndarray, score: np.ndarray) -> None:
        if not len(x):
            return
        own = np.unique(x)
        i, j = np.nonzero(self.order[own] >= 0)
        x, order, score = np.r_[own[i], x], np.r_[self.order[own[i], j], order], np.r_[self.score[own[i], j], score]
        at = np.lexsort((order, -score, x))
        x, order, score = x[at], order[at], score[at]
        first = np.r_[0, np.flatnonzero(x[1:] != x[:-1]) + 1]
        place = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)]))
        ok = place < self.k
        self.order[x[ok], place[ok]], self.score[x[ok], place[ok]] = order[ok], score[ok]

    def found(self, i: int) -> list[tuple]:
        """(id, score) of the k best for query i; a vector stands for all of its ids (a list as JSON), in their order."""
        n = int((self.order[i] >= 0).sum())
        best = zip(self.order[i, :n].tolist(), self.score[i, :n].tolist())
        same: dict = {}
        for o, v in best:
            same.setdefault(v, []).extend(json.loads(self.ids[o]))
        return [(x, v) for v, xs in same.items() for x in sorted(xs, key=lambda x: (x is None, x or ""))][: self.k]
