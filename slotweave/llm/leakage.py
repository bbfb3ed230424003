"""Evaluation passages inside documents: winnowed fingerprints, joined and extended.

Both sides are reduced to plain words (case, punctuation, entities, invisible signs and look-alike letters do not count).
Of every window of WINDOW consecutive k-grams of K words the one with the least hash is kept, on both sides, so every
shared span of K + WINDOW - 1 words shares a fingerprint, however many passages share it. A passage that shares one is a
candidate; an exact bound discards those whose equal pairs of words can't cover what a leak must; the others are extended
around their hits. Equal passages are aligned once for all their items.

Null and blank texts hold nothing; documents are read to their end; repeated documents each give their own rows."""

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.operators.skew import salted_join
from slotweave.session import cut, opened, share

K, WINDOW = 3, 2
#: Cyrillic and Greek letters that look like Latin ones.
LOOK_ALIKES = str.maketrans("аеорсухіјѕԁһոӏгвкмнтАВЕКМНОРСТУХІЈЅοανικερτυχ", "aeopcyxijsdhnlrbkmhtABEKMHOPCTYXIJSoavikeptux")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"\w+")
_ODD = re.compile(r"[^\x00-\x7f]|&\w+;|&#")


def plain_words(text: str) -> list[str]:
    if _ODD.search(text):
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", html.unescape(text))).translate(LOOK_ALIKES)
    return _WORD.findall(text.casefold())


class Hasher:
    """64-bit word codes; the same word has the same code in every process."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def codes(self, words: list[str]) -> np.ndarray:
        import xxhash

        if len(self.known) > 500_000:
            self.known.clear()
        known, out = self.known, []
        for w in words:
            c = known.get(w)
            if c is None:
                c = known[w] = xxhash.xxh64_intdigest(w)
            out.append(c)
        return np.array(out, dtype=np.uint64)


def grams(codes: np.ndarray, k: int = K) -> np.ndarray:
    if len(codes) < k:
        return np.empty(0, dtype=np.uint64)
    n = len(codes) - k + 1
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[i : i + n] + (h >> np.uint64(29)))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Positions of the kept k-grams: the least (rightmost of equals) in each window."""
    if len(hashes) <= WINDOW:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.empty(0, dtype=np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
    at = WINDOW - 1 - np.argmin(windows[:, ::-1], axis=1) + np.arange(len(windows))
    return np.unique(at)


class Fingerprints:
    """The fingerprints and pairs of words of distinct passages, ready to be looked up. usual: the words that are no names,
    as usual_words gives them for all passages."""

    def __init__(self, passages: list[tuple[int, str]], usual: frozenset[str]):
        hasher = Hasher()
        same: dict[tuple[str, ...], list[int]] = {}
        for k, p in passages:
            if w := plain_words(p):
                same.setdefault(tuple(w), []).append(k)
        self.words = [list(w) for w in same]
        #: The items of each distinct passage.
        self.items = list(same.values())
        #: Names and figures: what tells a passage from another one in the same manner of wording.
        self.special = [[x.isdigit() or x not in usual for x in w] for w in self.words]
        self.size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.least = np.array([_least_special(x) for x in self.special], dtype=np.int64)
        # All passages one after the other: whose each word is, and whether it is special.
        self.owner = np.repeat(np.arange(len(self.words)), self.size)
        self.marked = np.array([x for s in self.special for x in s], dtype=bool)
        self.start = np.r_[0, np.cumsum(self.size)]
        codes = hasher.codes([x for w in self.words for x in w])
        at = np.flatnonzero(self.owner[:-1] == self.owner[1:])
        hashes = grams(codes, 2)[at] if len(at) else np.empty(0, dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at = hashes[order], at[order]
        prints = [(g[winnow(g)], i) for i in range(len(self.words)) for g in [grams(codes[self.start[i] : self.start[i + 1]])]]
        keys = np.concatenate([p for p, _ in prints]) if prints else np.empty(0, dtype=np.uint64)
        whose = np.repeat([i for _, i in prints], [len(p) for p, _ in prints]).astype(np.int64)
        # A passage of fewer than K words has no fingerprint: its pairs propose it.
        order = np.argsort(keys, kind="stable")
        self.prints, self.whose = keys[order], whose[order]
        self.short = np.flatnonzero(self.size < K)

    def proposed(self, codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Codes doc * passages + passage, sorted, of the passages that share a fingerprint with a document. codes: the words
        of several documents one after the other; doc: whose each word is."""
        if len(codes) < K:
            return np.empty(0, dtype=np.int64)
        g = grams(codes)
        within = doc[: len(g)] == doc[K - 1 :]
        # What reaches over a document's end never is the least; at an end a window may keep one print more.
        kept = winnow(np.where(within, g, np.uint64(0xFFFFFFFFFFFFFFFF)))
        kept = kept[within[kept]]
        at, place = _ranges(self.prints, g[kept])
        return np.unique(doc[kept[place]] * len(self.words) + self.whose[at])

    def candidates(self, texts: list[np.ndarray], part: float = 0.4) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(document, passage, places) of several documents (their words' codes): where in the document and in the passage
        equal pairs of words lie, for the passages proposed that held_part may give `part` or more: what it counts lies in
        runs of two equal words or more, which make up 0.75 of its pieces and hold 0.75 of their names and figures; a piece
        has no gap of more than four words."""
        many, wide = len(self.words), len(self.owner) + 1
        length = np.array([len(t) for t in texts], dtype=np.int64)
        doc, begin = np.repeat(np.arange(len(texts)), length), np.cumsum(length) - length
        codes = np.concatenate(texts) if texts else np.empty(0, dtype=np.uint64)
        if len(codes) < 2 or not many:
            return
        asked = self.proposed(codes, doc)
        pairs = np.flatnonzero(doc[:-1] == doc[1:])
        at, place = _ranges(self.hashes, grams(codes, 2)[pairs])
        at, place = self.at[at], pairs[place]
        key = doc[place] * many + self.owner[at]
        keep = _member(key, asked)
        if len(self.short):
            keep |= _member(self.owner[at], self.short)
        at, place, key = at[keep], place[keep], key[keep]
        if not len(at):
            return
        covered = doc[place] * wide + at
        covered = np.unique(np.concatenate((covered, covered + 1)))
        of, to = covered // wide, covered % wide
        whose = of * many + self.owner[to]
        first = np.flatnonzero(np.concatenate(([True], whose[1:] != whose[:-1])))
        who, count = whose[first], np.diff(np.append(first, len(whose)))
        marked = np.add.reduceat(self.marked[to].astype(np.int64), first)
        least = 0.75 * self.least * (part >= 0.4)
        passage = who % many
        keep = _member(key, who[(count >= 0.75 * part * self.size[passage]) & (marked >= least[passage])])
        at, place, key = at[keep], place[keep], key[keep]
        if not len(at):
            return
        order = np.lexsort((at, place, key))
        at, place, key = at[order], place[order], key[order]
        bounds = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            d, i = divmod(int(key[lo]), many)
            p, q = place[lo:hi] - begin[d], at[lo:hi] - self.start[i]
            n = int(self.size[i])
            segment = np.concatenate(([0], np.cumsum(p[1:] - p[:-1] > 6)))
            seen = np.zeros((segment[-1] + 1, n), dtype=bool)
            seen[segment, q] = seen[segment, q + 1] = True
            held = seen.sum(1)
            if len(held) > 1:
                top = np.partition(held, -2)[-2:]
                held = held + np.where(held == top[1], top[0] if top[0] < top[1] else top[1], top[1])
            fits = held >= 0.75 * part * n  # with the best other one
            if fits.any() and self.marked[self.start[i] : self.start[i] + n][seen[fits].any(0)].sum() >= least[i]:
                mine = fits[segment]
                yield d, i, p[mine], q[mine]


#: Words of documents that are looked up at once; a longer document is looked up alone.
AT_ONCE = 20_000


def _together(texts: list[str], hasher: Hasher) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(place of the first, codes) of documents of AT_ONCE words or so together."""
    part: list[np.ndarray] = []
    first = words = 0
    for k, text in enumerate(texts):
        codes = hasher.codes(plain_words(text))
        if part and words + len(codes) > AT_ONCE:
            yield first, part
            part, first, words = [], k, 0
        part.append(codes)
        words += len(codes)
    if part:
        yield first, part


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are among the given sorted ones."""
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _ranges(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every (place in the sorted keys, place in asked) of equal values."""
    low, high = np.searchsorted(keys, asked), np.searchsorted(keys, asked, side="right")
    k = high - low
    return np.repeat(low - np.r_[0, np.cumsum(k)[:-1]], k) + np.arange(int(k.sum())) if len(k) else low, np.repeat(np.arange(len(asked)), k)


def _least_special(special: list[bool], part: float = 0.4) -> int:
    """How many of its names and figures the passage has at least in `part` of its words, in one span or in two."""
    n, size = len(special), int(-(-part * len(special) // 1))
    total = np.r_[0, np.cumsum(special)]
    fewest = [int((total[k:] - total[: n + 1 - k]).min()) for k in range(size + 1)]
    return min((fewest[k] + fewest[size - k] for k in range(size + 1)), default=0)


def held_part(special: list[bool], at: np.ndarray, to: np.ndarray) -> float:
    """The part of the passage that lies in the document, in order, in at most two pieces. at and to: where in document and
    passage equal pairs of words lie. Pairs in a row make runs; the runs near each other are chained to the longest text in
    order, and that is taken apart into pieces where it has wide gaps. A piece has few changed words, and few of its names
    and figures are among them. No piece has a least length, but one under eight words is stock wording if it has no name
    or figure, and counts only in the document's order."""
    n = len(special)
    total = [0]
    for x in special:
        total.append(total[-1] + x)
    best: list[tuple[int, int, int, int, int, int]] = []
    for near in _near(_runs(at, to), n):
        pieces: list[list[tuple[int, int, int]]] = []
        for a, b, size in _chained(near):
            if pieces:
                x, y, last = pieces[-1][-1]
                gap = max(a - x - last, b - y - last)
                if gap <= 2 or (gap <= 4 and min(size, last) >= 4):
                    pieces[-1].append((a, b, size))
                    continue
            pieces.append([(a, b, size)])
        for p in pieces:
            held = sum(size for _, _, size in p)
            begin, end = p[0][1], p[-1][1] + p[-1][2]
            own = total[end] - total[begin]
            kept = sum(total[b + size] - total[b] for _, b, size in p)
            if (held >= 8 or own) and held >= 0.75 * (end - begin) and kept >= 0.75 * own:
                best.append((begin, end, end - begin, held, p[0][0], p[-1][0] + p[-1][2]))
    best.sort()
    few = min(8, n)  # a quotation of a few words is no case
    most = max((w for _, _, w, held, *_ in best if held >= few), default=0)
    for i, (_, end, w, held, _, stop) in enumerate(best):
        most = max([most, *(w + v for b, _, v, h, a, _ in best[i + 1 :] if b >= end and held + h >= few and (min(held, h) >= 8 or a >= stop))])
    return most / n if n else 0.0


def _runs(at: np.ndarray, to: np.ndarray) -> list[tuple[int, int, int]]:
    """(begin in the document, begin in the passage, words) of the runs of equal words, by begin in the document."""
    order = np.lexsort((at, at - to))
    a, b = at[order], to[order]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] - b[1:] != a[:-1] - b[:-1]) | (a[1:] != a[:-1] + 1))))
    size = np.diff(np.append(new, len(a))) + 1
    return sorted(zip(a[new].tolist(), b[new].tolist(), size.tolist()))


def _near(runs: list[tuple[int, int, int]], n: int) -> Iterator[list[tuple[int, int, int]]]:
    """The runs cut into stretches of the document that are further apart than the passage is long."""
    part: list[tuple[int, int, int]] = []
    end = 0
    for r in runs:
        if part and r[0] - end > n:
            yield part
            part = []
        part.append(r)
        end = max(end, r[0] + r[2])
    if part:
        yield part


def _chained(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The runs, in order in both texts, that hold most words; of two that overlap the later one begins later."""
    score = [size for _, _, size in runs]
    back, skip = [-1] * len(runs), [0] * len(runs)
    for i, (a, b, size) in enumerate(runs):
        for j in range(i):
            x, y, last = runs[j]
            if x < a and y < b:
                over = max(0, x + last - a, y + last - b)
                # Near runs count a little more, so that of equal chains the closest is taken.
                value = score[j] + size - over - min(0.5, 0.001 * (a - x - last + b - y - last if not over else 0))
                if size - over >= 1 and value > score[i]:
                    score[i], back[i], skip[i] = value, j, over
    out: list[tuple[int, int, int]] = []
    i = max(range(len(runs)), key=score.__getitem__)
    while i >= 0:
        a, b, size = runs[i]
        out.append((a + skip[i], b + skip[i], size - skip[i]))
        i = back[i]
    return out[::-1]


def usual_words(items: DataFrame) -> frozenset[str]:
    """The words that more than a fiftieth of the passages (and more than two) hold: at most fifty times the mean number
    of words of a passage, so few whatever their number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"word": [x for t in b["passage"] for x in set(plain_words(t))]})

    most = max(2, items.count() // 50)
    return frozenset(r[0] for r in items.select("passage").mapInPandas(run, "word string").groupBy("word").count().where(F.col("count") > most).select("word").collect())


def find_leaks(documents: DataFrame, items: DataFrame, least: float = 0.4, max_items: int = 200_000, max_chars: int = 200_000_000) -> DataFrame:
    """(doc_id, item_id, held): documents that hold at least `least` of an item's passage. documents: doc_id, text; items:
    item_id, passage. Equal passages are taken as one. The passages are a test set: their number and letters are counted
    first, and up to max_items and max_chars their fingerprints are broadcast and the documents stream past them without a
    shuffle; a larger set is taken in slices, with the same result."""
    items = items.where("trim(passage) <> ''").select("item_id", "passage")
    distinct = cut(items.groupBy("passage").agg(F.min("item_id").alias("_rep"), F.count("*").alias("_n")))
    total, chars, rows = distinct.agg(F.count("*"), F.coalesce(F.sum(F.length("passage")), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    usual = usual_words(distinct)
    slices = max(1, -(-total // max_items), -(-chars // max_chars))
    found = None
    for s in range(slices):
        part = distinct.where(F.pmod(F.xxhash64("passage"), F.lit(slices)) == s).select("_rep", "passage")
        shared = share(documents.sparkSession, Fingerprints([(r[0], r[1]) for r in part.orderBy("_rep").collect()], usual))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            prints, hasher = opened(shared), Hasher()
            for b in batches:
                out = []
                docs = list(b["doc_id"])
                for first, part in _together(list(b["text"]), hasher):
                    for d, i, at, to in prints.candidates(part, min(least, 0.4)):
                        held = held_part(prints.special[i], at, to)
                        if held >= least:
                            out += [(docs[first + d], item, held) for item in prints.items[i]]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "held"])

        one = documents.where("trim(text) <> ''").select("doc_id", "text").mapInPandas(run, "doc_id long, item_id long, held double")
        found = one if found is None else found.unionByName(one)
    if rows == total:
        return found
    # Items whose passages are letter for letter the same share one representative.
    of = items.join(distinct, "passage").select(F.col("_rep").alias("item_id"), F.col("item_id").alias("_item"))
    n = found.groupBy("item_id").agg(F.count("*").alias("_n"))
    return salted_join(found, of.join(n, "item_id"), ["item_id"], "_n", F.col("doc_id")).select("doc_id", F.col("_item").alias("item_id"), "held")
