"""Template residue and error-page text: a positive-unlabelled naive Bayes model of passages, learned by EM.

A text is cut into sentences, and each sign that could be an unfilled placeholder is a passage of its own, with what
stands in and around it. Passages that certainly are residue (TRUSTED, OPEN_SIGNS) are the positives; all others are
unlabelled and may be either. A record is residue if one of its passages is.

Null and blank texts are never residue; a text of any length is read to its end; repeated records are judged alike."""

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotweave.session import opened, share

#: What error pages, script notices and filler say.
TRUSTED = re.compile(
    r"enable javascript|switch on javascript|javascript (?:is )?(?:disabled|required)|scripts? (?:is|are) (?:blocked|disabled|off)|allow scripts to|noscript"
    r"|browser is not supported|ad ?blocker detected|accept all cookies|checking your browser|verify that you are human|turn them on and refresh"
    r"|page not found\.|access denied\.|bad gateway|internal server error|service unavailable|temporarily unavailable|gateway time-?out|connection .{0,40}refused"
    r"|traceback \(most recent|(?:key|type|value|index|attribute|runtime)error:|undefined array key|timed out after \d|something went wrong on our|could not load this|generation failed"
    r"|lorem ipsum|ipsum \w+ \w+ lorem|foo bar|asdf|qwerty|blah blah|sample text|text text text|dummy content|content coming soon|placeholder text\.|goes here\.|this is a test \w+\."
    r"|replace this (?:paragraph|text)|down for maintenance:|<h1>|<title>|section is still empty|will not work without js|quota for .{0,40}used up|no longer exists\.|incident number|no permission to view|newer browser; this|scripting (?:allowed|turned off)|so that it runs scripts|\"error\": ?\{|aktivieren sie javascript|active las cookies",
    re.I,
)
_SENTENCE = re.compile(r"(?<=[.!?;])[\"'”»)]*\s+(?=\S)|[\r\n]+\s*(?=[^a-z\s])|(?<=[}>])\s+(?=\S)|\s+\|\s+")
_WORD = re.compile(r"\d+|[^\W\d_]+")
_SIGN = re.compile(
    r"\[\[[^\[\]\n]{1,60}\]\]|\{\{[^{}\n]{1,60}\}\}|<<[^<>\n]{1,60}>>|@@\w{1,40}@@|%%?[A-Za-z_]{2,40}%%?|[#$%]\{[^{}\n]{1,60}\}|\{%[^{}\n]{1,60}%\}|\*\|\w{1,40}\|\*"
    r"|\[[^\[\]\n]{1,60}\]|\{[^{}\n]{1,60}\}|</?[A-Za-z][^<>\n]{0,60}>|__+\w*?[^\W_]__+|_{3,}|\bXXX+ [\w ]{1,40} XXX+\b|\([^()\n]{1,60} (?:goes )?here\)"
    r"|\b(?:NaN|None|null|undefined|nil|NULL|TBD|TODO|FIXME)\b|\[object Object\]|(?<!\w)%s\b"
)
#: Signs that hold no content whatever stands around them.
OPEN_SIGNS = re.compile(
    r"\[\[\s*\w+\s*\]\]|\{\{\s*[\w.]+\s*\}\}|<<\s*\w+\s*>>|@@\w+@@|#\{\w[\w.]*\}|\{%\s*[\w.]+\s*%\}|__+[^\W_]\w*__+|XXX+ .*XXX+|\[object Object\]|NaN"
    r"|[\[<(](?:your|insert|enter|add|fill in|todo|placeholder|put|choose|tbd)\b[^\])>]*[\])>]|\[[^\]]*\b(?:tbd|here)\]|\([^)]*goes here\)|<\w+_here>",
    re.I,
)
_SLOT = re.compile(r"\{\s*\w+\s*\}")
_LISTED = re.compile("[\"'`|;]")
_NULLS = {"nan", "none", "null", "undefined", "nil"}
#: Rows that the model is fitted on at most.
FIT_ROWS = 8_000


def _kind(sign: str) -> str:
    low = sign.casefold()
    if low in _NULLS:
        return "null"
    if re.search(r"[\"'`|,;:=]", low):
        return f"{low[:2]}list"
    return re.sub(r"[^\W_]+", "w", re.sub(r"\s+", "", low))


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


def sentence_features(sentence: str) -> tuple[str, ...]:
    w = ["9" if x[0].isdigit() else x for x in _WORD.findall(sentence.casefold())]
    return tuple(dict.fromkeys([*w, *map(" ".join, zip(["^", *w], [*w, "$"]))]))


def signs(text: str, template: bool) -> Iterator[tuple[str, tuple[str, ...]]]:
    """Each possible placeholder and its features. In templates a plain {slot} is none; nor is, anywhere, what holds quoted
    or listed content."""
    for m in _SIGN.finditer(text):
        sign = m.group()
        if template and _SLOT.fullmatch(sign) or _LISTED.search(sign):
            continue
        left, right = text[max(0, m.start() - 60) : m.start()], text[m.end() : m.end() + 60]
        before, after = _WORD.findall(left.casefold())[-2:], _WORD.findall(right.casefold())[:3]
        a, b = left[-1:] or "^", right[:1] or "$"
        inner = _WORD.findall(sign.casefold())
        yield sign, (
            f"k:{_kind(sign)}",
            *(f"i:{x}" for x in inner[:1] if _kind(sign) != "null"),
            f"l:{'w' if a.isalnum() else ' ' if a.isspace() else a}",
            f"r:{'w' if b.isalnum() else ' ' if b.isspace() else b}",
            *(f"<{i}{x}" for i, x in enumerate(reversed(before))),
            *(f">{i}{x}" for i, x in enumerate(after)),
        )


def _open(sign: str, features: tuple[str, ...]) -> bool:
    if OPEN_SIGNS.fullmatch(sign):
        return True
    spaced = {"l: ", "l:^"} & set(features) and {"r: ", "r:$", "r:.", "r:,", "r:;", "r:?", "r::"} & set(features)
    return bool(spaced) and bool(re.fullmatch(r"\$?\{\w[\w.]*\}", sign))


def has_trusted(text: str, template: bool) -> bool:
    return any(_open(sign, f) for sign, f in signs(text, template)) or any(TRUSTED.search(s) for s in sentences(text))


class Bayes:
    """Log-odds of features, kept for those seen at least `least` times; fitted to positives and unlabelled passages."""

    def __init__(self, least: int = 2, rounds: int = 3, trust: float = 0.1, smooth: float = 0.08):
        self.least, self.rounds, self.trust, self.smooth, self.weight, self.bias = least, rounds, trust, smooth, {}, -50.0

    def fit(self, passages: list[tuple[tuple[str, ...], bool, int]]) -> "Bayes":
        """passages: features, whether trusted, how often."""
        seen: Counter = Counter()
        for f, _, n in passages:
            for x in f:
                seen[x] += n
        kept = {x for x, n in seen.items() if n >= self.least}
        passages = [(tuple(x for x in f if x in kept), t, n) for f, t, n in passages]
        p = [1.0 if t else 0.0 for _, t, _ in passages]
        for _ in range(self.rounds):
            pos, total_pos, total = Counter(), 0.0, 0.0
            docs_pos = docs = 0.0
            for (f, _, n), q in zip(passages, p):
                docs += n
                docs_pos += n * q
                total += n * len(f)
                if q > 1e-3:
                    total_pos += n * q * len(f)
                    for x in f:
                        pos[x] += n * q
            if not total_pos:
                self.weight, self.bias = {}, -50.0
                return self
            total_neg, m = max(1.0, total - total_pos), max(1.0, self.smooth * total_pos)
            self.weight = {}
            for x in kept:
                base = seen[x] / total
                at_pos = (pos[x] + m * base) / (total_pos + m)
                at_neg = (max(0.0, seen[x] - pos[x]) + 0.5 * total_neg * base * 0.02 + 0.1) / (total_neg * 1.01 + 0.1)
                self.weight[x] = max(-6.0, min(6.0, math.log(at_pos / at_neg)))
            rate = min(0.5, max(1e-4, docs_pos / docs))
            self.bias = math.log(rate / (1 - rate))
            # An unlabelled passage counts by a part only, so that no other kind of text takes the class over.
            p = [1.0 if t else self.trust * self.probability(f) for f, t, _ in passages]
        return self

    def score(self, features: Iterable[str]) -> float:
        get = self.weight.get
        return self.bias + sum(get(x, 0.0) for x in features)

    def probability(self, features: Iterable[str]) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.score(features)))))


class Detector:
    def __init__(self):
        self.words, self.marks = Bayes(), Bayes(least=1, smooth=0.2)

    def fit(self, texts: list[tuple[str, bool]], sure: list[tuple[str, bool]] = (), weight: int = 1) -> "Detector":
        """texts: (text, whether it is a template), each standing for `weight` records. sure: further records of which
        only the trusted passages count, once each."""
        by_words: Counter = Counter()
        by_marks: Counter = Counter()
        for batch, n in ((texts, weight), (sure, 0)):
            for text, template in batch:
                for s in sentences(text):
                    trusted = bool(TRUSTED.search(s))
                    if n or trusted:
                        by_words[(sentence_features(s), trusted)] += 1 if trusted and sure else n
                for sign, f in signs(text, template):
                    trusted = _open(sign, f)
                    if n or trusted:
                        by_marks[(f, trusted)] += 1 if trusted and sure else n
        self.words.fit([(f, t, n) for (f, t), n in by_words.items()])
        self.marks.fit([(f, t, n) for (f, t), n in by_marks.items()])
        return self

    def residue(self, text: str, template: bool) -> bool:
        for _, f in signs(text, template):
            if self.marks.score(f) > 0:
                return True
        return any(self.words.score(sentence_features(s)) > 0 for s in sentences(text))


def fit_sample(texts: DataFrame, rows: int = FIT_ROWS, wide: int = 10) -> tuple[list, list, int]:
    """At most `rows` texts, the first by a hash of their key and so alike at each run; of `wide` times as many, those with
    a trusted passage (again at most `rows`); how many records one of the former stands for, as against the latter. The
    number of rows comes from the files' footers; both samples come from one pass."""
    total = texts.count()
    code = F.xxhash64("record_key", "record_kind")
    place = F.pmod(code, F.lit(max(1, -(-total // rows))))
    # Every text that may hold a trusted passage: signs that _open trusts have one of these characters or words.
    known = F.col("text").rlike("(?i)" + TRUSTED.pattern) | F.col("text").rlike(r"[\[{<@_(]|XXX|(?i)nan")
    asked = texts.where(F.length(F.trim("text")) > 0).select("text", "record_kind", (place == 0).alias("few"), place.alias("place"), code.alias("code"))
    asked = asked.where(F.col("few") | (F.col("place") < wide) & known).drop("place")

    def trusted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[few or has_trusted(x, k == "template") for x, k, few in zip(b["text"], b["record_kind"], b["few"])]]

    held = asked.mapInPandas(trusted, "text string, record_kind string, few boolean, code long")
    first = F.row_number().over(W.partitionBy("few").orderBy("code", "record_kind", "text"))
    most = F.when(F.col("few"), rows + rows // 4).otherwise(rows)
    got = held.withColumn("r", first).where((F.col("r") <= rows + rows // 4) & (F.col("r") <= most)).orderBy("few", "r").collect()
    shape = lambda few: [(r["text"], r["record_kind"] == "template") for r in got if r["few"] == few]
    return shape(True), shape(False), max(1, min(wide, -(-total // rows)))


def mark_residue(texts: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """texts (record_kind, record_key, text) that are residue: (record_kind, record_key). The model is fitted on samples
    of at most fit_rows records (a parameter); every record is scored in full. No shuffle."""
    few, sure, weight = fit_sample(texts, fit_rows)
    texts = texts.where(F.length(F.trim("text")) > 0)
    shared = share(texts.sparkSession, Detector().fit(few, sure, weight))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d, known = opened(shared), {}
        for b in batches:
            hit = []
            for text, kind in zip(b["text"], b["record_kind"]):
                bad = any(d.marks.score(f) > 0 for _, f in signs(text, kind == "template"))
                for s in sentences(text) if not bad else ():
                    if s not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[s] = d.words.score(sentence_features(s)) > 0
                    if known[s]:
                        bad = True
                        break
                hit.append(bad)
            yield b.loc[hit, ["record_kind", "record_key"]]

    return texts.select("record_kind", "record_key", "text").mapInPandas(run, "record_kind string, record_key long")
