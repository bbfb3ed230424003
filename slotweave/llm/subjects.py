"""Subject areas of documents: one-versus-rest linear classifiers on hashed word n-grams, judged sentence by sentence.

Labels come from the labelled examples and weakly from metadata (the words of source, section and path, where they name a
subject or go with one) and, where examples have no text in a language, from words that head sections in that language
(WEAK_WORDS); unlabelled documents in which one subject leads add the words that stand under no other. A sentence
bears a subject if the calibrated probability is high enough; a document treats each subject that bears at least a
quarter of its subject-bearing sentences, so remarks on form, tone and procedure don't count.

Null and blank texts, and texts without a subject, give no row; texts are read to their end."""

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.session import opened, share

#: n-grams are hashed to so many bits; only those seen LEAST times while learning have weights.
BITS, LEAST = 24, 5
#: Words of Spanish and German section headings, by subject.
WEAK_WORDS = {
    "natural_science": "átomo enzima glaciar telescopio espectro Atomkern Enzym Gletscher Teleskop Spektrum",
    "law": "sentencia jurado demandante juzgado testigo Gericht Urteil Gesetz Klägerin Zeugenaussage",
    "sport": "portero árbitro entrenador delantero liga Torwart Trainer Stürmer Schiedsrichter Elfmeter",
    "software": "compilador servidor código repositorio datos Datenbank Server Compiler Quelltext Schnittstelle",
    "medicine": "cirujano paciente vacuna fiebre antibiótico Chirurgin Patient Impfung Fieber Antibiotikum",
    "finance": "hipoteca dividendo inflación préstamo factura Hypothek Dividende Inflation Kredit Rechnung",
    "cooking": "horno sartén salsa ajo levadura Backofen Pfanne Soße Knoblauch Hefe",
    "travel": "maleta equipaje albergue vuelo playa Koffer Gepäck Herberge Flug Strand",
    "history": "imperio monasterio dinastía asedio tratado Kaiserreich Kloster Dynastie Belagerung Friedensvertrag",
    "music": "guitarra orquesta violín melodía coro Gitarre Orchester Geige Melodie Chor",
    "agriculture": "cosecha tractor trigo viñedo riego Ernte Traktor Weizen Weinberg Bewässerung",
    "education": "alumno examen maestra beca aula Schülerin Prüfung Lehrer Stipendium Klassenzimmer",
}
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”»)]*\s+|[\r\n]+\s*(?=[^a-z\s])")
_WORD = re.compile(r"[^\W\d_]+")
#: Below this part of all sentences, what bears a subject is a passing mention.
PASSING = 0.1
#: Documents that the model sees at most while it learns from unlabelled text.
FIT_DOCUMENTS = 6_000


def _slot(gram: str) -> int:
    return zlib.crc32(gram.encode()) & ((1 << BITS) - 1)


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


class Grams:
    """The hashed unigrams and bigrams of a sentence; with rows, only those that have a row, as row numbers."""

    def __init__(self, rows: dict[int, int] | None = None):
        self.known: dict[str, int] = {}
        self.rows = rows

    def __call__(self, sentence: str) -> list[int]:
        w = _WORD.findall(sentence.casefold())
        known, out = self.known, []
        rows = self.rows
        if len(known) > 1_000_000:
            known.clear()
        for g in (*w, *map(" ".join, zip(w, w[1:]))):
            h = known.get(g)
            if h is None:
                h = _slot(g)
                if rows is not None:
                    h = rows.get(h)
                    if h is None:  # names and chance neighbours: too many to be kept
                        continue
                known[g] = h
            out.append(h)
        return list(dict.fromkeys(out))


class Subjects:
    def __init__(self, names: list[str], rows: dict[int, int]):
        self.names, self.rows = names, rows
        self.weights = np.zeros((len(rows), len(names)), dtype=np.float32)
        self.bias = np.full(len(names), -2.0, dtype=np.float32)
        self.least = np.full(len(names), 0.5, dtype=np.float32)

    def fit(self, rows: list[tuple[list[int], np.ndarray, float]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-4) -> "Subjects":
        """Logistic regressions, one a subject, by AdaGrad over rows in a fixed shuffled order."""
        w = np.zeros_like(self.weights)
        square = np.full_like(w, 0.1)
        bias = np.full_like(self.bias, -2.0)
        order = np.random.default_rng(7)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                at, target, weight = rows[i]
                if not at:
                    continue
                p = 1 / (1 + np.exp(-(w[at].sum(0) + bias)))
                g = weight * (p - target)
                square[at] += g * g
                w[at] -= rate * (g + decay * w[at]) / np.sqrt(square[at])
                bias -= 0.01 * g
        self.weights, self.bias = w, bias
        return self

    def scores(self, at: list[int]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.weights[at].sum(0) + self.bias))) if at else np.zeros(len(self.names))

    def bearing(self, at: list[int]) -> int:
        """The subject that a sentence bears, or -1."""
        if not at:
            return -1
        p = self.scores(at)
        k = int(np.argmax(p))
        return k if p[k] >= self.least[k] else -1

    def bearing_all(self, rows: list[list[int]]) -> np.ndarray:
        """bearing() of many sentences at once."""
        out = np.full(len(rows), -1, dtype=np.int64)
        size = np.array([len(r) for r in rows])
        some = np.flatnonzero(size)
        for at in np.array_split(some, max(1, len(some) // 20_000)):
            if not len(at):
                continue
            flat = np.fromiter((x for i in at for x in rows[i]), dtype=np.int64, count=int(size[at].sum()))
            z = np.add.reduceat(self.weights[flat], np.r_[0, np.cumsum(size[at])[:-1]], axis=0) + self.bias
            k = z.argmax(1)
            p = 1 / (1 + np.exp(-z[np.arange(len(at)), k]))
            out[at] = np.where(p >= self.least[k], k, -1)
        return out

    def calibrate(self, rows: list[tuple[list[int], np.ndarray, float]], wanted: float = 0.95) -> None:
        """For each subject the least probability at which, on held-out rows, `wanted` of the sentences so marked are right."""
        p = np.array([self.scores(at) for at, _, _ in rows])
        y = np.array([t for _, t, _ in rows])
        if not len(rows):
            return
        top = p.argmax(1)
        for k in range(len(self.names)):
            mine = np.flatnonzero(top == k)
            best = 0.5
            for t in np.arange(0.3, 0.95, 0.05):
                m = mine[p[mine, k] >= t]
                if len(m) and y[m, k].mean() >= wanted:
                    best = t
                    break
            self.least[k] = best


def _pure(counts: dict[int, np.ndarray], base: np.ndarray, least: int, purity: float) -> dict[int, int]:
    """Grams that stand under one subject nearly always, subjects being weighed alike, and that subject."""
    out = {}
    for g, c in counts.items():
        if c.sum() >= least:
            r = c / base
            k = int(r.argmax())
            if r[k] >= purity * r.sum():
                out[g] = k
    return out


def _vote(grams: list[int], pure: dict[int, int], n: int) -> int:
    votes = [pure[g] for g in grams if g in pure]
    if not votes:
        return -1
    c = np.bincount(votes, minlength=n)
    k = int(c.argmax())
    return k if c[k] >= 0.7 * len(votes) else -1


def learn(names: list[str], examples: list[tuple[str, str]], unlabelled: list[str], metadata: list[tuple[str, ...]] = (), rounds: int = 2, rows: int = 40_000) -> Subjects:
    """Which grams belong to a subject is learned from the examples and WEAK_WORDS, then from the unlabelled documents in
    which one subject leads, or whose metadata (source, section, path) go with one subject nearly always; sentences with such grams (or without any) train the classifiers, at most `rows` of them."""
    grams, at, n = Grams(), {x: i for i, x in enumerate(names)}, len(names)
    counts: dict[int, np.ndarray] = {}
    labelled = [(grams(s), at[k]) for text, k in examples if k in at and text for s in sentences(text)]
    for g, k in labelled:
        for x in g:
            counts.setdefault(x, np.zeros(n))[k] += 1
    seeds = {grams(w.casefold())[0]: at[k] for k, ws in WEAK_WORDS.items() if k in at for w in ws.split()}
    pure = _pure(counts, np.maximum(1, np.bincount(np.array([k for _, k in labelled], dtype=int), minlength=n)), 4, 0.9) | seeds
    docs = [[grams(s) for s in sentences(t)] for t in unlabelled]
    # The metadata of a document: each value, and the words of it.
    marks = [[_slot(f"\0{x}") for v in m for x in {v.casefold(), *_WORD.findall(v.casefold().replace("_", " "))}] for m in metadata] or [[] for _ in docs]
    of_mark: dict[int, int] = {_slot(f"\0{x.casefold()}"): k for k, x in enumerate(names)}
    for _ in range(rounds):
        counts, base = {}, np.ones(n)
        for text, k in examples:
            if k in at and text:
                base[at[k]] += 1
                for x in {x for s in sentences(text) for x in grams(s)}:
                    counts.setdefault(x, np.zeros(n))[at[k]] += 1
        seen_marks: dict[int, np.ndarray] = {}
        led_by = np.ones(n)
        for d, m in zip(docs, marks):
            votes = [v for v in (_vote(g, pure, n) for g in d) if v >= 0]
            if len(votes) < 2:
                # Too few words are known: the metadata say what the document treats, if anything does.
                k = _vote(m, of_mark, n)
                if k < 0 or votes and votes[0] != k:
                    continue
            else:
                c = np.bincount(votes, minlength=n)
                k = int(c.argmax())
                if c[k] < 0.7 * len(votes):
                    continue
                led_by[k] += 1
                for x in m:
                    seen_marks.setdefault(x, np.zeros(n))[k] += 1
            base[k] += 1
            for x in {x for g in d for x in g}:
                counts.setdefault(x, np.zeros(n))[k] += 1
        of_mark |= _pure(seen_marks, led_by, 20, 0.9)
        pure = {g: k for g, k in seeds.items() if g not in counts or counts[g].sum() < 5} | _pure(counts, base, 4, 0.8)
    eye, none = np.eye(n, dtype=np.float32), np.zeros(n, dtype=np.float32)
    # Words that stand under three subjects or more tell none apart. A sentence of such words (but for one, as a name is)
    # bears no subject; one with several words that are not known bears its label, or none without one.
    common = {x for x, c in counts.items() if x not in pure and (c > 0).sum() >= 3}

    def target(g: list[int]) -> np.ndarray | None:
        k = _vote(g, pure, n)
        return eye[k] if k >= 0 else none if sum(x not in common for x in g) <= 3 else None

    def bears(g: list[int]) -> np.ndarray:
        t = target(g)
        return none if t is None else t

    sure = [(g, eye[k] if (t := target(g)) is None else t, 1.0) for g, k in labelled]
    held = sure[::5]
    often = Counter(tuple(g) for d in docs for g in d)
    all_rows = [(list(g), t, (2.0 if t.any() else 1.0) + min(6.0, math.log2(c))) for g, c in often.items() for t in [bears(g)]]
    step = max(1, -(-len(all_rows) // rows))
    seen = Counter(x for g, c in often.items() for x in g for _ in range(min(c, LEAST)))
    seen.update({x: LEAST for x in pure})
    place = {x: i for i, x in enumerate(sorted(x for x, c in seen.items() if c >= LEAST))}
    narrow = lambda rs: [([place[x] for x in g if x in place], t, w) for g, t, w in rs]
    sure, held, all_rows = narrow(sure), narrow(held), narrow(all_rows)
    model = Subjects(names, place).fit([r for i, r in enumerate(sure) if i % 5] + all_rows[::step], epochs=max(4, min(40, 100_000 // (len(sure) + len(all_rows[::step]) + 1))))
    model.calibrate(held + all_rows[1::step][:5000] if step > 1 else held)
    return model


def mark_subjects(documents: DataFrame, examples: list[tuple[str, str]], names: list[str], least_share: float = 0.25, fit_documents: int = FIT_DOCUMENTS, metadata: tuple[str, ...] = ("source", "doc_kind", "url")) -> DataFrame:
    """(doc_id, subject, sentences, held): for each document the subjects of at least `least_share` of its subject-bearing
    sentences. The model learns from the examples and at most fit_documents documents, the first by a hash of doc_id; every
    document is judged. metadata: columns whose values (and the words of paths in them) label documents weakly where they
    go with one subject nearly always."""
    total = documents.count()
    meta = [c for c in metadata if c in documents.columns]
    documents = documents.where("trim(text) <> ''").select("doc_id", "text", *meta)
    if not names:
        return documents.sparkSession.createDataFrame([], "doc_id long, subject string, sentences int, held double")
    code = F.xxhash64("doc_id")
    some = documents.where(F.pmod(code, F.lit(max(1, -(-total // fit_documents)))) == 0).orderBy(code, "doc_id").limit(fit_documents).collect()
    model = learn(names, examples, [r["text"] for r in some], [tuple(str(r[c]) for c in meta if r[c] is not None) for r in some])
    shared = share(documents.sparkSession, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, known = opened(shared), {}
        grams = Grams(m.rows)
        for b in batches:
            said = [sentences(t) for t in b["text"]]
            new = list({s for ss in said for s in ss if s not in known})
            fresh = dict(zip(new, m.bearing_all([grams(s) for s in new]).tolist()))
            rows = []
            for doc, ss in zip(b["doc_id"], said):
                count: dict[int, int] = {}
                for s in ss:
                    k = known[s] if s in known else fresh[s]
                    if k >= 0:
                        count[k] = count.get(k, 0) + 1
                n = sum(count.values())
                if n < PASSING * len(ss):
                    continue
                rows.extend((doc, m.names[k], c, c / n) for k, c in count.items() if c >= least_share * n)
            if len(known) < 50_000:
                known.update(fresh)
            yield pd.DataFrame(rows, columns=["doc_id", "subject", "sentences", "held"])

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, subject string, sentences int, held double")
