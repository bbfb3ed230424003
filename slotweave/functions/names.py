"""Freely typed names against a reference list: normal forms, then a BK-tree for misspellings."""

import itertools
import re
import unicodedata

from slotweave.functions.bktree import BKTree, Block, damerau

#: Words that people put before or after a name without meaning another one.
LEADING = frozenset("the a an my your our this that".split())
TRAILING = frozenset("list set values value items item array optional required field slot name names".split())
_VOWELS = re.compile(r"[aeiou]")
_ENCLOSED = re.compile(r"\s*[(\[{][^()\[\]{}]*[)\]}]\s*$")


def words(name: str) -> list[str]:
    """The words of a name, whatever case, separators, brackets or humps it is typed in."""
    s = unicodedata.normalize("NFKC", name).strip().strip("{}[]<>").strip()
    bare = _ENCLOSED.sub("", s)
    s = bare if re.search(r"\w", bare) else s
    humped = not re.search(r"[^\W_][\s_.\-]+[^\W_]", s) and sum(c.islower() for c in s) > sum(c.isupper() for c in s)
    if humped:
        s = re.sub(r"(?<=[^\W\d_A-Z])(?=[A-Z])", " ", s)
    return re.findall(r"[^\W\d_]+|\d+", s.casefold())


def skeleton(word: str) -> str:
    return word[:1] + _VOWELS.sub("", word[1:])


def allowed(length: int) -> int:
    """Misspellings (Damerau-Levenshtein) that a form of so many letters may have and still be meant."""
    return 0 if length < 4 else 1 if length < 6 else 2


class NameMatcher:
    """entries: (id, name, aliases). match() gives for each name the id that is meant, or -1."""

    def __init__(self, entries: list[tuple[int, str, list[str]]], reach: int = 4):
        self.reach = reach
        forms: dict[str, dict[int, int]] = {}  # form -> id -> rank of the kind of form
        short: dict[str, dict[int, str]] = {}  # abbreviation -> id -> the form that it stands for
        for key, name, aliases in entries:
            for rank, text in ((0, name), *((1, a) for a in aliases or [] if a)):
                w = words(text)
                if not w:
                    continue
                form = "".join(w)
                self._put(forms, form, key, rank)
                if 2 <= len(w) <= 4:
                    for p in itertools.permutations(w):
                        self._put(forms, "".join(p), key, 2 + rank)
                cuts = [[x, *dict.fromkeys(x[:n] for n in (3, 4, 5) if n < len(x))] for x in w[:4]]
                for p in itertools.product(*cuts) if len(w) > 1 else []:
                    if sum(map(len, p)) >= 6:
                        short.setdefault(" ".join(p), {}).setdefault(key, form)
                if sum(len(skeleton(x)) for x in w) >= 4:
                    short.setdefault(" ".join(map(skeleton, w)), {}).setdefault(key, form)
        #: The entry of each form: the nearest kind of form, then the smallest id.
        self.entry = {f: min((rank, k) for k, rank in ids.items()) for f, ids in forms.items()}
        #: What an abbreviation stands for: the id and its form, or two ids where it is not clear.
        self.short = {a: sorted(ids.items())[:2] for a, ids in short.items()}
        self.tree = BKTree(list(self.entry))
        self.longest = max(map(len, self.entry), default=0)

    @staticmethod
    def _put(forms: dict[str, dict[int, int]], form: str, key: int, rank: int) -> None:
        kept = forms.setdefault(form, {})
        kept[key] = min(rank, kept.get(key, rank))

    def _variants(self, name: str) -> list[list[str]]:
        w = words(name)
        out = [w]
        while w and w[-1].isdigit() and len(w) > 1:
            w = w[:-1]
        out.append(w)
        while len(w) > 1 and w[0] in LEADING:
            w = w[1:]
        out.append(w)
        if len(w) > 1 and w[-1] in TRAILING:
            out.append(w[:-1])
        return [list(v) for v in dict.fromkeys(map(tuple, out)) if v]

    def findings(self, names: list[str]) -> list[list[tuple[int, int, int, int, int]]]:
        """For each name what speaks for which entry: (stage, distance, Levenshtein distance, rank, id), the least counts.
        Stages are those of the name's variants in turn, written out, as an abbreviation, in the singular; then, last, all
        misspellings together. An abbreviation gives up to two ids: it counts only if all lists of entries have one."""
        out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in names]
        asked: dict[str, list[tuple[int, int, bool]]] = {}  # text -> name, stage, whether misspellings count
        for i, name in enumerate(names):
            for v, w in enumerate(self._variants(name)):
                text = "".join(w)
                asked.setdefault(text, []).append((i, 3 * v, True))
                for key, form in self.short.get(" ".join(w), ()):
                    out[i].append((3 * v + 1, 0, 0, self.entry[form][0], key))
                if text.endswith("s"):
                    asked.setdefault(text[:-1], []).append((i, 3 * v + 2, False))
        # A longer text is more than `reach` from every form.
        texts = [t for t in asked if len(t) <= self.longest + self.reach]
        for row, node, d in self.tree.search(Block(texts), self.reach):
            text, form = texts[row], self.tree.words[node]
            rank, key = self.entry[form]
            for i, stage, loose in asked[text] if d == 0 else ():
                out[i].append((stage, 0, 0, rank, key))
            most = allowed(min(len(form), len(text) + 1))
            if 0 < d <= 2 * most and any(loose for *_, loose in asked[text]):
                exact = damerau(text, form)
                if exact <= most:
                    for i, _, loose in asked[text]:
                        if loose:
                            out[i].append((MISSPELT, exact, d, rank, key))
        return out

    def match(self, names: list[str]) -> list[tuple[int, int]]:
        """(id, distance) of each name; (-1, -1) where nothing is near enough. Ties: the nearer kind of form, then the smaller id."""
        return [settled(f) for f in self.findings(names)]


#: The stage of misspellings, behind those of any variant.
MISSPELT = 1_000


def settled(findings: list[tuple[int, int, int, int, int]]) -> tuple[int, int]:
    """(id, distance) that the findings of one name lead to, whichever lists of entries they come from."""
    unclear = {s for s in {f[0] for f in findings} if s < MISSPELT and s % 3 == 1 and len({f[4] for f in findings if f[0] == s}) > 1}
    least = min((f for f in findings if f[0] not in unclear), default=None)
    return (least[4], least[1]) if least else (-1, -1)
