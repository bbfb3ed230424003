"""One field, several values: candidate cuts of a text and the likeliest way through them."""

import json
import math
import re

#: How likely a sign between two items is to part them, before anything is learned from the column.
SEPARATORS = [
    (r"\s*\r?\n\s*(?:(?:[-*•–]|\(?\d+[.)])\s+)?", 0.995),
    (r"\s*[;|·、，；\t]\s*(?:\(?\d+[.)]\s+)?", 0.98),
    (r"\s*,\s*(?:and|or|und|oder|y|o)\s+(?=\S)", 0.99),
    (r"\s*(?<!\d),\s*|\s*,(?!\d{3}(?!\d))\s*", 0.99),
    (r"\s+[/+]\s+", 0.9),
    (r"\s+(?:and|or|und|oder|y|&)\s+", 0.35),
    (r"(?<=\S)[/&+](?=\S)", 0.05),
]
_CUT = re.compile("|".join(f"({p})" for p, _ in SEPARATORS))
_NUMBERED = re.compile("|".join(f"({p})" for p, _ in [*SEPARATORS[:4], (r"\s+\(?\d+[.)]\s+", 0.99), *SEPARATORS[4:]]))
_MARK = re.compile(r"\s*(?:[-*•–]|\(?\d+[.)])\s+")
_PAIRS = {'"': '"', "'": "'", "“": "”", "«": "»", "„": "“", "‘": "’", "`": "`"}
_BRACKETS = {"(": ")", "[": "]", "{": "}"}
_ENDS = re.compile(r"\s*(?:[,;|/+·、，；\t\n\r]|and\b|or\b|$)")
#: Pieces up to which every span of a value is a possible item. In a value of more pieces, longer spans are possible items if
#: only weak separators are inside, if they are the whole value, or if they are a whole value or quoted elsewhere (see known).
LONGEST = 12
WEAK = 0.9


def _shield(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with everything inside quotes, brackets and escapes blotted out; where whole items are quoted."""
    out, quoted, i, fresh = list(text), [], 0, True
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            out[i] = out[i + 1] = "\0"
            i, fresh = i + 2, False
            continue
        if c in _PAIRS and (fresh or c != "'"):
            end, close = i + 1, _PAIRS[c]
            while end < len(text):
                if text[end] == close:
                    if text[end + 1 : end + 2] == close:
                        end += 2
                        continue
                    if c not in "'`‘" or _ENDS.match(text, end + 1):
                        break
                end += 1
            if end < len(text) and (c == '"' or fresh):
                out[i : end + 1] = "\0" * (end + 1 - i)
                if fresh and _ENDS.match(text, end + 1):
                    quoted.append((i, end + 1))
                i, fresh = end + 1, False
                continue
        if c in _BRACKETS and not (fresh and re.match(r"\(\d+\)\s", text[i:])):
            depth, end = 0, i
            while end < len(text):
                depth += (text[end] == c) - (text[end] == _BRACKETS[c])
                if not depth:
                    break
                end += 1
            if end < len(text):
                out[i : end + 1] = "\0" * (end + 1 - i)
                i, fresh = end + 1, False
                continue
        if c in ",;|/+·、，；\t\n\r":
            fresh = True
        elif not c.isspace():
            fresh = fresh and bool(re.match(r"[-*•–\d.()]", c))
        i += 1
    return "".join(out), quoted


def _bare(text: str) -> str:
    """An item without the quotes around it and the escapes in it."""
    text = text.strip()
    if len(text) > 1 and text[0] in _PAIRS and text[-1] == _PAIRS[text[0]]:
        inner = text[1:-1]
        if text[0] not in inner.replace(text[0] * 2, ""):
            text = inner.replace(text[0] * 2, text[0]).strip()
    return re.sub(r"\\([,;|/\\\"'])", r"\1", text).strip()


def pieces(value: str) -> tuple[list[tuple[int, int]], list[float], str]:
    """Where the smallest pieces of value lie, how likely each gap between them is to part items, and the text they lie in."""
    text = value.strip()
    if len(text) > 1 and text[0] in _BRACKETS and text[-1] == _BRACKETS[text[0]]:
        masked, _ = _shield(text)
        if not masked.strip("\0"):
            inner = _shield(text[1:-1])[0]
            if _CUT.search(inner):
                text = text[1:-1]
    masked, _ = _shield(text)
    mark = _MARK.match(masked)
    cut = _NUMBERED if mark and masked.lstrip(" (")[:1].isdigit() else _CUT
    priors = [p for _, p in SEPARATORS]
    if cut is _NUMBERED:
        priors = [*priors[:4], 0.99, *priors[4:]]
    spans, gaps, at = [], [], mark.end() if mark else 0
    several = False
    for m in cut.finditer(masked, at):
        if m.end() == m.start():
            continue
        p = priors[m.lastindex - 1]
        if p == 0.35 and several:
            p = 0.9
        several |= p >= 0.9
        spans.append((at, m.start()))
        gaps.append(p)
        at = m.end()
    spans.append((at, len(text)))
    kept = [k for k, (a, b) in enumerate(spans) if text[a:b].strip()]
    joined = [max(gaps[a:b]) if b - a > 1 else gaps[a] for a, b in zip(kept, kept[1:])]
    return [spans[k] for k in kept], joined, text


def _listed(value: str) -> list[str] | None:
    """The items of a JSON list of plain things."""
    if value.strip()[:1] != "[":
        return None
    try:
        items = json.loads(value)
    except ValueError:
        return None
    if not isinstance(items, list) or any(isinstance(x, (list, dict)) for x in items):
        return None
    return [s for s in (str(x).strip() for x in items if x is not None) if s]


def long_texts(value: str) -> tuple[list[str], list[tuple[str, list[str]]]]:
    """The pieces of a value of more than LONGEST pieces (else none); and the names of so many pieces that it gives: itself
    and its quoted pieces, each with its pieces."""
    if _listed(value) is not None:
        return [], []
    at, _, text = pieces(value)
    inner = [_bare(text[a:b]) for a, b in at if text[a] in _PAIRS]
    whole = [text[a:b].strip() for a, b in at] if len(at) > LONGEST else []
    names = [(text, whole)] if whole else []
    for x in dict.fromkeys(inner):
        found, _, held = pieces(x) if x else ([], [], x)
        if len(found) > LONGEST:
            names.append((x, [held[a:b].strip() for a, b in found]))
    return whole, names


def lattice(value: str, known: list[str] = ()) -> tuple[list[int], list[int], list[str], list[float]]:
    """Every item that the value may hold: first and last piece and text; and the gaps' priors. known: texts of more than
    LONGEST pieces that are whole values somewhere, or quoted."""
    items = _listed(value)
    if items is not None:
        return list(range(len(items))), list(range(len(items))), items, [1.0] * max(0, len(items) - 1)
    at, gaps, text = pieces(value)
    n = len(at)
    ends = [min(i + LONGEST, n) for i in range(n)]
    spans = {(i, j) for i in range(n) for j in range(i, ends[i])} | ({(0, n - 1)} if n else set())
    i = 0
    while n > LONGEST and i < n:
        j = i
        while j < n - 1 and gaps[j] < WEAK:
            j += 1
        spans |= {(a, b) for a in range(i, j) for b in range(a + LONGEST, j + 1)}
        i = j + 1
    begin, end = {a: i for i, (a, _) in enumerate(at)}, {b: j for j, (_, b) in enumerate(at)}
    for name in known:
        found = text.find(name)
        while found >= 0:
            if found in begin and found + len(name) in end:
                spans.add((begin[found], end[found + len(name)]))
            found = text.find(name, found + 1)
    first, last, texts = [], [], []
    for i, j in sorted(spans):
        if any(g >= 0.999 for g in gaps[i:j]):
            continue
        item = _bare(text[at[i][0] : at[j][1]])
        if item:
            first.append(i)
            last.append(j)
            texts.append(item)
    return first, last, texts, gaps


def _log_item(count: float, own: float, length: int, inner: list[float], total: float) -> float:
    """An item that no other value holds is spelled letter by letter, and then hardly holds a usual separator."""
    spelled = 0.01 * math.exp(-0.3 * min(length, 200)) * 1e-9 ** sum(p >= 0.9 for p in inner)
    return math.log(max(count - own, 0.0) + spelled + 1e-290) - math.log(total)


def posterior(first, last, texts, gaps, counts, own, total) -> list[float]:
    """How often each item is expected in the value, over all ways through the lattice (sum-product)."""
    n = len(gaps) + 1
    score = _scores(first, last, texts, gaps, counts, own, total)
    alpha, beta = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    alpha[0] = beta[n] = 0.0
    order = sorted(range(len(texts)), key=lambda k: first[k])
    for k in order:
        alpha[last[k] + 1] = _add(alpha[last[k] + 1], alpha[first[k]] + score[k])
    for k in reversed(order):
        beta[first[k]] = _add(beta[first[k]], beta[last[k] + 1] + score[k])
    if alpha[n] == -math.inf:
        return [0.0] * len(texts)
    return [math.exp(min(0.0, alpha[first[k]] + score[k] + beta[last[k] + 1] - alpha[n])) for k in range(len(texts))]


def viterbi(first, last, texts, gaps, counts, own, total) -> list[str]:
    """The items on the likeliest way; among equals the one with fewer cuts."""
    n = len(gaps) + 1
    score = _scores(first, last, texts, gaps, counts, own, total)
    best: list[tuple[float, int, int]] = [(-math.inf, 0, -1)] * (n + 1)
    best[0] = (0.0, 0, -1)
    for k in sorted(range(len(texts)), key=lambda k: first[k]):
        s, cuts, _ = best[first[k]]
        best[last[k] + 1] = max(best[last[k] + 1], (s + score[k], cuts - 1, k))
    out, at = [], n
    while at > 0 and best[at][2] >= 0:
        k = best[at][2]
        out.append(texts[k])
        at = first[k]
    return out[::-1] if at == 0 else []


def _scores(first, last, texts, gaps, counts, own, total) -> list[float]:
    cut = [math.log(max(p, 1e-9)) for p in gaps] + [0.0]
    keep = [math.log(max(1 - p, 1e-9)) for p in gaps]
    return [_log_item(counts[k], own[k], len(texts[k]), gaps[first[k] : last[k]], total) + sum(keep[first[k] : last[k]]) + cut[last[k]] for k in range(len(texts))]


def _add(a: float, b: float) -> float:
    if a == -math.inf:
        return b
    return max(a, b) + math.log1p(math.exp(-abs(a - b))) if b != -math.inf else a
