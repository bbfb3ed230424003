"""Column expressions over prompt text, placeholders, slot names and content ids."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotweave.functions import values as V

PLACEHOLDER = r"\{(\w+)\}"


def blank(c: str | Column) -> Column:
    """True for null, empty and white-space-only text."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (F.length(F.regexp_replace(c, r"\s+", "")) == 0)


def word_count(c: Column) -> Column:
    """White-space words; 0 for null and blank."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(c.isNull() | (t == ""), 0).otherwise(F.size(F.split(t, r"\s+")))


def content_id(*parts: Column, length: int = 10) -> Column:
    """The first characters of an md5 over the parts joined by a bar; null if a part is."""
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.lit("|"), p)
    return F.substring(F.md5(joined), 1, length)


def placeholders(c: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(c, F.lit(PLACEHOLDER), F.lit(1)), F.array().cast("array<string>"))


def framing_words(c: Column) -> Column:
    """Words of a template outside its placeholders."""
    return word_count(F.regexp_replace(c, r"\{\w+\}", ""))


def replace_first(text: Column, find: Column, by: Column) -> Column:
    at = F.position(find, text)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), by, F.substring(text, at + F.length(find), F.length(text)))).otherwise(text)


def fill_all(text: Column, pairs: Column) -> Column:
    """Replaces every {slot} by its value; pairs: array of (slot, value), applied in order."""
    return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, F.concat(F.lit("{"), p["slot"], F.lit("}")), p["value"]))


def canonical_slot(slot: Column) -> Column:
    """The canonical name of a slot that is an alias, a single letter, numbered or a collection; null if it stays as it
    is. One pass: n1 becomes n, not number; a name of digits alone stays."""
    aliases = F.create_map(*[F.lit(x) for kv in V.SLOT_ALIASES.items() for x in kv])
    letters = F.create_map(*[F.lit(x) for k, v in V.SINGLE_LETTERS.items() for x in (k, v, k.upper(), v)])
    base = F.regexp_replace(F.regexp_extract(slot, "^([a-zA-Z][a-zA-Z0-9_]*?)([0-9]+)$", 1), "_+$", "")
    ends = "(" + "|".join(V.COLLECTION_SUFFIXES) + ")$"
    stem = F.regexp_replace(F.lower(slot), ends, "")
    return F.coalesce(
        F.element_at(aliases, slot), F.element_at(letters, slot), F.when(base != "", base),
        F.when(F.lower(slot).rlike("^.+" + ends), stem),
    )


def inferred_level(slot: Column) -> Column:
    """The level whose keywords the slot name holds, task_type if none."""
    out = F.lit("task_type")
    for level, keys in reversed(V.LEVEL_KEYWORDS.items()):
        out = F.when(F.lower(slot).rlike("|".join(keys)), level).otherwise(out)
    return out


def instruction_text(*fields: Column) -> Column:
    """The non-blank ones of several text columns, a line each."""
    return F.array_join(F.filter(F.array(*fields), lambda x: ~blank(x)), "\n")
