"""Several values packed in one field: EM segmentation over the whole column, then Viterbi."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.functions import packing
from slotweave.operators.mapping import mapped
from slotweave.operators.skew import salted_join
from slotweave.session import cut

_LATTICE = "id long, value string, n long, first array<int>, last array<int>, texts array<string>, gaps array<double>, own array<double>"


def _lattices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, value, n, known in zip(b["id"], b["value"], b["n"], b["known"]):
            first, last, texts, gaps = packing.lattice(value, [] if known is None else list(known))
            own = packing.posterior(first, last, texts, gaps, [1.0] * len(texts), [0.0] * len(texts), 1.0)
            rows.append((i, value, n, first, last, texts, gaps, own))
        yield pd.DataFrame(rows, columns=["id", "value", "n", "first", "last", "texts", "gaps", "own"])


def _expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["own"] = [packing.posterior(*x) for x in zip(b["first"], b["last"], b["texts"], b["gaps"], _counts(b), b["own"], b["total"])]
        yield b[["id", "value", "n", "first", "last", "texts", "gaps", "own"]]


def _best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"value": b["value"], "n": b["n"], "items": [packing.viterbi(*x) for x in zip(b["first"], b["last"], b["texts"], b["gaps"], _counts(b), b["own"], b["total"])]})


def _long_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, code, name): of each value of more than LONGEST pieces a code of LONGEST pieces in a row at each place, name
    null; and of each name of so many pieces its first ones' code."""
    import xxhash

    code = lambda texts: xxhash.xxh64_intdigest("\0".join(texts[: packing.LONGEST])) - (1 << 63)
    for b in batches:
        rows = []
        for i, value in zip(b["id"], b["value"]):
            whole, names = packing.long_texts(value)
            rows += [(i, code(whole[at : at + packing.LONGEST]), None) for at in range(len(whole) - packing.LONGEST + 1)]
            rows += [(i, code(texts), name) for name, texts in names]
        yield pd.DataFrame(rows, columns=["id", "code", "name"])


def _with_known(distinct: DataFrame) -> DataFrame:
    """known: for each value of more than LONGEST pieces the names of as many that may lie in it whole, as both have the
    first LONGEST pieces of them in a row. Few values are that long, and the others take no part in the join."""
    codes = cut(distinct.mapInPandas(_long_pieces, "id long, code long, name string"))
    places = codes.where("name is null").select("id", "code").distinct()
    names = codes.where("name is not null").select("code", "name").distinct()
    n = places.groupBy("code").agg(F.count("*").alias("_n"))
    known = salted_join(places, names.join(n, "code"), ["code"], "_n", F.col("id")).groupBy("id").agg(F.collect_set("name").alias("known"))
    return distinct.join(known, "id", "left")


def _with_counts(lattices: DataFrame) -> DataFrame:
    """Each lattice with the column-wide expected count of its candidate items, given as places (at) and counts there, and
    the sum of all counts. An item that one value alone holds needs no lookup: its count is that value's own."""
    spans = lattices.select("id", F.posexplode(F.arrays_zip("texts", "own")).alias("k", "x")).select("id", "k", F.col("x.texts").alias("item"), F.col("x.own").alias("w"))
    lexicon = cut(spans.groupBy("item").agg(F.sum("w").alias("c"), F.count("*").alias("spans")))
    total = lexicon.agg(F.sum("c").alias("total"))
    shared = salted_join(spans.select("id", "k", "item"), lexicon.where("spans > 1"), ["item"], "spans", F.col("id"))
    counts = shared.groupBy("id").agg(F.collect_list("k").alias("at"), F.collect_list("c").alias("counts"))
    return lattices.join(counts, "id", "left").crossJoin(F.broadcast(total))


def _counts(b: pd.DataFrame) -> list[np.ndarray]:
    out = []
    for own, at, counts in zip(b["own"], b["at"], b["counts"]):
        c = np.array(own, dtype=np.float64)
        if at is not None:
            c[np.asarray(at)] = counts
        out.append(c)
    return out


def split_packed(values: DataFrame, rounds: int = 2) -> DataFrame:
    """(value, n, items): the distinct non-blank texts of column value, how many rows have each, and its items in order.

    Quoted, bracketed and escaped spans are never cut; between the other pieces the cuts are chosen that make the items
    likeliest, item frequencies being learned from the whole column by `rounds` rounds of expectation-maximisation. What
    a value itself adds to a count is left out when that value is judged. Null and blank values give no row; a value
    with one item gives one item; repeated items are kept."""
    distinct = cut(values.where(F.trim("value") != "").groupBy("value").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    lattices = cut(_with_known(distinct).mapInPandas(_lattices, _LATTICE).where(F.size("texts") > 0))
    for _ in range(rounds - 1):
        lattices = cut(_with_counts(lattices).mapInPandas(_expect, _LATTICE))
    return _with_counts(lattices).mapInPandas(_best, "value string, n long, items array<string>")


def packed_options(options: DataFrame, catalog: DataFrame) -> DataFrame:
    """(option_seq, item_pos, item_text) for each item of each option of a list-like slot whose value packs two or more.
    catalog: slot_id, slot_name, known_aliases, list_like."""
    rows = mapped(options.select("option_seq", "slot", "value").where("trim(value) <> '' and trim(slot) <> ''"), "slot", catalog)
    listed = catalog.where("list_like").select("slot_id").distinct()
    rows = cut(rows.join(listed, "slot_id", "left_semi").select("option_seq", "value"))
    items = cut(split_packed(rows.select("value")).where(F.size("items") > 1))
    return salted_join(rows, items, ["value"], "n", F.col("option_seq")).select("option_seq", F.posexplode("items").alias("p", "item_text")).select("option_seq", (F.col("p") + 1).cast("int").alias("item_pos"), "item_text")
