"""The taxonomy of option types: groups of values by slot, batches for a model, its replies, merging, links, retrieval; and
the taxonomy of labels: nested files, descriptions."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotweave.functions import backends
from slotweave.functions import text as X
from slotweave.functions import values as V
from slotweave.operators import vectors
from slotweave.operators.segment import repair

TYPES = "struct<categories:array<struct<name:string,types:array<struct<name:string,category:string,description:string,compatible_slots:array<string>,example_values:array<string>>>>>,types:array<struct<name:string,category:string,description:string,compatible_slots:array<string>,example_values:array<string>>>>"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def estimated_tokens(c: Column) -> Column:
    """A quarter of the characters."""
    return F.floor(F.length(c) / 4)


def groups(options: DataFrame, least: int = 2, most: int = 12, short: int = 50) -> DataFrame:
    """(slot, n_values, examples): each slot's values, the same but for case once, the first `most` in order of arrival; long
    ones as a preview. Slots with fewer than `least` different values are left out."""
    o = options.where(~X.blank("slot") & ~X.blank("value")).select(stripped(F.col("slot")).alias("slot"), stripped(F.col("value")).alias("value"), "token_length", "option_seq")
    one = o.groupBy("slot", F.lower("value").alias("_l")).agg(F.min("option_seq").alias("_s"), F.min_by(F.struct("value", "token_length"), "option_seq").alias("r"))
    show = F.when(F.coalesce("r.token_length", F.lit(0)) <= short, F.substring("r.value", 1, 120)).otherwise(F.concat(F.regexp_replace(F.substring("r.value", 1, 80), r"\s+$", ""), F.lit("…")))
    first = one.select("slot", "_s", show.alias("v"), F.row_number().over(W.partitionBy("slot").orderBy("_s")).alias("_r")).where(F.col("_r") <= most)
    n = one.groupBy("slot").agg(F.count("*").alias("n_values")).where(F.col("n_values") >= least)
    held = first.groupBy("slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("_s", "v"))), lambda x: x["v"]).alias("examples"))
    return n.join(held, "slot").select("slot", "n_values", "examples")


def represented(grouped: DataFrame, most: int = 8) -> DataFrame:
    """(slot, text): a slot as its name and first values."""
    return grouped.select("slot", F.concat("slot", F.lit(": "), F.array_join(F.slice("examples", 1, most), ", ")).alias("text"))


def batches(grouped: DataFrame, most: int = 6000) -> DataFrame:
    """(slot, tokens, shard, batch): slots in order of name, as many a batch as its estimated tokens stay within `most` (a
    larger slot has a batch of its own). The slots are cut into 256 shards by name, each batched by itself, so no task
    sees them all."""
    tokens = F.floor((F.length("slot") + F.aggregate("examples", F.lit(0), lambda a, x: a + F.length(x) + 4) + 6) / 4).cast("long")
    rows = grouped.select("slot", tokens.alias("tokens"), F.substring(F.md5("slot"), 1, 2).alias("shard"))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.iloc[sorted(range(len(b)), key=lambda i: b["slot"].iloc[i].encode())]
        at, used, out = 0, 0, []
        for t in b["tokens"]:
            if used and used + t > most:
                at, used = at + 1, 0
            used += t
            out.append(at)
        return b.assign(batch=out)

    return rows.groupBy("shard").applyInPandas(run, "slot string, tokens long, shard string, batch int")


def naming_messages(grouped: DataFrame, batched: DataFrame) -> DataFrame:
    """(key, prompt): what a model is asked about each batch: slots and values as one JSON object."""
    rows = grouped.join(batched.select("slot", "shard", "batch"), "slot")
    body = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "examples")))))
    return rows.groupBy(F.concat_ws("-", "shard", F.col("batch").cast("string")).alias("key")).agg(body.alias("prompt"))


def parsed_types(replies: DataFrame) -> DataFrame:
    """(key, pos, name, category, description, compatible_slots, example_values) from replies (key, reply): types under their
    categories or in one list; a type without category takes that above it, else its own name. What isn't JSON even after
    repair gives nothing."""
    clean = F.regexp_replace(F.regexp_replace("reply", r"(?s)<think>.*?</think>", ""), r"(?m)^\s*```\w*\s*$", "")
    direct = replies.select("key", "reply", F.from_json(clean, TYPES).alias("d"))
    direct = direct.withColumn("d", F.when(F.col("d.categories").isNotNull() | F.col("d.types").isNotNull(), F.col("d")).otherwise(F.from_json(repair(F.col("reply")), TYPES)))
    shape = lambda t, c: F.struct(t["name"].alias("name"), F.coalesce(t["category"], c).alias("category"), t["description"].alias("description"), t["compatible_slots"].alias("compatible_slots"), t["example_values"].alias("example_values"))
    nested = F.flatten(F.transform(F.filter("d.categories", lambda c: c["types"].isNotNull()), lambda c: F.transform(c["types"], lambda t: shape(t, F.coalesce(c["name"], F.lit(""))))))
    flat = F.transform("d.types", lambda t: shape(t, t["name"]))
    return direct.select("key", F.posexplode(F.coalesce(nested, flat)).alias("pos", "t")).select("key", "pos", "t.*")


def merged_types(entries: DataFrame, most: int = 8) -> DataFrame:
    """(name, category, description, compatible_slots, example_values): entries of one name (trimmed, lower-cased) as one, in
    the order of key and pos: the first category and description, all slots (the name itself first), the first `most`
    examples without their [tags]. Entries without name or description are dropped."""
    none = F.array().cast("array<string>")
    name = F.lower(stripped(F.col("name")))
    slots = F.filter(F.transform(F.coalesce("compatible_slots", none), stripped), lambda s: s != "")
    shown = F.transform(F.filter(F.coalesce("example_values", none), lambda v: v != ""), lambda v: F.regexp_replace(v, r"^\[\w+\]\s*", ""))
    e = entries.where(~X.blank("name") & ~X.blank("description")).select(
        "key", "pos", name.alias("name"), F.coalesce(F.nullif(F.lower(stripped(F.col("category"))), F.lit("")), name).alias("category"), stripped(F.col("description")).alias("description"),
        F.when(F.array_contains(slots, name), slots).otherwise(F.concat(F.array(name), slots)).alias("s"), F.slice(shown, 1, most).alias("v"),
    )
    order = F.struct("key", "pos")
    all_of = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("key", "pos", F.col(c).alias("a")))), lambda x: x["a"])))
    return e.groupBy("name").agg(F.min_by("category", order).alias("category"), F.min_by("description", order).alias("description"), all_of("s").alias("compatible_slots"), F.slice(all_of("v"), 1, most).alias("example_values"))


def cross_linked(types: DataFrame, grouped: DataFrame, make: Callable = backends.WordEmbedder, least: float = 0.6) -> DataFrame:
    """types with the names of similar types among their compatible_slots: the mean embedding of a type's slots has a cosine
    of at least `least` to the other's. Links go both ways."""
    slots = backends.embedded(represented(grouped), "text", make).select("slot", "embedding")
    m = vectors.means(types.select("name", F.explode("compatible_slots").alias("slot")).join(slots, "slot"), "name")
    pairs = vectors.links(m, "name", least)
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    new = both.groupBy(F.col("a").alias("name")).agg(F.array_sort(F.collect_set("b")).alias("_l"))
    return types.join(new, "name", "left").withColumn("compatible_slots", F.array_union("compatible_slots", F.coalesce("_l", F.array().cast("array<string>")))).drop("_l")


def retrieved(queries: DataFrame, types: DataFrame, make: Callable = backends.WordEmbedder, most: int = 20, least: float = 0.000001) -> DataFrame:
    """(query_id, name, score, rank): for each query (query_id, text) the types nearest to it, by name, description and five
    examples."""
    t = types.where("category <> '_uncategorized'").select("name", F.concat("name", F.lit(": "), "description", F.lit(" Examples: "), F.array_join(F.slice("example_values", 1, 5), ", ")).alias("text"))
    a = backends.embedded(queries.select("query_id", "text"), "text", make).select("query_id", "embedding")
    b = backends.embedded(t, "text", make).select(F.col("name").alias("vec_id"), "embedding")
    return vectors.top_k(a, b, k=most, least=least).withColumnRenamed("vec_id", "name")


def context(types: DataFrame) -> DataFrame:
    """(category, text): the types as a model is shown them: one line each with description, other slots and examples."""
    other = F.slice(F.filter("compatible_slots", lambda s: s != F.col("name")), 1, 5)
    line = F.concat(F.lit("    "), "name", F.lit(" — "), "description", F.when(F.size(other) > 0, F.concat(F.lit(" [also fits: "), F.array_join(other, ", "), F.lit("]"))).otherwise(""), F.lit(": "), F.array_join(F.slice("example_values", 1, 6), ", "))
    shown = types.where((F.col("category") != "_uncategorized") & (F.size("example_values") > 0)).withColumn("line", line)
    return shown.groupBy("category").agg(F.concat(F.lit("  ["), F.first("category"), F.lit("]\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "line"))), lambda x: x["line"]), "\n")).alias("text"))


def by_category(types: DataFrame) -> DataFrame:
    """(category, n, names)."""
    return types.groupBy("category").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


def flattened(nested: DataFrame) -> DataFrame:
    """(label, top): the leaf labels of a nested taxonomy file (column value: its JSON) and the branch that they are in. A
    branch whose parts hold dictionaries is gone into; a part without dictionaries is a leaf; names that begin with _ are
    none. A file is one small document."""

    def leaves(d: dict) -> Iterator[str]:
        for k, v in d.items():
            if k.startswith("_") or not isinstance(v, dict):
                continue
            below = {a: b for a, b in v.items() if isinstance(b, dict) and not a.startswith("_")}
            if any(isinstance(x, dict) for b in below.values() for a, x in b.items() if not a.startswith("_")):
                yield from leaves(v)
            elif below:
                yield from below
            else:
                yield k

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for b in batches:
            rows: dict[str, str] = {}
            for text in b["value"].dropna():
                for top, v in json.loads(text).items():
                    for x in leaves({top: v}):
                        rows.setdefault(x, top)
            yield pd.DataFrame(list(rows.items()), columns=["label", "top"])

    return nested.select("value").mapInPandas(run, "label string, top string")


def description(leaves: DataFrame) -> DataFrame:
    """(level, text): the labels of a level as a model is shown them."""
    line = F.concat(F.lit("  - "), "label", F.when(~X.blank("description"), F.concat(F.lit(": "), "description")).otherwise(""))
    g = leaves.where(F.col("level").isin(*V.LEVELS)).groupBy("level").agg(F.array_sort(F.collect_list(F.struct("label", line.alias("l")))).alias("x"))
    return g.select("level", F.concat(F.lit("## "), "level", F.lit("\n"), F.array_join(F.transform("x", lambda x: x["l"]), "\n")).alias("text"))


def label_pattern(name: Column) -> Column:
    """The pattern of a label that has none of its own: its words between word bounds."""
    return F.concat(F.lit(r"\b"), F.replace(name, F.lit("_"), F.lit(r"[\s_]")), F.lit(r"\b"))


def inferred_types(slots: DataFrame, leaves: DataFrame) -> DataFrame:
    """slots (slot) with `types`: the labels of the level whose keywords the slot's name holds, those of task_type if none;
    where the taxonomy has no such level, its name, or for task_type all labels."""
    by = leaves.groupBy("level").agg(F.array_sort(F.collect_set("label")).alias("types"))
    every = leaves.agg(F.array_sort(F.collect_set("label")).alias("_every"))
    got = slots.withColumn("_level", X.inferred_level(F.lower(stripped(F.col("slot"))))).join(F.broadcast(by.withColumnRenamed("level", "_level")), "_level", "left").crossJoin(F.broadcast(every))
    return got.withColumn("types", F.coalesce("types", F.when(F.col("_level") == "task_type", F.col("_every")).otherwise(F.array("_level")))).drop("_level", "_every")
