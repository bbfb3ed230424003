"""Augmenting options and generating prompts."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotweave.functions import text as X
from slotweave.functions import values as V
from slotweave.session import cut


def hash_number(key: Column, n: Column) -> Column:
    """A number from 0 to n - 1 that depends on key alone."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % n


def numeric_options(spark: SparkSession) -> DataFrame:
    """(label, task_type, value, slot): the values of each numeric range; the slot is the canonical `number`."""
    rows = [(label, task, *r) for label, tasks in V.NUMERIC_RANGES.items() for task, r in tasks.items()]
    df = spark.createDataFrame(rows, "label string, task_type string, lo int, hi int, step int")
    return df.select("label", "task_type", F.explode(F.sequence("lo", "hi", "step").cast("array<string>")).alias("value"), F.lit("number").alias("slot"))


def pool_options(spark: SparkSession) -> DataFrame:
    """(slot, value, id): keywords, languages, end phrases, letters, forbidden words."""
    pools = {"keyword": V.KEYWORDS, "language": V.LANGUAGES, "end_phrase": V.END_PHRASES, "letter": V.LETTERS, "forbidden_word": V.FORBIDDEN_WORDS}
    df = spark.createDataFrame([(s, v) for s, vs in pools.items() for v in vs], "slot string, value string")
    return df.withColumn("id", X.content_id(F.col("slot"), F.col("value")))


def combo_options(spark: SparkSession, n: int = 20) -> DataFrame:
    """(slot, combo, value): n combinations of two to four keywords, and as many of forbidden words, picked by hash."""
    out = None
    for slot, pool in (("keywords", V.KEYWORDS), ("forbidden_words", V.FORBIDDEN_WORDS)):
        words = F.array(*[F.lit(w) for w in pool])
        i = F.col("id").cast("string")
        key = lambda w: F.concat(F.lit(slot + "|"), i, F.lit("|"), w)  # noqa: E731, B023
        order = F.transform(F.array_sort(F.transform(words, lambda w: F.struct(F.md5(key(w)).alias("h"), w.alias("w")))), lambda x: x["w"])
        size = (hash_number(F.concat(F.lit(slot + "|size|"), i), F.lit(3)) + 2).cast("int")
        df = spark.range(n).select(F.lit(slot).alias("slot"), F.col("id").cast("int").alias("combo"), F.array_join(F.slice(order, F.lit(1), size), ", ").alias("value"))
        out = df if out is None else out.unionByName(df)
    return out


def missing(new: DataFrame, options: DataFrame) -> DataFrame:
    """The new options whose id the store lacks."""
    return new.join(options.select("id").where("id is not null").distinct(), "id", "left_anti")


def seeds(options: DataFrame, content: DataFrame, most: int = 0) -> DataFrame:
    """(option_seq, id, slot, value): options worth a model's rewriting, one an id: in a content slot (content: slot), of 2
    to 500 tokens, no blank, not augmented already. Where there are more than `most` (0: no bound), each slot gives an even
    share of it, picked by hash."""
    o = options.where(~X.blank("slot") & ~X.blank("value") & F.col("token_length").between(2, 500) & F.col("source_option_id").isNull() & (F.coalesce("source", F.lit("")) != "augmented"))
    o = o.groupBy("id").agg(F.min_by(F.struct("option_seq", "slot", "value"), "option_seq").alias("r")).select("id", "r.*")
    o = o.join(content.select("slot").distinct(), "slot", "left_semi").select("option_seq", "id", "slot", "value")
    if not most:
        return o
    n = o.agg(F.count("*").alias("_all"), F.count_distinct("slot").alias("_slots"))
    o = numbered(o, ["slot"], F.col("id")).crossJoin(F.broadcast(n))
    share = F.when(F.col("_all") <= most, F.col("size")).otherwise(F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("_slots"))))
    return o.where(F.col("rank") < share).select("option_seq", "id", "slot", "value")


def numbered(df: DataFrame, by: list[str], key: Column) -> DataFrame:
    """df with rank (from 0) and size of its group, in the order of md5(key), key being unique within a group. Ranks are
    taken in up to 65,536 ordered shards a group and shifted by the counts of the shards before, so that a group with a
    third of all rows is no single task."""
    s = df.withColumn("_h", F.md5(key)).withColumn("_shard", F.substring("_h", 1, 4))
    counts = s.groupBy(*by, "_shard").agg(F.count("*").alias("_k"))
    w = W.partitionBy(*by)
    shifts = counts.withColumn("_shift", F.coalesce(F.sum("_k").over(w.orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("size", F.sum("_k").over(w)).drop("_k")
    ranked = s.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_shard").orderBy("_h")) - 1)
    return ranked.join(shifts, [*by, "_shard"]).withColumn("rank", F.col("_r") + F.col("_shift")).drop("_r", "_shift", "_shard", "_h")


def pool(templates: DataFrame, options: DataFrame) -> DataFrame:
    """(slot, list, id, value, rank, size): the lists of options that a template's slot may draw from, numbered: 'u' the
    universal ones, 't|type' those of a task type, 'i|template' those that name a template of a type they don't fit, 'a' all
    of the slot. Nothing is paired template by template."""
    from slotweave.operators.store import _options, _templates

    o = _options(options)
    own = ~F.array_contains("types", "_universal")
    one = o.select("slot", "id", "value", F.when(own, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("u"))).alias("ls"))
    typed = o.where(own).select("slot", "id", "value", F.transform(F.array_distinct(F.filter("types", lambda x: x.isNotNull())), lambda x: F.concat(F.lit("t|"), x)).alias("ls"))
    of = _templates(templates).select(F.col("id").alias("_t"), F.coalesce("task_type", F.lit("")).alias("_label"))
    named = o.where(own).select("slot", "id", "value", "types", F.explode(F.array_distinct("templates")).alias("_t")).join(of, "_t").where(~F.coalesce(F.array_contains("types", F.col("_label")), F.lit(False)))
    lists = one.unionByName(typed).select("slot", "id", "value", F.explode("ls").alias("list")).unionByName(named.select("slot", "id", "value", F.concat(F.lit("i|"), "_t").alias("list")))
    return cut(numbered(lists, ["slot", "list"], F.col("id")))


def drawn(asked: DataFrame, lists: DataFrame) -> DataFrame:
    """asked (template, label, slot, h, and more) with option_id and value: of the options that fit the template (universal,
    by type, by its id; all of the slot if there are none) the one that number h picks; null where the slot has none."""
    sizes = lists.where("rank = 0").select("slot", "list", "size")
    need = asked.select("template", "label", "slot").distinct()
    of = F.array(F.lit("u"), F.concat(F.lit("t|"), "label"), F.concat(F.lit("i|"), "template"), F.lit("a"))
    got = need.select("*", F.posexplode(of).alias("_k", "list")).join(sizes, ["slot", "list"], "left").groupBy("template", "label", "slot").agg(
        *[F.coalesce(F.max(F.when(F.col("_k") == k, F.col("size"))), F.lit(0)).alias(f"_{c}") for k, c in enumerate("utia")]
    )
    x = asked.join(got, ["template", "label", "slot"])
    fit = F.col("_u") + F.col("_t") + F.col("_i")
    r = F.col("h") % F.when(fit > 0, fit).otherwise(F.when(F.col("_a") > 0, F.col("_a")))
    name = F.when(fit == 0, "a").when(r < F.col("_u"), "u").when(r < F.col("_u") + F.col("_t"), F.concat(F.lit("t|"), "label")).otherwise(F.concat(F.lit("i|"), "template"))
    rank = F.when((fit == 0) | (r < F.col("_u")), r).when(r < F.col("_u") + F.col("_t"), r - F.col("_u")).otherwise(r - F.col("_u") - F.col("_t"))
    x = x.withColumn("list", name).withColumn("rank", rank).drop("_u", "_t", "_i", "_a")
    return x.join(lists.select("slot", "list", "rank", F.col("id").alias("option_id"), "value"), ["slot", "list", "rank"], "left").drop("list", "rank")


def number_of(key: Column) -> Column:
    """A number from 0 to 2^32 - 1 that depends on key alone."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def generate(templates: DataFrame, options: DataFrame, n: int, density: int = 3, seed: int = 42, min_tokens: int = 0, max_tokens: int = 0, retries: int = 3) -> DataFrame:
    """n prompts made in parallel, as a store of generated prompts has them, with prompt_no and number of the try.

    A label is drawn in proportion to the square root of its templates, which is where the sequential policy (weight
    1 / (1 + usage) per template) tends to; tasks have exact quotas, constraints are drawn. A prompt takes density - 1
    constraints of different labels, at most two of a level (of each label the first draw counts, of 4 (density - 1) draws).
    Placeholders are filled, at their first occurrence, with options that fit the template, else any of the slot; without
    options {n} becomes a number from 3 to 10 and others '...'. Constraints replace {constraints} or follow the task after
    a blank line; those that come out blank are left out of text and ids, not of the labels. Of up to `retries` tries the
    first counts whose words are min_tokens to max_tokens (0: no bound); a prompt without one is missing. Everything is
    picked by hash of prompt number, try and place, so the result is the same at any parallelism."""
    from slotweave.operators.store import _templates

    t = _templates(templates).where("level is not null").select("id", "text", F.coalesce("task_type", F.lit("")).alias("label"), "level", (F.col("level") == "task_type").alias("task"))
    t = t.withColumn("held", F.filter(F.array_distinct(X.placeholders(F.col("text"))), lambda x: x != "constraints"))
    ranked = cut(numbered(t, ["task", "label"], F.col("id")))
    share = ranked.groupBy("task", "label").agg(F.max("size").alias("size")).withColumn("w", F.ceil(F.sqrt("size")))
    w = W.partitionBy("task").orderBy("label").rowsBetween(W.unboundedPreceding, -1)  # labels: a small table
    share = share.withColumn("b", F.coalesce(F.sum("w").over(w), F.lit(0)))
    units = share.select("task", "label", "size", F.explode(F.sequence("b", F.col("b") + F.col("w") - 1)).alias("unit"))
    total = share.groupBy().agg(F.sum(F.when(F.col("task"), F.col("w"))).alias("wt"), F.sum(F.when(~F.col("task"), F.col("w"))).alias("wr"))
    key = lambda *p: F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ("prompt_no", "try")], *p)
    tries = retries if min_tokens or max_tokens else 1
    asked = templates.sparkSession.range(n).select(F.col("id").alias("prompt_no"), F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("try")).crossJoin(F.broadcast(total))
    part = ranked.select("task", "label", "rank", F.col("id").alias("template"), "text", "held", "level")
    tasks = asked.where("wt > 0").withColumn("unit", F.expr(f"prompt_no * wt div {n}")).join(units.where("task").drop("task"), "unit").withColumn("rank", number_of(key(F.lit("task"))) % F.col("size"))
    tasks = tasks.join(part.where("task").drop("task"), ["label", "rank"]).select("prompt_no", "try", F.lit(-1).alias("place"), "template", "label", "text", "held")
    draws = asked.where("wr > 0").withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(4 * (density - 1) - 1)))) if density > 1 else asked.where("false").withColumn("place", F.lit(0))
    at = F.col("place").cast("string")
    draws = draws.withColumn("unit", number_of(key(F.lit("label"), at)) % F.col("wr")).join(units.where("not task").drop("task"), "unit").withColumn("rank", number_of(key(F.lit("rule"), at)) % F.col("size"))
    of = lambda *c: W.partitionBy("prompt_no", "try", *c).orderBy("place")
    rules = draws.withColumn("_r", F.row_number().over(of("label"))).where("_r = 1").join(part.where("not task").drop("task"), ["label", "rank"])
    rules = rules.withColumn("_r", F.row_number().over(of("level"))).where("_r <= 2").withColumn("_r", F.row_number().over(of())).where(F.col("_r") <= density - 1)
    parts = cut(tasks.unionByName(rules.select("prompt_no", "try", "place", "template", "label", "text", "held")))
    slots = parts.select("prompt_no", "try", "place", "template", "label", F.posexplode("held").alias("p", "slot")).withColumn("h", number_of(key(F.col("place").cast("string"), F.col("slot"))))
    fills = drawn(slots, pool(templates, options)).withColumn("by", F.coalesce("value", F.when(F.col("slot") == "n", (F.col("h") % 8 + 3).cast("string")).otherwise("...")))
    one = fills.groupBy("prompt_no", "try", "place").agg(F.array_sort(F.collect_list(F.struct("p", "slot", "by", "option_id", "value"))).alias("f"))
    none = F.array().cast("array<struct<p:int,slot:string,by:string,option_id:string,value:string>>")
    full = parts.join(one, ["prompt_no", "try", "place"], "left").withColumn("f", F.coalesce("f", none))
    full = full.withColumn("said", F.aggregate("f", F.col("text"), lambda acc, x: X.replace_first(acc, F.concat(F.lit("{"), x["slot"], F.lit("}")), x["by"])))
    full = full.withColumn("said", F.when(F.col("place") >= 0, _stripped(F.replace("said", F.lit("{constraints}"), F.lit("")))).otherwise(F.col("said")))
    g = full.groupBy("prompt_no", "try").agg(F.array_sort(F.collect_list(F.struct("place", "template", "label", "said", "f"))).alias("c"))
    task, rest = F.get("c", F.lit(0)), F.slice("c", F.lit(2), F.size("c"))
    live = F.filter(rest, lambda x: x["said"] != "")
    block = F.array_join(F.transform(live, lambda x: x["said"]), "\n")
    used = F.filter(F.flatten(F.transform(F.concat(F.slice("c", 1, 1), live), lambda x: x["f"])), lambda x: x["option_id"].isNotNull())
    text = F.when(F.contains(task["said"], F.lit("{constraints}")), F.replace(task["said"], F.lit("{constraints}"), block)).when(block != "", F.concat(task["said"], F.lit("\n\n"), block)).otherwise(task["said"])
    labels = F.transform(rest, lambda x: x["label"])
    done = g.where(task["place"] == -1).select(
        "prompt_no", "try", _stripped(text).alias("prompt"), task["template"].alias("task_template_id"), F.transform(live, lambda x: x["template"]).alias("constraint_template_ids"),
        F.transform(used, lambda x: x["option_id"]).alias("option_ids"), F.concat(F.array(task["label"]), labels).alias("active_labels"), task["label"].alias("task"), labels.alias("constraints"),
        F.size("c").alias("density"),
        F.substring(F.md5(F.concat_ws("|", task["label"], F.array_join(F.array_sort(labels), "|"), F.array_join(F.array_sort(F.transform(used, lambda x: x["value"])), "|"))), 1, 12).alias("combo_id"),
    ).withColumn("token_length", X.word_count(F.col("prompt")))
    kept = token_window(done, min_tokens, max_tokens)
    if tries == 1:
        return kept
    rest_of = [c for c in kept.columns if c != "prompt_no"]
    return kept.groupBy("prompt_no").agg(F.min_by(F.struct(*rest_of), "try").alias("r")).select("prompt_no", "r.*")


def generate_exact(templates: DataFrame, options: DataFrame, n: int = 1000, density: int = 3, seed: int = 42) -> DataFrame:
    """The sequential policy itself, in one task: templates drawn with weight 1 / (1 + usage of their label), at most two
    constraints a level, distinct labels. All templates and all values of each slot take part, and that task holds them."""
    t = templates.where(~X.blank("text")).groupBy("id").agg(F.min_by(F.struct("text", "task_type", "level", "template_seq"), "template_seq").alias("r")).select("id", "r.*")
    o = options.where(~X.blank("slot") & ~X.blank("value")).groupBy("slot", "value").agg(F.min("option_seq").alias("s"))
    pools = o.groupBy("slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "value"))), lambda x: x["value"]).alias("v"))
    both = t.select(F.lit(0).alias("g"), F.struct("id", "text", "task_type", "level").alias("t"), F.lit(None).cast("struct<slot:string,v:array<string>>").alias("o")).unionByName(
        pools.select(F.lit(0).alias("g"), F.lit(None).cast("struct<id:string,text:string,task_type:string,level:string>").alias("t"), F.struct("slot", "v").alias("o"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        rows, pool = [], {}
        for b in batches:
            rows += [x for x in b["t"] if x is not None]
            pool |= {x["slot"]: list(x["v"]) for x in b["o"] if x is not None}
        rows.sort(key=lambda x: x["id"])
        rng, out = np.random.default_rng(seed), []
        tasks = [x for x in rows if x["level"] == "task_type"]
        rules = [x for x in rows if x["level"] != "task_type"]

        labels, levels_of = {}, {}
        code = lambda xs, c, known: np.array([known.setdefault(x[c], len(known)) for x in xs], dtype=np.int64)
        task_label, rule_label, rule_level = code(tasks, "task_type", labels), code(rules, "task_type", labels), code(rules, "level", levels_of)
        used = np.zeros(len(labels))

        def draw(xs, at, label):
            w = 1 / (1 + used[label[at]])
            return xs[int(at[rng.choice(len(at), p=w / w.sum())])]

        for i in range(n if tasks else 0):
            picked, levels = [draw(tasks, np.arange(len(tasks)), task_label)], np.zeros(len(levels_of), dtype=int)
            for _ in range(density - 1):
                at = np.flatnonzero((levels[rule_level] < 2) & ~np.isin(rule_label, [labels[p["task_type"]] for p in picked if p["task_type"] in labels]))
                if not len(at):
                    break
                x = draw(rules, at, rule_label)
                levels[levels_of[x["level"]]] += 1
                picked.append(x)
            fill = lambda m: pool[m.group(1)][int(rng.integers(len(pool[m.group(1)])))] if pool.get(m.group(1)) else "..."
            text = "\n".join(re.sub(X.PLACEHOLDER, fill, p["text"]) for p in picked).strip()
            for p in picked:
                used[labels[p["task_type"]]] += 1
            out.append((i, picked[0]["id"], [p["task_type"] or "" for p in picked], text, len(picked)))
        yield pd.DataFrame(out, columns=["prompt_no", "task_id", "active_labels", "prompt", "density"])

    return both.repartition(1).mapInPandas(run, "prompt_no long, task_id string, active_labels array<string>, prompt string, density int")


def token_window(prompts: DataFrame, least: int = 0, most: int = 0) -> DataFrame:
    """Prompts of least to most words; 0 switches a bound off."""
    n = X.word_count(F.col("prompt"))
    return prompts.where((n >= least) & ((F.lit(most) == 0) | (n <= most)))


def feasible_density(templates: DataFrame, options: DataFrame) -> DataFrame:
    """(id, combinations, full): in how many ways a template can be filled with fitting options, and with any options of
    its slots, as logarithms to base 10 (0 combinations: null)."""
    from slotweave.operators.store import compatible_counts

    c = compatible_counts(templates, options)
    log = lambda x: F.when(F.min(x) > 0, F.round(F.sum(F.log10(F.greatest(x, F.lit(1)))), 6))
    return c.groupBy("id").agg(log(F.col("usable")).alias("feasible_log10"), log(F.col("in_slot")).alias("full_log10"))
