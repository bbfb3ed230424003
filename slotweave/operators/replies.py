"""What models are asked and what they answer: messages, yes-or-no replies, extracted templates and options, variations."""

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.functions import backends
from slotweave.functions import text as X
from slotweave.functions import values as V
from slotweave.operators import fixes
from slotweave.operators.segment import repair
from slotweave.operators.store import _templates
from slotweave.operators.taxonomy import stripped

EXTRACTION = "struct<templates:array<struct<text:string,slots:array<string>,task_type:string,level:string>>,options:array<struct<value:string,slot:string,compatible_task_types:array<string>>>>"
VARIATIONS = "struct<variations:array<struct<value:string,variation_type:string>>>"
#: What a model is told; wordings are a matter of the model, so they are parameters of the functions below.
EXTRACT = "Turn the prompt into reusable templates with {slot} placeholders and the options that filled them. Answer with JSON: templates, options."
AUGMENT = "Give three to five variations of the value that could stand in the same slot. Answer with JSON: variations (value, variation_type)."
SEGMENT = "Cut the prompt into clauses and give each the label that fits. Answer with JSON: segments (span_text, taxonomy_label, level)."
#: Room that a model has for its input: 8192 tokens less its answer and a margin.
INPUT_TOKENS = 8192 - 2048 - 64


def said(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def extraction_messages(prompt: Column, labels: list[str], examples: list[tuple[str, dict]] = (), hint: Column | None = None, vocabulary: str = "", system: str = EXTRACT) -> Column:
    """The chat for one prompt: system, annotated examples, then labels, the known slots, what the segment was classified as
    (hint, may be null) and the prompt."""
    head = "Taxonomy labels: " + json.dumps(labels)
    shown = [x for text, note in examples if text and note for x in (said("user", F.lit(f'{head}\n\nPrompt:\n"{text}"')), said("assistant", F.lit(json.dumps(note, ensure_ascii=False))))]
    about = F.lit("") if hint is None else F.coalesce(F.concat(F.lit("[Classified as: "), hint, F.lit("; context only, no slot or option.]\n\n")), F.lit(""))
    return F.array(said("system", F.lit(system)), *shown, said("user", F.concat(F.lit(head + (f"\n\n{vocabulary}" if vocabulary else "") + "\n\n"), about, F.lit('Prompt:\n"'), prompt, F.lit('"'))))


def segmentation_messages(prompts: DataFrame, description: str, most: int = INPUT_TOKENS, system: str = SEGMENT, count: Callable[[Column], Column] = X.word_count) -> DataFrame:
    """prompts (prompt) with messages and too_long: with over `most` tokens (count: text column -> number) a prompt isn't
    sent and becomes one segment (skipped_long)."""
    user = F.concat(F.lit(f"## Available taxonomy labels\n{description}\n\n## Prompt to segment\n\""), "prompt", F.lit('"'))
    return prompts.withColumn("messages", F.array(said("system", F.lit(system)), said("user", user))).withColumn("too_long", count(F.lit(system)) + count(user) > most)


def skipped(prompts: DataFrame) -> DataFrame:
    """The segments of prompts that are too long to be sent."""
    return prompts.where("too_long").select("prompt_id", F.lit(0).alias("seg_idx"), F.col("prompt").alias("span_text"), F.lit("description").alias("label"), F.lit("task_type").alias("level"), F.lit("skipped_long").alias("method"))


def truth(reply: Column) -> Column:
    """A yes-or-no reply: the JSON field match, else whether it says true and not false; null says no."""
    s = stripped(F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?s)<think>.*?</think>", ""))
    parsed = F.try_parse_json(s)
    field = F.coalesce(F.try_variant_get(parsed, "$.match", "boolean"), F.lit(False))
    low = F.lower(s)
    return F.when(parsed.isNotNull() & F.startswith(s, F.lit("{")), field).otherwise(F.contains(low, F.lit("true")) & ~F.contains(low, F.lit("false")))


def _json(replies: DataFrame, schema: str, field: str) -> DataFrame:
    """replies with `d`: the reply without thinking and fences as JSON, mended only where it has to be."""
    clean = F.regexp_replace(F.regexp_replace("reply", r"(?s)<think>.*?</think>", ""), r"(?m)^\s*```\w*\s*$", "")
    x = replies.withColumn("d", F.from_json(clean, schema))
    return x.withColumn("d", F.when(F.col(f"d.{field}").isNotNull(), F.col("d")).otherwise(F.from_json(repair(F.col("reply")), schema)))


def extracted(replies: DataFrame, leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Templates (unit, idx, id, text, slots, task_type, level, token_length) and options (unit, idx, id, value, slot,
    compatible_task_types, compatible_templates, token_length) from replies (unit, reply), a reply being one unit.

    Slots get their canonical names (preferred ones stay), options that only repeat their slot's name go elsewhere and take
    the unit's templates along, lists are split, values with placeholders dropped. Templates of unknown labels are
    dropped, levels that are none taken from the label; options without a known label get those that their slot suggests.
    All of it is done within the reply's row, without a shuffle. Replies that aren't JSON even after repair give nothing."""
    none = F.array().cast("array<string>")
    known = leaves.agg(F.map_from_entries(F.collect_list(F.struct("label", "level"))).alias("_of")) if leaves.columns else None
    x = _json(replies, EXTRACTION, "templates").where("d is not null").select("unit", "d").crossJoin(F.broadcast(known))
    name = lambda s: F.when(s.isin(*V.PREFERRED_SLOTS), s).otherwise(F.coalesce(X.canonical_slot(s), s))
    brace = lambda s: F.concat(F.lit("{"), s, F.lit("}"))
    pairs = lambda slots: F.transform(slots, lambda s: F.struct(s.alias("slot"), brace(name(s)).alias("value")))
    ts = F.transform(F.coalesce("d.templates", F.array().cast("array<struct<text:string,slots:array<string>,task_type:string,level:string>>")), lambda t: F.struct(
        X.fill_all(F.coalesce(t["text"], F.lit("")), pairs(F.filter(F.coalesce(t["slots"], none), lambda s: s.isNotNull()))).alias("text"),
        F.array_distinct(F.transform(F.filter(F.coalesce(t["slots"], none), lambda s: s.isNotNull()), name)).alias("slots"), F.coalesce(t["task_type"], F.lit("unknown")).alias("task_type"), t["level"].alias("level")))
    x = x.withColumn("ts", ts).withColumn("_types", F.transform("ts", lambda t: t["task_type"]))
    os = F.transform(F.filter(F.coalesce("d.options", F.array().cast("array<struct<value:string,slot:string,compatible_task_types:array<string>>>")), lambda o: o["value"].isNotNull() & o["slot"].isNotNull()), lambda o: F.struct(
        name(o["slot"]).alias("slot"), o["value"].alias("value"), F.coalesce(o["compatible_task_types"], none).alias("types")))
    x = x.withColumn("os", os)
    own = lambda o: ~X.blank(o["slot"]) & ~X.blank(o["value"]) & fixes.is_self_named(o["slot"], o["value"])
    x = x.withColumn("os", F.transform("os", lambda o: F.struct(o["slot"].alias("old"), F.when(own(o), fixes.slot_of_self_named(o["slot"], o["value"], F.concat(o["types"], F.col("_types")))).otherwise(o["slot"]).alias("slot"), o["value"].alias("value"), o["types"].alias("types"))))
    x = x.withColumn("os", F.filter("os", lambda o: o["slot"].isNotNull()))
    moved = F.filter("os", lambda o: o["old"] != o["slot"])
    along = lambda text: F.aggregate(moved, text, lambda acc, o: F.replace(acc, brace(o["old"]), brace(o["slot"])))
    slots = lambda s: F.aggregate(moved, s, lambda acc, o: F.transform(acc, lambda y: F.when(y == o["old"], o["slot"]).otherwise(y)))
    x = x.withColumn("ts", F.transform("ts", lambda t: F.struct(F.when(F.size(moved) > 0, along(t["text"])).otherwise(t["text"]).alias("text"), slots(t["slots"]).alias("slots"), t["task_type"].alias("task_type"), t["level"].alias("level"))))
    x = x.withColumn("ts", F.filter("ts", lambda t: F.map_contains_key("_of", t["task_type"])))
    level = lambda t: F.coalesce(F.element_at(fixes.map_of(V.OLD_LEVELS), t["level"]), t["level"], F.lit("task_type"))
    bare = lambda t: F.aggregate(t["slots"], t["text"], lambda acc, s: F.replace(acc, brace(s), F.lit("")))
    x = x.withColumn("ts", F.transform("ts", lambda t: F.struct(
        X.content_id(t["task_type"], t["text"]).alias("id"), t["text"].alias("text"), t["slots"].alias("slots"), t["task_type"].alias("task_type"),
        F.when(level(t).isin(*V.LEVELS), level(t)).otherwise(F.element_at("_of", t["task_type"])).alias("level"), X.word_count(bare(t)).alias("token_length"))))
    parts = lambda v: F.filter(F.transform(F.split(v, ","), lambda p: F.trim(p)), lambda p: p != "")
    listed = lambda o: o["slot"].isin("keyword", "option", "completion") & (F.size(parts(o["value"])) >= 2)
    x = x.withColumn("os", F.flatten(F.transform("os", lambda o: F.transform(F.when(listed(o), parts(o["value"])).otherwise(F.array(o["value"])), lambda v: F.struct(o["slot"].alias("slot"), v.alias("value"), o["types"].alias("types"))))))
    x = x.withColumn("os", F.filter("os", lambda o: ~o["value"].rlike(r"\{\w+\}")))
    of_level = lambda lv: F.array_sort(F.transform(F.filter(F.map_entries("_of"), lambda e: e["value"] == lv), lambda e: e["key"]))
    suggested = lambda o: F.when(F.size(of_level(X.inferred_level(o["slot"]))) > 0, of_level(X.inferred_level(o["slot"]))).otherwise(F.array(X.inferred_level(o["slot"])))
    right = lambda o: F.filter(o["types"], lambda t: F.map_contains_key("_of", t))
    x = x.withColumn("os", F.transform("os", lambda o: F.struct(
        X.content_id(o["slot"], o["value"]).alias("id"), o["value"].alias("value"), o["slot"].alias("slot"), F.when(F.size(right(o)) > 0, right(o)).otherwise(suggested(o)).alias("compatible_task_types"),
        F.transform(F.filter("ts", lambda t: F.array_contains(t["slots"], o["slot"])), lambda t: t["id"]).alias("compatible_templates"), X.word_count(o["value"]).alias("token_length"))))
    return x.select("unit", F.posexplode("ts").alias("idx", "t")).select("unit", "idx", "t.*"), x.select("unit", F.posexplode("os").alias("idx", "o")).select("unit", "idx", "o.*")


def extraction(prompts: DataFrame, leaves: DataFrame, make: Callable, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """The whole step: prompts (unit, prompt, and hint if it has one) asked of a model and its replies parsed. make: the
    generator, which gets the chat as JSON."""
    hint = F.col("hint") if "hint" in prompts.columns else None
    asked = prompts.select(F.col("unit").alias("key"), F.to_json(extraction_messages(F.col("prompt"), labels, hint=hint)).alias("prompt"))
    return extracted(backends.generated(asked, "prompt", make).withColumnRenamed("key", "unit"), leaves)


def seed_contexts(seeds: DataFrame, options: DataFrame, templates: DataFrame) -> DataFrame:
    """seeds (option_seq, id, slot, value) with the first template that the option names and the store has, '' if none, and
    messages."""
    t = _templates(templates).select(F.col("id").alias("_t"), "text")
    refs = seeds.select("option_seq").join(options.select("option_seq", F.posexplode("compatible_templates").alias("_p", "_t")), "option_seq").join(t, "_t")
    first = refs.groupBy("option_seq").agg(F.min_by("text", "_p").alias("context"))
    x = seeds.join(first, "option_seq", "left").withColumn("context", F.coalesce("context", F.lit("")))
    user = F.concat(F.lit("Slot: "), "slot", F.lit("\nValue: "), "value", F.when(F.col("context") != "", F.concat(F.lit("\nTemplate: "), "context")).otherwise(""))
    return x.withColumn("messages", F.array(said("system", F.lit(AUGMENT)), said("user", user)))


def variations(replies: DataFrame, options: DataFrame) -> DataFrame:
    """New options from replies (option_seq, reply) to seeds: variations that aren't blank and repeat neither the seed nor an
    earlier one (case aside), with the seed's slot and links, its id as source_option_id and the kind as tag."""
    o = options.select("option_seq", F.col("id").alias("source_option_id"), "slot", F.col("value").alias("_seed"), "compatible_task_types", "compatible_templates")
    x = _json(replies, VARIATIONS, "variations").select("option_seq", F.posexplode("d.variations").alias("pos", "v"))
    x = x.select("option_seq", "pos", stripped(F.col("v.value")).alias("value"), F.coalesce("v.variation_type", F.lit("alternative")).alias("kind")).where(F.col("value") != "").join(o, "option_seq")
    x = x.where(F.lower("value") != F.lower(stripped(F.col("_seed"))))
    one = x.groupBy("option_seq", F.lower("value").alias("_l")).agg(F.min_by(F.struct(*[c for c in x.columns if c not in ("option_seq", "_seed")]), "pos").alias("r")).select("option_seq", "r.*")
    return one.select(
        "option_seq", "pos", X.content_id(F.col("slot"), F.col("value")).alias("id"), "value", "slot", "compatible_task_types", "compatible_templates", X.word_count(F.col("value")).alias("token_length"),
        F.lit("llm_augmented").alias("source"), F.array("kind").alias("tags"), "source_option_id",
    )


def augmentation(seeds: DataFrame, options: DataFrame, templates: DataFrame, make: Callable) -> DataFrame:
    """The whole step: seeds asked of a model in batches and its replies parsed; a batch that fails gives nothing."""
    asked = seed_contexts(seeds, options, templates).select(F.col("option_seq").alias("key"), F.to_json("messages").alias("prompt"))
    return variations(backends.generated(asked, "prompt", make, 32).withColumnRenamed("key", "option_seq"), options)


def appended(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old options and those of the new ones whose id they lack, each id once."""
    rest = [c for c in new.columns if c != "id"]
    one = new.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("option_seq", "pos") if "pos" in rest else F.col("option_seq")).alias("r")).select("id", "r.*")
    return old.unionByName(one.join(old.select("id").where("id is not null").distinct(), "id", "left_anti"), allowMissingColumns=True)
