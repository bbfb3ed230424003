"""Registered queries of the steps around the store: mining, option types, compatibility, model replies, repairs, reports,
sources; each over whole tables."""

import json
import re
import uuid

from pyspark.sql import functions as F

from slotweave.functions import backends
from slotweave.functions import text as X
from slotweave.functions import values as V
from slotweave.operators import analyze, compat, detect, fixes, generate, replies, segment, store, taxonomy
from slotweave.session import cut, ensure_checkpoint_dir, read
from slotweave.sources import readers, writers

_REGISTRY: dict = {}


def _query(f):
    _REGISTRY[f.__name__] = f
    return f


def queries() -> dict:
    return dict(_REGISTRY)


def _t(s, d):
    return read(s, d, "task_templates")


def _o(s, d):
    return read(s, d, "task_options")


def _leaves(s, d):
    return read(s, d, "taxonomy_leaves")


def _flat(c: str, by: str = "|"):
    return F.coalesce(F.array_join(c, by), F.lit("")).alias(c)


# mining


def _phrases(s, d):
    return detect.verb_phrases(read(s, d, "documents").select("doc_id", "text"), "text")


@_query
def resolve_tasks(s, d):
    return detect.mined_tasks(_phrases(s, d))


@_query
def object_clusters(s, d):
    return detect.object_clusters(_phrases(s, d))


@_query
def top_categories(s, d):
    return detect.top_categories(_t(s, d), "source", "task_type")


@_query
def instruction_datasets(s, d):
    """Each label with the data sets that use it, as one string."""
    x = _leaves(s, d).select("label", F.explode("discovered_from").alias("dataset")).distinct()
    return x.groupBy("label").agg(F.array_join(F.array_sort(F.collect_list("dataset")), ", ").alias("datasets"))


@_query
def label_patterns(s, d):
    return _leaves(s, d).select("label", taxonomy.label_pattern(F.col("label")).alias("pattern"))


# labels as files


@_query
def flat_taxonomy(s, d):
    """The labels as a nested file, level by group by label, and back."""
    leaf = F.struct("level", "description")
    groups = _leaves(s, d).groupBy("level", "label_group").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", leaf.alias("leaf"))))).alias("m"))
    levels = groups.groupBy("level").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label_group", "m")), lambda a, b: F.when(a["label_group"] < b["label_group"], -1).otherwise(1))).alias("m"))
    file = levels.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("level", "m")))).alias("value"))
    return taxonomy.flattened(file)


@_query
def taxonomy_description(s, d):
    return taxonomy.description(_leaves(s, d)).select("level", F.md5("text").alias("text_md5"))


@_query
def inferred_types(s, d):
    slots = _o(s, d).where(~X.blank("slot")).select("slot").distinct()
    return taxonomy.inferred_types(slots, _leaves(s, d)).select("slot", F.md5(F.array_join("types", "|")).alias("types_md5"), F.size("types").cast("long").alias("n"))


# option types


@_query
def type_groups(s, d):
    return taxonomy.groups(_o(s, d)).select("slot", "n_values", F.md5(F.array_join("examples", "|")).alias("examples_md5"), F.size("examples").cast("long").alias("shown"))


@_query
def slot_batches(s, d):
    return taxonomy.batches(taxonomy.groups(_o(s, d)), 100).select("slot", "tokens", "shard", F.col("batch").cast("long").alias("batch"))


def _named(prompt: str) -> str:
    """The offline namer: each slot of a batch becomes a type, under a category by its first letter."""
    types: dict[str, list] = {}
    for slot, values in json.loads(prompt).items():
        types.setdefault(f"Cat_{slot.strip('_')[:1].lower()}", []).append({"name": f" {slot.strip('_ ').replace(' ', '_')}", "description": f"Values of {slot}", "compatible_slots": [slot], "example_values": [f"[x] {v}" for v in values]})
    return "<think>by letter</think>```json\n" + json.dumps({"categories": [{"name": k, "types": v} for k, v in types.items()]}) + "\n```"


def _types(s, d):
    groups = cut(taxonomy.groups(_o(s, d)))
    asked = taxonomy.naming_messages(groups, taxonomy.batches(groups))
    answers = backends.generated(asked, "prompt", lambda: backends.RuleGenerator(_named))
    entries = taxonomy.parsed_types(answers)
    # In the order of slots, whatever batch they were in.
    return groups, cut(taxonomy.merged_types(entries.withColumn("key", F.get("compatible_slots", F.lit(0))).withColumn("pos", F.lit(0))))


@_query
def option_types(s, d):
    return _types(s, d)[1].select("name", "category", F.md5("description").alias("description_md5"), _flat("compatible_slots"), F.md5(F.array_join("example_values", "|")).alias("examples_md5"))


@_query
def types_by_category(s, d):
    return taxonomy.by_category(_types(s, d)[1])


@_query
def type_cross_links(s, d):
    groups, types = _types(s, d)
    return taxonomy.cross_linked(types, groups).select("name", _flat("compatible_slots"))


@_query
def retrieved_types(s, d):
    """For every hundredth template the five types that are nearest to it."""
    t = _t(s, d).where((F.col("template_seq") % 100 == 0) & ~X.blank("text")).select(F.col("template_seq").alias("query_id"), "text")
    return taxonomy.retrieved(t, _types(s, d)[1], most=5).select("query_id", "name", "score", F.col("rank").cast("long").alias("rank"))


@_query
def type_context(s, d):
    return taxonomy.context(_types(s, d)[1]).select("category", F.md5("text").alias("text_md5"))


# compatibility


@_query
def slot_contexts(s, d):
    return compat.slot_contexts(_t(s, d)).select("id", "slot", F.md5("context").alias("context_md5"))


@_query
def compat_index(s, d):
    return compat.index(_t(s, d), _o(s, d)).select("id", "slot", "option_id", "score", F.col("rank").cast("long").alias("rank"))


@_query
def compat_index_near(s, d):
    """The same with a bound that values of a few words can reach."""
    return compat.index(_t(s, d), _o(s, d), least=0.35).select("id", "slot", "option_id", "score", F.col("rank").cast("long").alias("rank"))


@_query
def tiered_options(s, d):
    t, o = _t(s, d), _o(s, d)
    type_slots = o.where(F.col("option_type").isNotNull() & ~X.blank("slot")).select("option_type", "slot").groupBy("option_type", "slot").agg(F.count("*").alias("n")).where("n <= 2").select("option_type", "slot")
    type_slots = type_slots.where("option_type = 'card_value'")
    return compat.tiers(t, o, type_slots, lambda asked: compat.index(t, o, least=0.35, only=asked))


# repairs


@_query
def id_fixes(s, d):
    return fixes.by_id(_t(s, d)).select("template_seq", "level", _flat("slots"), F.md5("text").alias("text_md5"))


@_query
def template_replacements(s, d):
    return fixes.replaced(_t(s, d))


@_query
def templates_deduplicated(s, d):
    t = _t(s, d)
    return fixes.deduplicated(t, fixes.replaced(t)).select("template_seq", "id", F.size("compatible_with").cast("long").alias("n_links"))


@_query
def option_references(s, d):
    """References of options after templates of one text and level became one, whatever their case and figures."""
    t = _t(s, d).withColumn("text", F.regexp_replace(F.lower("text"), "[^a-z]+", " "))
    return fixes.referenced(_o(s, d), fixes.replaced(t)).select("option_seq", "slot", _flat("compatible_templates"))


@_query
def self_replicating(s, d):
    """Every fifth option repeats its slot's name, alone or with a word."""
    k, name = F.col("option_seq") % 10, F.upper(F.trim("slot"))
    return fixes.self_named(_o(s, d).withColumn("slot", F.trim("slot")).withColumn("value", F.when(k == 0, name).when(k == 5, F.concat(F.lit("the "), name)).otherwise(F.col("value"))))


@_query
def valid_templates(s, d):
    return fixes.valid_templates(_t(s, d), _leaves(s, d)).select("template_seq", "task_type", "level")


# what models are asked and answer


def _answers(s, d):
    """Replies made from templates: the template and an option a slot, some with thinking, fences or a cut end."""
    t = _t(s, d).where(~X.blank("text")).select("template_seq", "text", F.filter(F.coalesce("slots", F.array().cast("array<string>")), lambda x: x.isNotNull()).alias("slots"), "task_type", "level")
    value = lambda x, i: F.when(i % 3 == 0, F.concat(x, F.lit(" one, two"))).when(i % 3 == 1, F.element_at(F.split(x, "_"), 1)).otherwise(F.concat(F.lit("see {"), x, F.lit("}")))
    options = F.transform("slots", lambda x, i: F.struct(value(x, i).alias("value"), x.alias("slot"), F.array(F.col("task_type")).alias("compatible_task_types")))
    body = F.to_json(F.struct(F.array(F.struct("text", "slots", "task_type", "level")).alias("templates"), options.alias("options")))
    k = F.col("template_seq") % 4
    reply = F.when(k == 0, body).when(k == 1, F.concat(F.lit("<think>well {}</think>```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here it is: "), body)).otherwise(F.expr("substring(b, 1, length(b) - 1)"))
    return t.withColumn("b", body).select(F.col("template_seq").alias("unit"), reply.alias("reply"))


@_query
def extracted_templates(s, d):
    return replies.extracted(_answers(s, d), _leaves(s, d))[0].select("unit", "id", F.md5("text").alias("text_md5"), _flat("slots"), "task_type", "level", F.col("token_length").cast("long").alias("token_length"))


@_query
def extracted_options(s, d):
    o = replies.extracted(_answers(s, d), _leaves(s, d))[1]
    return o.select("unit", F.col("idx").cast("long").alias("idx"), "id", "value", "slot", F.md5(F.array_join("compatible_task_types", "|")).alias("types_md5"), _flat("compatible_templates"), F.col("token_length").cast("long").alias("token_length"))


@_query
def bool_replies(s, d):
    k = F.col("template_seq") % 6
    reply = F.when(k == 0, '{"match": true}').when(k == 1, '<think>true?</think> {"match": false}').when(k == 2, "True, it is.").when(k == 3, "true or false").when(k == 4, '{"other": true}')
    return _t(s, d).select("template_seq", replies.truth(reply).cast("int").alias("ok"))


def _varied(prompt: str) -> str:
    """The offline augmenter: the value again, shouted, shortened, and that once more."""
    user = json.loads(prompt)[-1]["content"]
    value = user.split("\nValue: ", 1)[1].split("\nTemplate: ", 1)[0]
    first = (re.split(r"\s+", value.strip(" \t\n\r\f\v"), flags=re.ASCII) or [""])[0]
    new = [(value.upper(), "alternative"), (f"{value} again", "alternative"), (first, "shortened"), (f" {first} ", "shortened"), ("", "generalized"), (f"some {first}", "generalized")]
    return json.dumps({"variations": [{"value": v, "variation_type": k} for v, k in new]})


@_query
def augmented_options(s, d):
    o = _o(s, d)
    content = read(s, d, "slot_catalog").where("not list_like").select(F.col("slot_name").alias("slot"))
    new = replies.augmentation(generate.seeds(o.where("not contains(value, '\n')"), content), o, _t(s, d), lambda: backends.RuleGenerator(_varied))
    return new.select("option_seq", "id", "value", "slot", _flat("tags"), "source_option_id", F.col("token_length").cast("long").alias("token_length"), F.size("compatible_task_types").cast("long").alias("n_types"))


@_query
def seed_contexts(s, d):
    o = _o(s, d)
    content = read(s, d, "slot_catalog").select(F.col("slot_name").alias("slot"))
    x = replies.seed_contexts(generate.seeds(o, content), o, _t(s, d))
    return x.select("option_seq", F.md5("context").alias("context_md5"), F.md5(F.get("messages", F.lit(1))["content"]).alias("message_md5"))


@_query
def extraction_prompts(s, d):
    p = analyze.deliveries(read(s, d, "generated_prompts")).where(~X.blank("prompt"))
    m = replies.extraction_messages(F.col("prompt"), ["law", "sport"], [("Name a city.", {"templates": []})], F.col("task"), "Known slots: city")
    return p.select("id", F.md5(F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit("\n"), x["content"])), "\n\n")).alias("messages_md5"))


@_query
def skipped_prompts(s, d):
    """Documents as prompts: those of over 1,500 words in all aren't sent."""
    docs = read(s, d, "documents").where(~X.blank("text")).select(F.col("doc_id").alias("prompt_id"), F.col("text").alias("prompt"))
    x = replies.skipped(replies.segmentation_messages(docs, "  - law\n  - sport", 1_500))
    return x.select("prompt_id", F.md5("span_text").alias("span_md5"), "label", "level", "method")


@_query
def parse_segments(s, d):
    """Replies made from templates, whole, fenced, cut off or no JSON at all, parsed back."""
    body = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("span_text"), F.col("task_type").alias("taxonomy_label"), F.col("level"))).alias("segments")))
    k = F.col("template_seq") % 4
    reply = F.when(k == 0, body).when(k == 1, F.concat(F.lit("<think>well</think>```json\n"), body, F.lit("\n```"))).when(k == 2, F.expr("substring(b, 1, length(b) - 3)")).otherwise(F.lit("no answer"))
    r = _t(s, d).where(~X.blank("text") & F.col("level").isNotNull()).withColumn("b", body).select(F.col("template_seq").alias("prompt_id"), reply.alias("reply"))
    return segment.parsed_segments(r, _leaves(s, d)).select("prompt_id", F.md5("span_text").alias("span_md5"), "label", "level", "method")


@_query
def segment_sources(s, d):
    """Segments with the data set that their prompt came from; of several the last."""
    docs = read(s, d, "documents").where(~X.blank("text")).select("doc_id", "text", "source")
    segments = docs.select("doc_id", F.col("text").alias("source_prompt")).where("doc_id % 3 = 0")
    return segment.with_source(segments, docs.select(F.col("text").alias("source_prompt"), "source", "doc_id"), "doc_id").select("doc_id", "source")


# store, reports, sources


@_query
def store_with_augmented(s, d):
    """The store's options and the pool values, one an id with the compatibility lists of all, as a store loads them."""
    new = generate.pool_options(s).select("id", "slot", "value", F.array(F.lit("_universal")).alias("compatible_task_types"))
    x = store.with_augmented(_o(s, d), new)
    return x.select("id", "slot", F.md5("value").alias("value_md5"), _flat("compatible_task_types"))


@_query
def slot_lookup(s, d):
    """Templates of a task, a level and a slot, by partial keys."""
    t = _t(s, d)
    found = [store.find(t, task_type="answer_question"), store.find(t, level="process_directive"), store.find(t, slot="number")]
    return [found[0], *found[1:]][0].select("template_seq", F.lit("task").alias("by")).unionByName(found[1].select("template_seq", F.lit("level").alias("by"))).unionByName(found[2].select("template_seq", F.lit("slot").alias("by")))


@_query
def token_lengths(s, d):
    x = read(s, d, "documents").select("doc_id", X.word_count(F.col("text")).cast("long").alias("n_words"), taxonomy.estimated_tokens(F.coalesce("text", F.lit(""))).alias("n_estimated"))
    return x


@_query
def validation_report(s, d):
    """How many of each kind of finding the validation of the store has."""
    every = [p for _, level, ps in V.LABELS if level == "task_type" for p in ps]
    sections = store.validation(_t(s, d), _o(s, d), lambda c: detect.label_flag(c, every))
    out = None
    for name, df in sections.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@_query
def sparsity_summary(s, d):
    return analyze.sparsity_summary(read(s, d, "generated_prompts"), _leaves(s, d))


@_query
def source_prompts(s, d):
    """A registry of three sources, one of them sampled and one that can't be read, as one table of prompts."""
    import warnings

    registry = [
        readers.Source("documents", "parquet", (f"{d}/documents.parquet",), ("text",), 200),
        readers.Source("prompts", "parquet", (f"{d}/generated_prompts.parquet",), ("task", "constraints")),
        readers.Source("missing", "parquet", (f"{d}/no_such_table.parquet",), ("text",)),
    ]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return readers.load_prompts(s, registry).select("source", F.md5("prompt").alias("prompt_md5")).groupBy("source", "prompt_md5").agg(F.count("*").alias("n"))


# sinks and back


def _folder(s) -> str:
    return f"{ensure_checkpoint_dir(s)}/saved-{uuid.uuid4().hex}"


@_query
def saved_store(s, d):
    """The store written as JSON lines and loaded again, old level names brought up to date."""
    at = _folder(s)
    writers.save_store(_t(s, d), _o(s, d), at, "json")
    t, o = readers.load_store(s, [f"{at}/templates"], [f"{at}/options"], "jsonl")
    a = t.groupBy(F.coalesce("level", F.lit("")).alias("name")).agg(F.count("*").alias("n")).select(F.lit("templates").alias("what"), "name", "n")
    return a.unionByName(o.groupBy(F.coalesce("slot", F.lit("")).alias("name")).agg(F.count("*").alias("n")).select(F.lit("options").alias("what"), "name", "n"))


@_query
def saved_augmented(s, d):
    """The augmented options of the store, written as Parquet and loaded again."""
    at = _folder(s)
    writers.save_store(_t(s, d).limit(0), writers.augmented(_o(s, d)), at)
    return readers.load_store(s, [], [f"{at}/options"], "parquet")[1].select("id", "source_option_id").groupBy("id", "source_option_id").agg(F.count("*").alias("n"))


@_query
def saved_prompts(s, d):
    """Prompts written as JSON lines; how often each label was used, from the file beside them."""
    at = _folder(s)
    writers.save_prompts(analyze.deliveries(read(s, d, "generated_prompts")).select("id", "active_labels", "combo_id"), at)
    use = s.read.json(f"{at}.coverage/labels").where("label is not null").select("label", "n")
    return use.unionByName(s.read.json(f"{at}.coverage/summary").select(F.lit("all prompts").alias("label"), F.col("prompts").alias("n")))


@_query
def saved_segments(s, d):
    """Segments written as JSON lines and gathered by prompt again."""
    at, t = _folder(s), _t(s, d).where(~X.blank("text"))
    writers.save_segments(t.select(F.col("text").alias("span_text"), F.col("task_type").alias("taxonomy_label"), "level", F.col("source").alias("source_prompt"), F.lit("llm").alias("classification_method")), at)
    x = readers.load_segments(s, at)
    return x.select(F.col("source_prompt").alias("prompt"), F.size("segments").cast("long").alias("n"), F.md5(F.array_join(F.array_sort(F.transform("segments", lambda g: g["span_text"])), "|")).alias("spans_md5"))


@_query
def saved_few_shots(s, d):
    """Examples written as one JSON object by data set and read again."""
    at = _folder(s)
    e = read(s, d, "subject_examples").select(
        F.col("subject").alias("dataset"), F.col("text").alias("prompt"),
        F.when(F.col("example_id") % 3 > 0, F.struct(F.array(F.struct("text", F.array(F.lit("x")).alias("slots"), F.col("subject").alias("task_type"), F.lit("task_type").alias("level"))).alias("templates"), F.array(F.struct(F.lit("v").alias("value"), F.lit("x").alias("slot"))).alias("options"))).alias("annotation"),
    )
    writers.save_few_shots(e, at)
    return readers.load_few_shots(s, at).select("dataset", F.md5("prompt").alias("prompt_md5"), F.coalesce(F.get("annotation.templates", F.lit(0))["task_type"], F.lit("")).alias("task_type"))


@_query
def saved_taxonomy(s, d):
    """The labels written nested by level and group, and read again."""
    at = _folder(s)
    writers.save_taxonomy(_leaves(s, d), at)
    g = s.read.json(at).select("level", F.inline("groups"))
    return g.select("level", "label_group", F.explode("labels").alias("x")).select("level", "label_group", "x.label")


@_query
def saved_types(s, d):
    at = _folder(s)
    writers.save_types(_types(s, d)[1], at)
    return s.read.json(at).select(F.col("category").alias("of"), F.explode("types").alias("x")).select("of", "x.name", F.size("x.example_values").cast("long").alias("n"))
