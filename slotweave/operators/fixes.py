"""Repairs of a store: corrections by id, duplicates within and across levels, references to dropped templates, options
that repeat their slot's name, numbered slots, what a store may hold."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotweave.functions import text as X
from slotweave.functions import values as V
from slotweave.operators.skew import lookup


def map_of(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def by_id(templates: DataFrame, levels: dict[str, str] = V.LEVEL_FIXES, renames: list[str] = V.CONSTRAINT_RENAMES) -> DataFrame:
    """Corrected levels of single templates, and {constraint} renamed {format_constraint} in others."""
    hit = F.coalesce(F.col("id").isin(*renames), F.lit(False))
    slots = F.transform("slots", lambda s: F.when(s == "constraint", "format_constraint").otherwise(s))
    return templates.withColumn("level", F.coalesce(F.element_at(map_of(levels), F.col("id")), "level")).withColumn(
        "text", F.when(hit, F.replace("text", F.lit("{constraint}"), F.lit("{format_constraint}"))).otherwise(F.col("text"))
    ).withColumn("slots", F.when(hit, slots).otherwise(F.col("slots")))


def replaced(templates: DataFrame, marker: str = "First repeat the request") -> DataFrame:
    """(old_id, kept_id): templates (one row an id) that go, and what they become: of equal text and level all but the first;
    of a text with `marker` that stands exactly as process directive and as format constraint, all but the first process
    directive, unless they have gone already. Blank texts stay."""
    t = templates.where(~X.blank("text") & F.col("id").isNotNull()).groupBy("id").agg(F.min_by(F.struct("template_seq", "text", "level"), "template_seq").alias("r")).select("id", "r.*").withColumn("level", F.coalesce("level", F.lit("")))
    kept = t.groupBy("text", "level").agg(F.min_by("id", "template_seq").alias("kept_id"), F.count("*").alias("_n"), F.min("template_seq").alias("_s")).where("_n > 1")
    same = lookup(t, kept.drop("_n", "_s"), ["text", "level"], F.col("id")).where("id <> kept_id").select(F.col("id").alias("old_id"), "kept_id")
    marked = t.where(F.contains("text", F.lit(marker)))
    both = marked.groupBy("text").agg(F.array_sort(F.collect_set("level")).alias("ls"), F.min_by("id", F.when(F.col("level") == "process_directive", F.col("template_seq"))).alias("kept_id"))
    both = both.where(F.col("ls") == F.array(F.lit("format_constraint"), F.lit("process_directive"))).select("text", "kept_id")
    across = lookup(marked, both, ["text"], F.col("id")).where("id <> kept_id").select(F.col("id").alias("old_id"), "kept_id").join(same.select("old_id"), "old_id", "left_anti")
    return same.unionByName(across)


def deduplicated(templates: DataFrame, gone: DataFrame) -> DataFrame:
    """Templates (one row an id) without those replaced, with the links of the ones that went, sorted."""
    t = templates.where(~X.blank("text") & F.col("id").isNotNull())
    one = t.groupBy("id").agg(F.min_by(F.struct("template_seq", "text", "level", F.coalesce("compatible_with", F.array().cast("array<string>")).alias("links")), "template_seq").alias("r")).select("id", "r.*")
    links = one.join(gone.withColumnRenamed("old_id", "id"), "id").groupBy(F.col("kept_id").alias("id")).agg(F.array_distinct(F.flatten(F.collect_set("links"))).alias("more"))
    kept = one.join(gone.select(F.col("old_id").alias("id")), "id", "left_anti").join(links, "id", "left")
    return kept.select("template_seq", "id", "text", "level", F.when(F.col("more").isNull(), F.col("links")).otherwise(F.array_sort(F.array_union("links", "more"))).alias("compatible_with"))


def referenced(options: DataFrame, gone: DataFrame) -> DataFrame:
    """Options whose compatible_templates name what became of dropped templates, in order, repeats dropped; a value
    'markdown' in slot text_type goes to slot format."""
    none = F.array().cast("array<string>")
    o = options.withColumn("slot", F.when((F.col("value") == "markdown") & (F.col("slot") == "text_type"), "format").otherwise(F.col("slot")))
    refs = o.select("option_seq", F.posexplode("compatible_templates").alias("_p", "old_id"))
    hit = lookup(refs, gone, ["old_id"], F.col("option_seq")).groupBy("option_seq").agg(F.map_from_entries(F.collect_set(F.struct("old_id", "kept_id"))).alias("_m"))
    mapped = F.array_distinct(F.transform("compatible_templates", lambda x: F.coalesce(F.element_at("_m", x), x)))
    return o.join(hit, "option_seq", "left").withColumn("compatible_templates", F.when(F.col("_m").isNull(), F.array_distinct(F.coalesce("compatible_templates", none))).otherwise(mapped)).drop("_m")


def is_self_named(slot: Column, value: Column) -> Column:
    """Whether a value only repeats its slot's name: equal, or under three words with the name within."""
    low, name = F.lower(F.regexp_replace(value, r"^\s+|\s+$", "")), F.lower(slot)
    return (name == low) | ((X.word_count(value) < 3) & F.contains(low, name))


def slot_of_self_named(slot: Column, value: Column, task_types: Column) -> Column:
    """Where such an option goes: by its value, by its slot, by the first of task_types that has a default slot other than
    the value, else to description; null if the slot is a preferred one, as then the option says nothing."""
    low, name = F.lower(F.regexp_replace(value, r"^\s+|\s+$", "")), F.lower(slot)
    named = map_of({w: s for s, ws in V.SELF_NAMED.items() for w in ws})
    default = map_of(V.DEFAULT_SLOTS)
    of_type = F.get(F.filter(F.transform(task_types, lambda t: F.element_at(default, t)), lambda s: s.isNotNull() & (F.lower(s) != low)), F.lit(0))
    return F.when(name.isin(*V.PREFERRED_SLOTS), F.lit(None).cast("string")).otherwise(F.coalesce(F.element_at(named, low), F.element_at(named, name), of_type, F.lit("description")))


def self_named(options: DataFrame) -> DataFrame:
    """(option_seq, new_slot): options that only repeat their slot's name and where they go; new_slot is null where they are
    dropped. Null and blank slots and values are none."""
    types = F.filter(F.coalesce("compatible_task_types", F.array().cast("array<string>")), lambda x: x.isNotNull())
    hit = ~X.blank("slot") & ~X.blank("value") & is_self_named(F.col("slot"), F.col("value"))
    return options.where(hit).select("option_seq", slot_of_self_named(F.col("slot"), F.col("value"), types).alias("new_slot"))


def numbered_map(templates: DataFrame) -> DataFrame:
    """(unit, slot, merged): per unit (one prompt's templates) the slots that differ from others in a trailing number only."""
    s = templates.select("unit", F.explode(F.array_distinct("slots")).alias("slot")).distinct().where(F.col("slot").rlike(r"^.+?[0-9]+$"))
    s = s.withColumn("base", F.regexp_replace(F.regexp_extract("slot", r"^(.+?)([0-9]+)$", 1), "_+$", "")).withColumn("_k", F.count("*").over(W.partitionBy("unit", "base"))).where("_k > 1")
    return s.select("unit", "slot", F.when(F.col("base").isin("n", ""), "number_list").when(F.col("base").endswith("s"), F.col("base")).otherwise(F.concat("base", F.lit("_list"))).alias("merged"))


def numbered_merged(templates: DataFrame, options: DataFrame, join_values: bool = True) -> tuple[DataFrame, DataFrame]:
    """Templates (unit, template_seq, text, slots) and options (unit, option_seq, slot, value, and more) with numbered slots as
    one: the first such placeholder of a template is renamed, further ones go with their comma; the options' values become
    one list per unit and slot (join_values), else they are only renamed."""
    m = numbered_map(templates)
    maps = m.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("slot", "merged"))).alias("_m"))
    t = templates.join(maps, "unit", "left")
    brace = lambda s: F.concat(F.lit("{"), s, F.lit("}"))

    def without(text: Column, p: Column) -> Column:
        ahead, behind = F.concat(F.lit(", "), p), F.concat(p, F.lit(", "))
        return F.when(F.contains(text, ahead), X.replace_first(text, ahead, F.lit(""))).when(F.contains(text, behind), X.replace_first(text, behind, F.lit(""))).otherwise(X.replace_first(text, p, F.lit("")))

    def step(acc: Column, s: Column) -> Column:
        new = F.element_at("_m", s)
        again = F.array_contains(acc["seen"], new)
        text = F.when(new.isNull(), acc["text"]).when(again, without(acc["text"], brace(s))).otherwise(X.replace_first(acc["text"], brace(s), brace(new)))
        return F.struct(text.alias("text"), F.when(new.isNull() | again, acc["seen"]).otherwise(F.concat(acc["seen"], F.array(new))).alias("seen"))

    start = F.struct(F.col("text").alias("text"), F.array().cast("array<string>").alias("seen"))
    changed = F.aggregate("slots", start, step)
    slots = F.array_distinct(F.transform("slots", lambda s: F.coalesce(F.element_at("_m", s), s)))
    hit = F.col("_m").isNotNull() & F.col("slots").isNotNull()
    t = t.withColumn("_t", F.when(hit, changed["text"]).otherwise(F.col("text"))).withColumn("slots", F.when(hit, slots).otherwise(F.col("slots"))).withColumn("text", F.col("_t")).drop("_t", "_m")
    o = options.join(m, ["unit", "slot"], "left")
    if not join_values:
        return t, o.withColumn("slot", F.coalesce("merged", "slot")).drop("merged")
    rest = [c for c in options.columns if c not in ("unit", "slot", "value")]
    joined = o.where("merged is not null").groupBy("unit", F.col("merged").alias("slot")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("option_seq", "value"))), lambda x: x["value"]), ", ").alias("value"), F.min_by(F.struct(*rest), "option_seq").alias("r")
    ).select("unit", "slot", "value", "r.*")
    return t, o.where("merged is null").drop("merged").unionByName(joined)


def valid_templates(templates: DataFrame, leaves: DataFrame) -> DataFrame:
    """Templates whose task_type the taxonomy has; old level names brought up to date, a level that is none taken from the
    taxonomy."""
    known = leaves.groupBy(F.col("label").alias("task_type")).agg(F.min("level").alias("_level"))
    level = F.coalesce(F.element_at(map_of(V.OLD_LEVELS), F.col("level")), "level")
    t = templates.join(F.broadcast(known), "task_type")
    return t.withColumn("level", F.when(level.isin(*V.LEVELS), level).otherwise(F.col("_level"))).drop("_level")
