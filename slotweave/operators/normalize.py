"""Normalising templates and options: slots, duplicates, links and what must be dropped."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotweave.functions import text as X
from slotweave.functions import values as V
from slotweave.operators.skew import lookup


def renamed_slots(options: DataFrame) -> DataFrame:
    """(slot, canonical, n) for each distinct slot name that has a canonical form."""
    names = options.where(~X.blank("slot")).groupBy("slot").agg(F.count("*").alias("n"))
    return names.withColumn("canonical", X.canonical_slot(F.col("slot"))).where(F.col("canonical").isNotNull() & (F.col("canonical") != F.col("slot")))


def with_canonical_slots(templates: DataFrame, options: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with canonical slot names; a renamed slot is renamed in the template's text too, repeats dropped."""
    name = lambda s: F.coalesce(X.canonical_slot(s), s)
    pairs = F.transform("slots", lambda s: F.struct(s.alias("slot"), F.concat(F.lit("{"), name(s), F.lit("}")).alias("value")))
    t = templates.withColumn("text", F.coalesce(X.fill_all(F.col("text"), F.filter(pairs, lambda p: p["value"].isNotNull())), "text"))
    return t.withColumn("slots", F.array_distinct(F.transform("slots", name))), options.withColumn("slot", name(F.col("slot")))


def synced_slots(templates: DataFrame) -> DataFrame:
    """slots: the listed ones that the text has, in order, then the text's other ones, sorted."""
    held = X.placeholders(F.col("text"))
    listed = F.coalesce("slots", F.array().cast("array<string>"))
    return templates.withColumn("slots", F.concat(F.filter(F.array_distinct(listed), lambda s: F.array_contains(held, s)), F.array_sort(F.array_distinct(F.array_except(held, listed)))))


def expanded_lists(options: DataFrame, slots=("keyword", "option", "completion")) -> DataFrame:
    """One row per non-blank part of a comma list in the given slots (two parts or more), value replaced; others as is."""
    parts = F.filter(F.transform(F.split("value", ","), lambda p: F.trim(p)), lambda p: p != "")
    many = F.col("slot").isin(*slots) & (F.size(parts) >= 2)
    return options.withColumn("value", F.explode(F.when(many, parts).otherwise(F.array("value"))))


def without_broken(options: DataFrame) -> DataFrame:
    """Options whose value holds no placeholder; null values stay."""
    return options.where(~F.coalesce(F.col("value").rlike(r"\{\w+\}"), F.lit(False)))


def without_repeated_placeholders(templates: DataFrame) -> DataFrame:
    p = X.placeholders(F.col("text"))
    return templates.where(F.size(p) == F.size(F.array_distinct(p)))


def _merged(column: str) -> "F.Column":
    """Arrays of a group appended in the order of arrival, repeats dropped."""
    return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_seq", F.coalesce(column, F.array().cast("array<string>")).alias("a")))), lambda x: x["a"])))


def merged_templates(templates: DataFrame) -> DataFrame:
    """One row per (text, level): the first, with all links sorted. Equal link lists are folded before they are gathered,
    so a group of many exact copies stays small."""
    t = templates.withColumnRenamed("template_seq", "_seq").where(~X.blank("text"))
    folded = t.groupBy("text", "level", F.coalesce("compatible_with", F.array().cast("array<string>")).alias("compatible_with")).agg(F.min("_seq").alias("_seq"), F.count("*").alias("_n"), F.min_by("id", "_seq").alias("id"))
    links = F.array_sort(F.array_distinct(F.flatten(F.collect_set("compatible_with"))))
    return folded.groupBy("text", "level").agg(F.min("_seq").alias("template_seq"), F.min_by("id", "_seq").alias("id"), F.sum("_n").alias("n"), links.alias("compatible_with"))


def merged_options(options: DataFrame, keys: tuple[str, ...] = ("slot", "value")) -> DataFrame:
    """One row per (slot, value): the first, with the distinct compatibility lists of all appended in order."""
    o = options.where(~X.blank("slot") & ~X.blank("value")).withColumnRenamed("option_seq", "_seq")
    none = F.array().cast("array<string>")
    folded = o.groupBy(*keys, F.coalesce("compatible_task_types", none).alias("compatible_task_types"), F.coalesce("compatible_templates", none).alias("compatible_templates")).agg(
        F.min("_seq").alias("_seq"), F.count("*").alias("_n")
    )
    return folded.groupBy(*keys).agg(
        F.min("_seq").alias("option_seq"), F.sum("_n").alias("n"), _merged("compatible_task_types").alias("compatible_task_types"), _merged("compatible_templates").alias("compatible_templates")
    )


def orphans(options: DataFrame, templates: DataFrame) -> DataFrame:
    """Options with a blank value, or whose slot no template has: (option_seq, why)."""
    used = templates.select(F.explode("slots").alias("slot")).where(F.col("slot").isNotNull()).distinct().withColumn("_used", F.lit(True))
    o = lookup(options.select("option_seq", "slot", X.blank("value").alias("_blank")), used, ["slot"], F.col("option_seq"), "left")
    return o.where(F.col("_blank") | F.col("_used").isNull()).select("option_seq", F.when(F.col("_blank"), "blank value").otherwise("unused slot").alias("why"))


def relinked(templates: DataFrame, options: DataFrame) -> DataFrame:
    """(template_seq, n_slots, n_options, unfilled): how many options each template's slots link to. Options are counted
    per slot first; the pairs themselves are never built."""
    per_slot = options.where(~X.blank("slot") & ~X.blank("value")).groupBy("slot").agg(F.count_distinct("id").alias("k"))
    s = templates.select("template_seq", F.explode_outer(F.array_distinct("slots")).alias("slot"))
    return lookup(s, per_slot, ["slot"], F.col("template_seq"), "left").groupBy("template_seq").agg(
        F.count("slot").alias("n_slots"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_options"), F.count_if(F.col("slot").isNotNull() & F.col("k").isNull()).alias("unfilled")
    )


def numbered_groups(templates: DataFrame) -> DataFrame:
    """(template_seq, base, members): slots of one template that differ in a trailing number only, two or more."""
    s = templates.select("template_seq", F.explode(F.array_distinct("slots")).alias("slot")).where(F.col("slot").rlike(r"^.+?[0-9]+$"))
    s = s.withColumn("base", F.regexp_replace(F.regexp_extract("slot", r"^(.+?)([0-9]+)$", 1), "_+$", ""))
    merged = F.when(F.col("base").isin("n", ""), "number_list").when(F.col("base").endswith("s"), F.col("base")).otherwise(F.concat("base", F.lit("_list")))
    return s.groupBy("template_seq", "base").agg(F.array_join(F.array_sort(F.collect_set("slot")), ",").alias("members"), F.count("*").alias("k")).where("k >= 2").select("template_seq", merged.alias("merged_slot"), "members")


def content_ids(templates: DataFrame, options: DataFrame) -> DataFrame:
    """(kind, seq, new_id): ids rebuilt from content; null where a part is null."""
    t = templates.select(F.lit("template").alias("kind"), F.col("template_seq").alias("seq"), X.content_id(F.col("task_type"), F.col("text")).alias("new_id"))
    return t.unionByName(options.select(F.lit("option").alias("kind"), F.col("option_seq").alias("seq"), X.content_id(F.col("slot"), F.col("value")).alias("new_id")))


def normalized(templates: DataFrame, options: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole chain: rename slots, split lists, sync slots, drop broken, merge templates, drop orphans, merge options."""
    t, o = with_canonical_slots(templates, options)
    t, o = synced_slots(without_repeated_placeholders(t.where(~X.blank("text")))), without_broken(expanded_lists(o))
    slots = t.select(F.explode("slots").alias("slot")).distinct()
    return merged_templates(t), merged_options(lookup(o, slots, ["slot"], F.col("option_seq")))


def capped(df: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """At most `most` rows a group, first in order (a per-source cap); Spark limits each task's groups before the shuffle."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(order))).where(F.col("_r") <= most).drop("_r")
