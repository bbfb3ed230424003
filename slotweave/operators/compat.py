"""Semantic compatibility: options against the contexts of template slots, and the three tiers that a slot draws from."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.functions import backends
from slotweave.functions import text as X
from slotweave.operators import vectors
from slotweave.operators.generate import pool
from slotweave.operators.store import _options, _templates
from slotweave.session import cut

UNIVERSAL = "_universal"


def slot_contexts(templates: DataFrame) -> DataFrame:
    """(id, slot, context): each template's text once a slot, with [SOMETHING] where the slot stands."""
    t = _templates(templates).select("id", "text", F.explode(F.array_distinct("slots")).alias("slot")).where(~X.blank("slot"))
    return t.select("id", "slot", F.replace("text", F.concat(F.lit("{"), "slot", F.lit("}")), F.lit("[SOMETHING]")).alias("context"))


def index(templates: DataFrame, options: DataFrame, make: Callable = backends.WordEmbedder, least: float = 0.7, most: int = 50, only: DataFrame | None = None) -> DataFrame:
    """(id, slot, option_id, score, rank): for each context of a slot (of those in only: id, slot) up to `most` options whose
    value has a cosine of at least `least` to it. Distinct contexts and distinct values are embedded once each; ties by
    option id."""
    contexts = slot_contexts(templates)
    if only is not None:
        contexts = contexts.join(only, ["id", "slot"], "left_semi")
    # Pairs as two texts of one array: an id and its slot.
    contexts = contexts.groupBy(F.col("context").alias("text")).agg(F.collect_list(F.array("id", "slot")).alias("about"))
    o = options.where(~X.blank("slot") & ~X.blank("value")).groupBy("id").agg(F.min_by("value", "option_seq").alias("text"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id"))), lambda x: x["id"])
    values = o.groupBy("text").agg(F.slice(ids, 1, most).alias("ids"))
    found = vectors.nearest(cut(contexts), values, make, most, least)
    return found.select(F.get("about", F.lit(0)).alias("id"), F.get("about", F.lit(1)).alias("slot"), F.col("vec_id").alias("option_id"), "score", "rank")


def tiers(templates: DataFrame, options: DataFrame, type_slots: DataFrame, found: DataFrame | Callable[[DataFrame], DataFrame], least: int = 3) -> DataFrame:
    """(id, slot, tier, n1, n2, n3) per template slot: options that fit (all of the slot if none does); with fewer than
    `least` of them also those whose option_type goes with the slot (type_slots: option_type, slot); with fewer than
    `least` still, those that the index (id, slot, option_id; or a
    function that gives it for the rows (id, slot) that ask) gives. n1 to n3 count what each tier adds, null where it isn't
    asked; tier is the last one asked. Only slots with fewer than `least` options meet options one by one."""
    o = _options(options)
    types = options.where(F.col("option_type").isNotNull()).groupBy("id").agg(F.min_by("option_type", "option_seq").alias("option_type"))
    lists = pool(templates, options)
    t = _templates(templates).select(F.col("id").alias("template"), F.coalesce("task_type", F.lit("")).alias("label"), F.explode(F.array_distinct("slots")).alias("slot")).where(~X.blank("slot"))
    names = F.array(F.lit("u"), F.concat(F.lit("t|"), "label"), F.concat(F.lit("i|"), "template"), F.lit("a"))
    wanted = t.select("*", F.posexplode(names).alias("k", "list"))
    sizes = lists.where("rank = 0").select("slot", "list", "size")
    n = wanted.join(sizes, ["slot", "list"], "left").groupBy("template", "label", "slot").agg(F.coalesce(F.sum(F.when(F.col("k") < 3, F.col("size"))), F.lit(0)).alias("fit"), F.coalesce(F.max(F.when(F.col("k") == 3, F.col("size"))), F.lit(0)).alias("all"))
    n = n.withColumn("n1", F.when(F.col("fit") > 0, F.col("fit")).otherwise(F.col("all")))
    n = cut(n)  # few rows each, here and below, that took shuffles of all lists; each is needed more than once
    few = n.where(F.col("n1") < least).select("template", "slot", "n1", "fit")
    # At most least - 1 options each: the first tier of the slots that need a second.
    mine = cut(few.join(wanted, ["template", "slot"]).where(F.when(F.col("fit") > 0, F.col("k") < 3).otherwise(F.col("k") == 3)).join(lists.select("slot", "list", F.col("id").alias("option_id")), ["slot", "list"]).select("template", "slot", "option_id"))
    of_type = types.join(o.select("id"), "id").groupBy("option_type").agg(F.count("*").alias("c"))
    typed = type_slots.select("option_type", "slot").distinct()
    there = typed.join(of_type, "option_type").groupBy("slot").agg(F.sum("c").alias("c"))
    again = mine.join(types.withColumnRenamed("id", "option_id"), "option_id").join(typed, ["option_type", "slot"], "left_semi").groupBy("template", "slot").agg(F.count("*").alias("d"))
    two = cut(few.join(there, "slot", "left").join(again, ["template", "slot"], "left").withColumn("n2", F.coalesce("c", F.lit(0)) - F.coalesce("d", F.lit(0))))
    last = two.where(F.col("n1") + F.col("n2") < least).select("template", "slot")
    # What the first two tiers of these hold is fewer than `least` options, so it can be taken one by one.
    second = last.join(typed, "slot").join(types.join(o.select("id"), "id").withColumnRenamed("id", "option_id"), "option_type").select("template", "slot", "option_id")
    held = mine.join(last, ["template", "slot"]).unionByName(second).distinct()
    if not isinstance(found, DataFrame):
        found = found(last.select(F.col("template").alias("id"), "slot"))
    new = found.select(F.col("id").alias("template"), "slot", "option_id").join(last, ["template", "slot"]).join(held, ["template", "slot", "option_id"], "left_anti")
    three = last.join(new.groupBy("template", "slot").agg(F.count("*").alias("n3")), ["template", "slot"], "left").select("template", "slot", F.coalesce("n3", F.lit(0)).alias("n3"))
    out = n.join(two.select("template", "slot", "n2"), ["template", "slot"], "left").join(three, ["template", "slot"], "left")
    tier = F.when(F.col("n2").isNull(), 1).when(F.col("n3").isNull(), 2).otherwise(3)
    return out.select(F.col("template").alias("id"), "slot", tier.alias("tier"), "n1", "n2", "n3")
