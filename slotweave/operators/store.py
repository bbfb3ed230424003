"""The template and option store: summary, compatibility of options with template slots, coverage."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotweave.functions import text as X
from slotweave.operators.skew import lookup


def _options(options: DataFrame) -> DataFrame:
    """One row an option id, the first delivered, with slot and value."""
    o = options.where(~X.blank("slot") & ~X.blank("value"))
    none = F.array().cast("array<string>")
    return o.groupBy("id").agg(F.min_by(F.struct("slot", F.coalesce("compatible_task_types", none).alias("types"), F.coalesce("compatible_templates", none).alias("templates"), "value"), "option_seq").alias("r")).select("id", "r.*")


def _templates(templates: DataFrame) -> DataFrame:
    """One row a template id, the first delivered."""
    return templates.where(~X.blank("text")).groupBy("id").agg(F.min_by(F.struct("template_seq", "text", "slots", "task_type", "level"), "template_seq").alias("r")).select("id", "r.*")


def template_slots(templates: DataFrame) -> DataFrame:
    t = _templates(templates)
    return t.select("id", "task_type", F.explode(F.array_distinct("slots")).alias("slot")).where(~X.blank("slot"))


def summary(templates: DataFrame, options: DataFrame) -> DataFrame:
    """(what, name, n): rows, options with several task types, templates by level, options by slot."""
    rows = templates.agg(F.count("*").alias("n")).select(F.lit("templates").alias("what"), F.lit("").alias("name"), "n")
    both = options.agg(F.count("*").alias("a"), F.count_if(F.size("compatible_task_types") > 1).alias("b")).select(F.explode(F.array(
        F.struct(F.lit("options").alias("what"), F.lit("").alias("name"), F.col("a").alias("n")), F.struct(F.lit("multi_type_options").alias("what"), F.lit("").alias("name"), F.col("b").alias("n")))).alias("x")).select("x.*")
    level = templates.groupBy(F.coalesce("level", F.lit("")).alias("name")).agg(F.count("*").alias("n")).select(F.lit("level").alias("what"), "name", "n")
    slot = options.groupBy(F.coalesce("slot", F.lit("")).alias("name")).agg(F.count("*").alias("n")).select(F.lit("slot").alias("what"), "name", "n")
    return rows.unionByName(both).unionByName(level).unionByName(slot)


def compatible_counts(templates: DataFrame, options: DataFrame) -> DataFrame:
    """(id, slot, matched, in_slot, usable) per template slot: options of the slot that fit the template (by task type, as
    universal, or by template id), all options of the slot, and what can be used: the former, all if there are none.

    Counted per (slot, task type) and per (slot, template), never per pair of template and option: an option that names
    the template counts there only if its task types don't already fit."""
    o, ts = _options(options), template_slots(templates)
    universal = o.where(F.array_contains("types", "_universal")).groupBy("slot").agg(F.count("*").alias("u"))
    by_type = o.where(~F.array_contains("types", "_universal")).select("slot", F.explode(F.array_distinct("types")).alias("task_type")).groupBy("slot", "task_type").agg(F.count("*").alias("a"))
    types = _templates(templates).select("id", "task_type")
    named = o.where(~F.array_contains("types", "_universal")).select("slot", "types", F.explode(F.array_distinct("templates")).alias("id")).join(types, "id")
    by_template = named.where(~F.coalesce(F.array_contains("types", F.col("task_type")), F.lit(False))).groupBy("slot", "id").agg(F.count("*").alias("b"))
    total = o.groupBy("slot").agg(F.count("*").alias("in_slot"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = ts.join(total, "slot", "left").join(universal, "slot", "left").join(by_type, ["slot", "task_type"], "left").join(by_template, ["slot", "id"], "left")
    return out.select("id", "slot", (zero("a") + zero("b") + zero("u")).alias("matched"), zero("in_slot").alias("in_slot")).withColumn("usable", F.when(F.col("matched") > 0, F.col("matched")).otherwise(F.col("in_slot")))


def undercovered(templates: DataFrame, options: DataFrame) -> DataFrame:
    """Templates with slots of which none has more than one distinct value: (id, n_slots)."""
    values = _options(options).groupBy("slot").agg(F.count_distinct("value").alias("v"))
    return template_slots(templates).join(values, "slot", "left").groupBy("id").agg(F.count("*").alias("n_slots"), F.max(F.coalesce("v", F.lit(0))).alias("m")).where("m <= 1").drop("m")


def reusable(templates: DataFrame, most: int = 20) -> DataFrame:
    """(id, framing, n_slots, kept): templates are no use if a lone slot without text, or with over `most` fixed words."""
    t = _templates(templates)
    n = F.size(F.array_distinct(X.placeholders(F.col("text"))))
    f = X.framing_words(F.col("text"))
    return t.select("id", f.alias("framing"), n.alias("n_slots"), (~(((f == 0) & (n == 1)) | (f > most))).cast("int").alias("kept"))


def slot_coverage(templates: DataFrame, options: DataFrame, least: int = 3) -> DataFrame:
    """(id, slot, usable) of template slots with fewer than `least` options, those without any included: options of the
    slot that fit the template's task type, or all of the slot if none does."""
    o, ts = _options(options), template_slots(templates)
    by_type = o.select("slot", F.explode(F.array_distinct("types")).alias("task_type")).groupBy("slot", "task_type").agg(F.count("*").alias("a"))
    total = o.groupBy("slot").agg(F.count("*").alias("b"))
    # Slots with `least` options of the type or more are of no interest, so few rows remain of the counts.
    out = ts.join(by_type, ["slot", "task_type"], "left").join(total, "slot", "left").withColumn("usable", F.coalesce("a", "b", F.lit(0)))
    return out.where(F.col("usable") < least).select("id", "slot", "usable")


def first_fill(templates: DataFrame, options: DataFrame) -> DataFrame:
    """Templates with `filled`: each placeholder's first occurrence filled with its slot's first option, else __slot__."""
    first = options.where(~X.blank("slot") & ~X.blank("value")).groupBy("slot").agg(F.min_by("value", "option_seq").alias("value"))
    t = _templates(templates).withColumn("held", F.array_distinct(X.placeholders(F.col("text"))))
    s = lookup(t.select("id", F.posexplode_outer("held").alias("p", "slot")), first, ["slot"], F.col("id"), "left")
    pairs = s.where("slot is not null").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("p", "slot", F.coalesce("value", F.concat(F.lit("__"), "slot", F.lit("__"))).alias("value")))).alias("pairs"))
    t = t.join(pairs, "id", "left").withColumn("pairs", F.coalesce("pairs", F.array().cast("array<struct<p:int,slot:string,value:string>>")))
    filled = F.aggregate("pairs", F.col("text"), lambda acc, p: X.replace_first(acc, F.concat(F.lit("{"), p["slot"], F.lit("}")), p["value"]))
    return t.select("id", "template_seq", "task_type", "held", filled.alias("filled"))


def same_type_collisions(filled: DataFrame) -> DataFrame:
    """(first_id, other_id): templates of one task type that read the same once filled, each with the first of them. A
    hot text is handled by aggregation: the first is a min_by, the others are joined to it."""
    first = filled.groupBy("filled", "task_type").agg(F.min_by("id", "template_seq").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return lookup(filled, first.drop("n"), ["filled", "task_type"], F.col("id")).where("id <> first_id").select("first_id", F.col("id").alias("other_id"))


def _cross_type(filled: DataFrame) -> DataFrame:
    """(filled, id, template_seq, task_type, held): of the texts that come out under two task types or more, the first
    template of each type (the others are same-type collisions), so a group is as large as there are types."""
    one = filled.groupBy("filled", F.coalesce("task_type", F.lit("")).alias("task_type")).agg(F.min_by(F.struct("id", "held"), "template_seq").alias("r"), F.min("template_seq").alias("template_seq"))
    return one.select("filled", "task_type", "template_seq", "r.id", F.array_join(F.array_sort("r.held"), "|").alias("held"))


def cross_type_groups(filled: DataFrame) -> DataFrame:
    """(first_id, types, slot_sets, kind): equal filled texts under several task types; 'merge' if their slot sets are
    equal, else 'semantic collision'."""
    g = _cross_type(filled).groupBy("filled").agg(F.min_by("id", "template_seq").alias("first_id"), F.count("*").alias("types"), F.count_distinct("held").alias("slot_sets"))
    return g.where("types > 1").select("first_id", "types", "slot_sets", F.when(F.col("slot_sets") == 1, "merge").otherwise("semantic collision").alias("kind"))


def semantic_collisions(filled: DataFrame) -> DataFrame:
    """(first_id, id, task_type, slots): the members of each group of templates that read the same under several task types
    but have other slots: any two of a group collide."""
    one = _cross_type(filled)
    g = one.groupBy("filled").agg(F.min_by("id", "template_seq").alias("first_id"), F.count("*").alias("types"), F.count_distinct("held").alias("sets")).where("types > 1 and sets > 1")
    return one.join(g, "filled").select("first_id", "id", "task_type", F.col("held").alias("slots"))


def substitution_rates(templates: DataFrame, options: DataFrame, detector, fillings: int = 5, most: float = 0.4) -> DataFrame:
    """(id, ok, fail_rate) of the task templates that fail in more than `most` of `fillings` fillings: each slot gets an
    option that fits (any of the slot if none does, else the slot's name), picked by hash; a filling is right if it still
    shows an instruction (detector: text column -> boolean)."""
    from slotweave.operators.generate import drawn, number_of, pool

    t = _templates(templates).where("level = 'task_type' and trim(task_type) <> ''").withColumn("held", F.array_distinct(X.placeholders(F.col("text")))).where(F.size("held") > 0)
    s = t.select(F.col("id").alias("template"), F.col("task_type").alias("label"), F.posexplode("held").alias("p", "slot")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(fillings))))
    s = s.withColumn("h", number_of(F.concat_ws("|", "template", F.col("k").cast("string"), "slot")))
    pairs = drawn(s, pool(templates, options)).groupBy(F.col("template").alias("id"), "k").agg(F.array_sort(F.collect_list(F.struct("p", "slot", F.coalesce("value", "slot").alias("value")))).alias("pairs"))
    done = pairs.join(t.select("id", "text"), "id").withColumn("ok", detector(X.fill_all(F.col("text"), F.col("pairs"))).cast("int"))
    rate = 1 - F.sum("ok") / F.lit(fillings)
    return done.groupBy("id").agg(F.sum("ok").alias("ok"), F.round(rate, 2).alias("fail_rate"), rate.alias("_f")).where(F.col("_f") > most).drop("_f")


def with_augmented(options: DataFrame, augmented: DataFrame) -> DataFrame:
    """One row an id of the options and, behind them, the augmented ones: the first of each with the compatibility lists of
    all in order, repeats dropped. Rows without id are left out."""
    none = F.array().cast("array<string>")
    lists = [c for c in ("compatible_task_types", "compatible_templates") if c in options.columns]
    a = options.withColumn("_o", F.struct(F.lit(0).alias("x"), F.col("option_seq").alias("z")))
    b = augmented.withColumn("_o", F.struct(F.lit(1).alias("x"), F.lit(0).cast("long").alias("z")))
    both = a.unionByName(b, allowMissingColumns=True).where("id is not null")
    # Equal lists of an id are folded first, so that many exact copies stay small.
    folded = both.groupBy("id", *[F.coalesce(c, none).alias(c) for c in lists]).agg(F.min("_o").alias("_o"), F.min_by(F.struct("slot", "value"), "_o").alias("r"))
    all_of = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_o", F.col(c).alias("a")))), lambda x: x["a"])))
    return folded.groupBy("id").agg(F.min_by("r", "_o").alias("r"), *[all_of(c).alias(c) for c in lists]).select("id", "r.*", *lists)


def find(templates: DataFrame, task_type: str | None = None, level: str | None = None, slot: str | None = None) -> DataFrame:
    """Templates of a task type, a level and with a slot; filters that reach the files."""
    for c, v in (("task_type", task_type), ("level", level)):
        if v is not None:
            templates = templates.where(F.col(c) == v)
    return templates if slot is None else templates.where(F.array_contains("slots", slot))


def degenerate(templates: DataFrame, source: str = "ablation_degenerate") -> DataFrame:
    """(id, text) of templates that only test what degenerate text does."""
    return templates.where(F.col("source") == source).select("id", "text")


def validation(templates: DataFrame, options: DataFrame, detector, fillings: int = 5, least: int = 3) -> dict[str, DataFrame]:
    """All tests of a store, as sections of a report (sources.writers.save_report writes it). Nothing is changed or halted."""
    filled = first_fill(templates, options)
    groups = cross_type_groups(filled)
    return {
        "substitution_failures": substitution_rates(templates, options, detector, fillings),
        "same_type_merges": same_type_collisions(filled),
        "cross_type_merges": groups.where("kind = 'merge'"),
        "semantic_collisions": groups.where("kind <> 'merge'"),
        "undercovered_slots": slot_coverage(templates, options, least),
        "degenerate_templates": degenerate(templates),
        "templates_tested": _templates(templates).select("id"),
        "options_tested": _options(options).select("id"),
    }
