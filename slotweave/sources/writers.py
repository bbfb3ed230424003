"""Sinks: the store, generated prompts with their coverage, reports, taxonomies."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_store(templates: DataFrame, options: DataFrame, path: str, form: str = "parquet") -> None:
    """Both tables under path, unset fields left out in JSON; options partitioned by nothing, sorted by slot for pruning."""
    templates.write.mode("overwrite").format(form).save(f"{path}/templates")
    options.sortWithinPartitions("slot").write.mode("overwrite").format(form).save(f"{path}/options")


def augmented(options: DataFrame) -> DataFrame:
    """Options that came from augmentation."""
    return options.where(F.col("source_option_id").isNotNull() | (F.col("source") == "augmented"))


def save_prompts(prompts: DataFrame, path: str) -> None:
    """JSON lines, and beside them how often each label was used and how many combinations are distinct."""
    prompts.write.mode("overwrite").json(path)
    prompts.select(F.explode("active_labels").alias("label")).groupBy("label").agg(F.count("*").alias("n")).write.mode("overwrite").json(f"{path}.coverage/labels")
    prompts.agg(F.count("*").alias("prompts"), F.count_distinct("combo_id").alias("combos")).write.mode("overwrite").json(f"{path}.coverage/summary")


def save_report(sections: dict[str, DataFrame], path: str) -> None:
    """One JSON table a section."""
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def save_presence(matrix: DataFrame, path: str) -> None:
    """A presence matrix as CSV with header."""
    matrix.write.mode("overwrite").option("header", True).csv(path)


def save_taxonomy(leaves: DataFrame, path: str) -> None:
    """The leaves by level and group, nested, as JSON: levels and groups are few."""
    g = leaves.groupBy("level", "label_group").agg(F.array_sort(F.collect_list(F.struct("label", "description"))).alias("labels"))
    g.groupBy("level").agg(F.array_sort(F.collect_list(F.struct("label_group", "labels"))).alias("groups")).write.mode("overwrite").json(path)


def save_segments(segments: DataFrame, path: str) -> None:
    """Segments as JSON lines, in the form that readers.load_segments reads."""
    segments.select("span_text", "taxonomy_label", "level", "source_prompt", "classification_method").write.mode("overwrite").json(path)


def save_few_shots(examples: DataFrame, path: str) -> None:
    """(dataset, prompt, annotation) as one JSON object of lists by data set: worked examples are few. An example without
    annotation keeps a null."""
    one = F.to_json(F.struct("prompt", "annotation"), {"ignoreNullFields": "false"})
    lists = examples.groupBy("dataset").agg(F.array_join(F.array_sort(F.collect_list(one)), ",").alias("l"))
    whole = lists.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.to_json(F.array("dataset")), F.lit("\u0001"), "l"))), "\u0002").alias("v"))
    # '["name"]\u0001items' becomes '"name":[items]'.
    body = F.transform(F.split("v", "\u0002"), lambda x: F.concat(F.regexp_extract(x, r"(?s)^\[(.*?)\]\u0001", 1), F.lit(":["), F.regexp_replace(x, r"(?s)^.*?\u0001", ""), F.lit("]")))
    whole.select(F.concat(F.lit("{"), F.array_join(body, ","), F.lit("}")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def save_types(types: DataFrame, path: str) -> None:
    """Option types by category, in order, one JSON object a category."""
    one = F.struct("name", "category", "description", "compatible_slots", "example_values")
    types.groupBy("category").agg(F.array_sort(F.collect_list(one)).alias("types")).orderBy("category").write.mode("overwrite").json(path)
