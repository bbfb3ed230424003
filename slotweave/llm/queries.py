"""The registered queries of this subpackage: the problems' operators over the whole tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.llm import canonical, cooccur, frequency, leakage, ledger, packing, residue, subjects
from slotweave.session import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.mapped_slots(read(spark, d, "task_options"), read(spark, d, "task_templates"), read(spark, d, "slot_catalog"))


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Names that mean no entry, with how often they occur."""
    options, templates = read(spark, d, "task_options"), read(spark, d, "task_templates")
    names = canonical.slot_names(options, templates)
    return canonical.canonical(names, "name", read(spark, d, "slot_catalog")).where("slot_id = -1").groupBy("name").agg(F.count("*").alias("n"))


def _copies(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "task_options").where(F.length("value") >= 60).select(F.lit("option").alias("record_kind"), F.col("option_seq").alias("seq"), F.col("value").alias("text"))
    t = read(spark, d, "task_templates").select(F.lit("template").alias("record_kind"), F.col("template_seq").alias("seq"), "text")
    return o.unionByName(t)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return ledger.find_copies(_copies(spark, d))


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return ledger.collapsed(_copies(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.pair_counts(cooccur.clean_labels(read(spark, d, "generated_prompts")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where("n_ab >= 5 and n_ab * n >= 2 * n_a * n_b").select("label_a", "label_b")


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.with_chance(_pairs(spark, d))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return frequency.term_table(frequency.fields(read(spark, d, "task_options"), read(spark, d, "task_templates"), read(spark, d, "generated_prompts")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where("mark is not null").select("field_name", "term", "mark")


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("field_name", "term", "occurrences", "records", F.coalesce("mark", F.lit("")).alias("mark"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "generated_prompts").select(F.lit("prompt").alias("record_kind"), F.col("id").alias("record_key"), F.col("prompt").alias("text"))
    t = read(spark, d, "task_templates").select(F.lit("template").alias("record_kind"), F.col("template_seq").alias("record_key"), "text")
    return residue.mark_residue(p.unionByName(t)).distinct()


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(read(spark, d, "documents"), read(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    names = [r[0] for r in read(spark, d, "subject_areas").select("subject").orderBy("subject").collect()]
    examples = [(r["text"], r["subject"]) for r in read(spark, d, "subject_examples").orderBy("example_id").collect()]
    return subjects.mark_subjects(read(spark, d, "documents"), examples, names).select("doc_id", "subject")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_unmatched, p3_found, p3_collapsed, p4_found, p4_pairs, p5_found, p5_terms, p6_found, p7_packed, p8_found, p9_found)}
