"""Mapping free-entered values to the entries of a reference list: a BK-tree under an edit metric.

Names are reduced to their words first (case, separators, humps, brackets, articles, trailing numbers and the like), then
looked up in a BK-tree of all reference forms, abbreviations as what they stand for; each entry within the threshold is
returned and the nearest wins (ties: the nearer kind of form, then the smaller id). A list beyond the bound of one tree is
sharded, and the shards' findings merged. Null and blank names give no row; names that mean nothing get -1."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.operators import mapping
from slotweave.operators.mapping import MAX_BROADCAST


def canonical(rows: DataFrame, column: str, reference: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """rows with slot_id, the entry of reference (slot_id, slot_name, known_aliases) that the name in column means, or -1."""
    return mapping.mapped(rows, column, reference, "slot_id", max_broadcast)


def slot_names(options: DataFrame, templates: DataFrame) -> DataFrame:
    """(record_kind, record_seq, slot_pos, name): every non-blank slot name; position 0 in options, from 1 in templates."""
    a = options.select(F.lit("option").alias("record_kind"), F.col("option_seq").alias("record_seq"), F.lit(0).alias("slot_pos"), F.col("slot").alias("name"))
    b = templates.select(F.lit("template").alias("record_kind"), F.col("template_seq").alias("record_seq"), F.posexplode("slots").alias("p", "name"))
    return a.unionByName(b.select("record_kind", "record_seq", (F.col("p") + 1).alias("slot_pos"), "name")).where(F.length(F.regexp_replace("name", r"\s+", "")) > 0)


def mapped_slots(options: DataFrame, templates: DataFrame, catalog: DataFrame) -> DataFrame:
    """(record_kind, record_seq, slot_pos, slot_id) of each slot name that is not letter for letter in the catalog."""
    names = slot_names(options, templates)
    known = catalog.select(F.col("slot_name").alias("name")).distinct()
    if catalog.count() <= MAX_BROADCAST:
        known = F.broadcast(known)
    return canonical(names.join(known, "name", "left_anti"), "name", catalog).select("record_kind", "record_seq", "slot_pos", "slot_id")

