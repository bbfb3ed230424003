"""Label detection: 47 labels by regular expressions, and what is counted over them.

Arrays that regular expressions make are taken apart by explode_outer and a filter behind it: for an inner explode the
optimizer puts a filter on the array's size below the exchange, which runs all patterns once more and in few tasks."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotweave.functions import values as V


def label_flag(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.coalesce(text.rlike("(?i)" + p), F.lit(False))
    return out


def spread(df: DataFrame) -> DataFrame:
    """Rows spread over all cores before work that is bound by regular expressions, where the input is too small to be read
    by as many tasks (files of one row group); larger texts stay where they are read."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return df.repartition(cores) if size < cores * split else df


def detect(df: DataFrame, text: str, labels=V.LABELS) -> DataFrame:
    """df with `labels`, the array of the labels whose pattern is found in the text; null text has none."""
    found = F.array(*[F.when(label_flag(F.col(text), ps), F.lit(name)) for name, _, ps in labels])
    return spread(df).withColumn("labels", F.array_compact(found))


def prevalence(detected: DataFrame, by: str, least: float = 0.03) -> DataFrame:
    """(by, label, hits, prevalence) of the labels found in at least `least` of all texts of a group, blank ones included;
    the share is rounded to 4 places before it is compared."""
    n = detected.groupBy(by).agg(F.count("*").alias("n"))
    hits = detected.select(by, F.explode_outer("labels").alias("label")).where("label is not null").groupBy(by, "label").agg(F.count("*").alias("hits"))
    return hits.join(n, by).withColumn("prevalence", F.round(F.col("hits") / F.col("n"), 4)).where(F.col("prevalence") >= least).drop("n")


def presence(detected: DataFrame, by: str, labels=V.LABELS) -> DataFrame:
    """One row a group, one 0/1 column a label."""
    return detected.groupBy(by).agg(*[F.max(F.array_contains("labels", name).cast("int")).alias(name) for name, _, _ in labels])


def constraint_hits(df: DataFrame, text: str) -> DataFrame:
    """(idx, level, label, snippet) per text and constraint pattern: the first match, at most 200 characters; where the
    pattern has no label of its own, it is named after what it captures."""
    hits = F.array(*[
        F.struct(
            F.lit(i).alias("idx"), F.lit(level).alias("level"),
            F.regexp_extract(text, "(?i)" + p, 0).alias("snippet"),
            (F.lit(label) if label else F.concat(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(text, "(?i)" + p, 1)), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("_format"))).alias("label"),
        )
        for i, (p, level, label) in enumerate(V.CONSTRAINTS)
    ])
    return spread(df).withColumn("hit", F.explode_outer(F.filter(hits, lambda h: h["snippet"] != ""))).where("hit is not null").select(
        *[c for c in df.columns if c != text], "hit.idx", "hit.level", "hit.label", F.substring("hit.snippet", 1, 200).alias("snippet")
    )


VERB_OF = {v: canon for canon, vs in V.VERBS.items() for v in vs}
VERB_PHRASE = r"\b(" + "|".join(re.escape(v) for v in sorted(VERB_OF, key=len, reverse=True)) + r")\s+((?:\S+\s*){1,5})"


def verb_phrases(df: DataFrame, text: str) -> DataFrame:
    """One row per imperative verb with up to five words after it: pos, verb, phrase, canon."""
    p = F.lit("(?i)" + VERB_PHRASE)
    pairs = F.arrays_zip(F.regexp_extract_all(text, p, F.lit(1)).alias("v"), F.regexp_extract_all(text, p, F.lit(2)).alias("p"))
    canon = F.create_map(*[F.lit(x) for kv in VERB_OF.items() for x in kv])
    return spread(df).select(*[c for c in df.columns if c != text], F.posexplode_outer(pairs).alias("pos", "x")).where("pos is not null").select(
        *[c for c in df.columns if c != text], "pos", F.lower("x.v").alias("verb"), F.lower(F.regexp_replace("x.p", r"^\s+|\s+$", "")).alias("phrase"),
        F.element_at(canon, F.lower("x.v")).alias("canon"),
    )


def object_noun(phrase: Column) -> Column:
    """The first word of letters, three or longer, that is no article, skipped adjective or stop word."""
    skip = F.array(*[F.lit(w) for w in sorted(V.ARTICLES | V.SKIPPED_ADJECTIVES | V.STOP_WORDS)])
    words = F.transform(F.split(phrase, r"\s+"), lambda w: F.regexp_replace(w, "[^a-z]", ""))
    return F.get(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(skip, w)), F.lit(0))


def resolved(phrases: DataFrame, labels=V.LABELS) -> DataFrame:
    """phrases with object and task: the task that the object names, else that of the verb, else the first label whose
    pattern is found in 'verb object'; null if none."""
    by_object = F.create_map(*[F.lit(x) for t, ws in V.TASK_OBJECTS.items() for w in ws.split() for x in (w, t)])
    by_verb = F.create_map(*[F.lit(x) for kv in V.VERB_TASKS.items() for x in kv])
    p = phrases.withColumn("object", object_noun(F.col("phrase")))
    snippet = F.concat_ws(" ", "verb", "object")
    found = F.coalesce(*[F.when(label_flag(snippet, ps), F.lit(name)) for name, _, ps in labels])
    return p.withColumn("task", F.coalesce(F.element_at(by_object, F.col("object")), F.element_at(by_verb, F.col("canon")))).withColumn("task", F.when(F.col("task").isNotNull(), F.col("task")).otherwise(found))


def mined_tasks(phrases: DataFrame, least: int = 15, labels=V.LABELS) -> DataFrame:
    """(task, n, known): tasks named `least` times or more; known if a label has that name, else a label to be made."""
    names = [name for name, _, _ in labels]
    return resolved(phrases, labels).where("task is not null").groupBy("task").agg(F.count("*").alias("n")).where(F.col("n") >= least).withColumn("known", F.col("task").isin(*names))


def object_clusters(phrases: DataFrame, least: int = 50, top: int = 20, labels=V.LABELS) -> DataFrame:
    """(object, n, verbs): of the `top` objects named most often in phrases without a task those named at least `least` times
    that are not generic and match no label: labels to be made."""
    free = resolved(phrases, labels).where("task is null and object is not null")
    often = free.groupBy("object").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("canon")), ",").alias("verbs")).orderBy(F.col("n").desc(), "object").limit(top)
    every = [p for _, _, ps in labels for p in ps]
    return often.where((F.col("n") >= least) & ~F.col("object").isin(*sorted(V.GENERIC_OBJECTS)) & ~label_flag(F.col("object"), every))


def top_categories(df: DataFrame, by: str, column: str, top: int = 20) -> DataFrame:
    """(by, categories): each group's `top` categories as 'name(count)', most frequent first."""
    n = df.where(F.trim(column) != "").groupBy(by, F.lower(F.trim(column)).alias("category")).agg(F.count("*").alias("n"))
    first = n.withColumn("r", F.row_number().over(W.partitionBy(by).orderBy(F.col("n").desc(), "category"))).where(F.col("r") <= top)
    said = F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat("category", F.lit("("), F.col("n").cast("string"), F.lit(")")).alias("s")))), lambda x: x["s"])
    return first.groupBy(by).agg(F.array_join(said, ", ").alias("categories"))


def categories(df: DataFrame, column: str) -> DataFrame:
    """(category, label, n): a category goes to every label whose key it holds; other categories seen at least five times
    become labels of their own. Blank categories don't count."""
    counted = df.where(F.trim(column) != "").groupBy(F.lower(F.trim(column)).alias("category")).agg(F.count("*").alias("n"))
    keys = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("label")) for k, v in V.CATEGORIES.items()])
    hit = F.array_distinct(F.transform(F.filter(keys, lambda x: F.contains(F.col("category"), x["key"])), lambda x: x["label"]))
    own = F.when(F.col("n") >= 5, F.array(F.regexp_replace(F.regexp_replace("category", "[^a-z0-9]+", "_"), "^_+|_+$", ""))).otherwise(F.array().cast("array<string>"))
    return counted.withColumn("label", F.explode(F.when(F.size(hit) > 0, hit).otherwise(own))).select("category", "label", "n")


def suggest(detected: DataFrame, key: str, text: str) -> DataFrame:
    """(key, label, score): 2 for a label whose pattern is found, 1 more for each verb phrase whose verb names a label."""
    a = detected.select(key, F.explode_outer("labels").alias("label"), F.lit(2).alias("s")).where("label is not null")
    b = verb_phrases(detected.select(key, text), text).select(key, F.col("canon").alias("label"), F.lit(1).alias("s"))
    return a.unionByName(b).groupBy(key, "label").agg(F.sum("s").alias("score"))
