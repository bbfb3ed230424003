"""Reports on generated prompts: density, length, balance, co-occurrence, coverage, sparsity, effective rank."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.functions import text as X


def deliveries(prompts: DataFrame) -> DataFrame:
    """One row a prompt id: its earliest delivery, of equally early ones the least by a hash of the row."""
    rest = [c for c in prompts.columns if c != "id"]
    return prompts.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("loaded_at", F.xxhash64(*rest))).alias("r")).select("id", "r.*")


def labels_of(prompts: DataFrame) -> DataFrame:
    """(id, label): distinct non-blank labels of a prompt, trimmed and lower-cased."""
    one = F.transform("active_labels", lambda x: F.lower(F.regexp_replace(x, r"^\s+|\s+$", "")))
    return deliveries(prompts.select("id", "active_labels", "loaded_at")).select("id", F.explode(F.array_distinct(F.filter(one, lambda x: x.isNotNull() & (x != "")))).alias("label"))


def describe(values: DataFrame, column: str, name: str) -> DataFrame:
    """One row: measure, n, mean, std (population), min, max, median; nulls don't count."""
    c = F.col(column)
    return values.where(c.isNotNull()).agg(
        F.count("*").alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_pop(c), 6).alias("std"), F.min(c).cast("long").alias("min"),
        F.max(c).cast("long").alias("max"), F.median(c).alias("median"),
    ).select(F.lit(name).alias("measure"), "*")


def density_stats(prompts: DataFrame) -> DataFrame:
    """Of the number of instructions a prompt has: density, or where that is null the number of its labels."""
    p = deliveries(prompts).withColumn("d", F.coalesce("density", F.size(F.coalesce("active_labels", F.array().cast("array<string>")))))
    return describe(p, "d", "density")


def density_histogram(prompts: DataFrame) -> DataFrame:
    p = deliveries(prompts).withColumn("density", F.coalesce("density", F.size(F.coalesce("active_labels", F.array().cast("array<string>")))))
    return p.groupBy("density").agg(F.count("*").alias("n"))


def length_stats(prompts: DataFrame) -> DataFrame:
    """Of prompt lengths: token_length, or where that is null the number of words."""
    return describe(deliveries(prompts).withColumn("l", F.coalesce("token_length", X.word_count(F.col("prompt")))), "l", "length")


def label_counts(prompts: DataFrame, leaves: DataFrame) -> DataFrame:
    """(label, level, n) of all labels in use or in the taxonomy; level 'unknown' where the taxonomy lacks it."""
    used = labels_of(prompts).groupBy("label").agg(F.count("*").alias("n"))
    known = leaves.select(F.lower(F.trim("label")).alias("label"), "level").distinct()
    return used.join(known, "label", "full_outer").select("label", F.coalesce("level", F.lit("unknown")).alias("level"), F.coalesce("n", F.lit(0)).alias("n"))


def balance(counts: DataFrame) -> DataFrame:
    """(level, labels, total, cv, entropy) of the sampled labels of a level: coefficient of variation (population), and
    entropy over that of an even spread; a single label has 0 and 1."""
    c = counts.where("n > 0")
    total = c.groupBy("level").agg(F.sum("n").alias("total"), F.count("*").alias("labels"), F.avg("n").alias("m"), F.stddev_pop("n").alias("s"))
    p = F.col("n") / F.col("total")
    h = c.join(total.select("level", "total"), "level").groupBy("level").agg(F.sum(-p * F.log2(p + 1e-12)).alias("h"))
    return total.join(h, "level").select(
        "level", "labels", "total", F.round(F.when(F.col("labels") == 1, 0.0).otherwise(F.col("s") / F.col("m")), 6).alias("cv"),
        F.round(F.when(F.col("labels") == 1, 1.0).otherwise(F.col("h") / F.log2("labels")), 6).alias("entropy"),
    )


def never_sampled(counts: DataFrame) -> DataFrame:
    return counts.where("n = 0").select("label", "level")


def cooccurrence(prompts: DataFrame) -> DataFrame:
    """(label_a, label_b, c, pmi) for label_a < label_b: prompts with both, and log2 of the joint share against chance."""
    sets = labels_of(prompts).groupBy("id").agg(F.array_sort(F.collect_list("label")).alias("ls"))
    # Pairs are built within a prompt, from its own few labels, so no join on the prompt is needed.
    pair = F.flatten(F.transform("ls", lambda a, i: F.transform(F.slice("ls", i + 2, F.size("ls")), lambda b: F.struct(a.alias("label_a"), b.alias("label_b")))))
    pairs = sets.where(F.size("ls") > 1).select(F.explode(pair).alias("p")).groupBy("p.label_a", "p.label_b").agg(F.count("*").alias("c"))
    single = sets.select(F.explode("ls").alias("label")).groupBy("label").agg(F.count("*").alias("k"))
    n = deliveries(prompts.select("id", "loaded_at")).agg(F.count("*").alias("n"))
    a, b = single.select(F.col("label").alias("label_a"), F.col("k").alias("ka")), single.select(F.col("label").alias("label_b"), F.col("k").alias("kb"))
    share = lambda c: F.col(c) / F.col("n")
    return pairs.join(a, "label_a").join(b, "label_b").crossJoin(F.broadcast(n)).select(
        "label_a", "label_b", "c", F.round(F.log2(share("c") / (share("ka") * share("kb") + 1e-12) + 1e-12), 6).alias("pmi")
    )


def top_pmi(pairs: DataFrame, least: int = 3, top: int = 30) -> DataFrame:
    return pairs.where(F.col("c") >= least).orderBy(F.col("pmi").desc(), "label_a", "label_b").limit(top)


def level_cooccurrence(prompts: DataFrame, leaves: DataFrame) -> DataFrame:
    """(level_a, level_b, n): label pairs of each record by level, both directions (a pair of one level adds two)."""
    known = leaves.select(F.lower(F.trim("label")).alias("label"), "level").groupBy("label").agg(F.min("level").alias("level"))
    per = labels_of(prompts).join(known, "label", "left").groupBy("id", F.coalesce("level", F.lit("unknown")).alias("level")).agg(F.count("*").alias("k"))
    levels = per.groupBy("id").agg(F.collect_list(F.struct("level", "k")).alias("ls"))
    pair = F.flatten(F.transform("ls", lambda a: F.transform("ls", lambda b: F.struct(
        a["level"].alias("level_a"), b["level"].alias("level_b"), F.when(a["level"] == b["level"], a["k"] * (a["k"] - 1)).otherwise(a["k"] * b["k"]).alias("k")))))
    return levels.select(F.explode(pair).alias("p")).groupBy("p.level_a", "p.level_b").agg(F.sum("p.k").alias("n")).where("n > 0")


def coverage(prompts: DataFrame, leaves: DataFrame) -> DataFrame:
    """One row: distinct combinations, distinct label sets, modal density d, the bound of task labels times C(constraint
    labels, d - 1), and label sets over that bound (1 if the bound is 0)."""
    p = deliveries(prompts)
    sets = labels_of(prompts).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("label")), "|").alias("s"))
    one = p.agg(F.count_distinct("combo_id").alias("combos"))
    two = sets.agg(F.count_distinct("s").alias("label_sets"))
    mode = density_histogram(prompts).agg(F.min_by("density", F.struct(-F.col("n"), "density")).alias("modal_density"))
    axes = leaves.agg(F.count_if(F.col("level") == "task_type").alias("t"), F.count_if(F.col("level") != "task_type").alias("c"))
    k = F.col("modal_density") - 1
    choose = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda acc, i: acc * (F.col("c") - k + i) / i)
    bound = F.col("t") * F.round(choose)
    return one.crossJoin(two).crossJoin(mode).crossJoin(axes).select(
        "combos", "label_sets", F.col("modal_density").cast("int").alias("modal_density"), bound.cast("double").alias("bound"),
        F.round(F.when(bound == 0, 1.0).otherwise(F.col("label_sets") / bound), 8).alias("ratio"),
    )


def sparsity(prompts: DataFrame, leaves: DataFrame) -> DataFrame:
    """(label, share, verdict): dead below 5 prompts, rare below 1 %, else fine; labels of the taxonomy without a prompt
    included."""
    n = deliveries(prompts.select("id", "loaded_at")).agg(F.count("*").alias("total"))
    share = F.col("n") / F.col("total")
    return label_counts(prompts, leaves).crossJoin(F.broadcast(n)).select(
        "label", F.round(share, 6).alias("share"), F.when(F.col("n") < 5, "dead").when(share < 0.01, "rare").otherwise("fine").alias("verdict")
    )


def sparsity_summary(prompts: DataFrame, leaves: DataFrame) -> DataFrame:
    """One row: mean number of labels of the taxonomy that a prompt has, their share of all labels, what that says of it
    (below 0.1 good, below 0.2 fair, else dense), and how many labels are dead or rare."""
    known = leaves.select(F.lower(F.trim("label")).alias("label")).distinct()
    active = labels_of(prompts).join(F.broadcast(known), "label", "left_semi").agg(F.count("*").alias("active"))
    n = deliveries(prompts.select("id", "loaded_at")).agg(F.count("*").alias("n"))
    marks = sparsity(prompts, leaves).join(F.broadcast(known), "label", "left_semi").agg(F.count_if(F.col("verdict") == "dead").alias("dead"), F.count_if(F.col("verdict") == "rare").alias("rare"))
    mean = F.col("active") / F.col("n")
    share = mean / F.col("l")
    return n.crossJoin(active).crossJoin(known.agg(F.count("*").alias("l"))).crossJoin(marks).select(
        F.round(mean, 4).alias("mean_active"), F.round(share, 4).alias("fraction_active"), F.when(share < 0.1, "good").when(share < 0.2, "fair").otherwise("dense").alias("verdict"), "dead", "rare"
    )


def gram(prompts: DataFrame, leaves: DataFrame) -> tuple[list[str], np.ndarray, int]:
    """Labels of the taxonomy, how many prompts have each pair of them, number of prompts. The counts are made in Spark;
    labels x labels numbers come to the driver, and the taxonomy bounds the labels."""
    names = [r[0] for r in leaves.select(F.lower(F.trim("label"))).distinct().collect()]
    names.sort()
    at = {x: i for i, x in enumerate(names)}
    known = leaves.select(F.lower(F.trim("label")).alias("label")).distinct()
    mine = labels_of(prompts).join(F.broadcast(known), "label", "left_semi")
    sets = mine.groupBy("id").agg(F.array_sort(F.collect_list("label")).alias("ls"))
    pair = F.flatten(F.transform("ls", lambda a, i: F.transform(F.slice("ls", i + 1, F.size("ls")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    m = np.zeros((len(names), len(names)))
    for r in sets.select(F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("c")).collect():
        m[at[r["a"]], at[r["b"]]] = m[at[r["b"]], at[r["a"]]] = r["c"]
    return names, m, deliveries(prompts.select("id", "loaded_at")).count()


def spectrum(prompts: DataFrame, leaves: DataFrame) -> DataFrame:
    """(measure, value): effective rank exp(-sum p ln p) of the label covariance, variance held by the first k parts, and
    of the correlations mean, largest and the share above 0.3 (absolute)."""
    names, m, n = gram(prompts, leaves)
    rows: list[tuple[str, float]] = []
    if n and names:
        mean = np.diag(m) / n
        cov = m / n - np.outer(mean, mean)
        e = np.clip(np.linalg.eigvalsh(cov)[::-1], 0, None)
        p = e / e.sum() if e.sum() > 0 else e
        q = p[p > 1e-12]
        rows.append(("effective_rank", float(np.exp(-(q * np.log(q)).sum())) if len(q) else 0.0))
        rows += [(f"variance_top_{k}", float(p[:k].sum())) for k in (5, 10, 20, 30, 50)]
        std = np.sqrt(np.clip(np.diag(cov), 0, None))
        std[std == 0] = 1e-12
        r = np.abs((cov / np.outer(std, std))[np.triu_indices(len(names), 1)])
        if len(r):
            rows += [("correlation_mean", float(r.mean())), ("correlation_max", float(r.max())), ("correlation_above_0.3", float((r > 0.3).mean()))]
    return prompts.sparkSession.createDataFrame([(a, round(b, 6)) for a, b in rows], "measure string, value double")
