"""The registered queries of the library outside its llm part, each over whole tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.functions import text as X
from slotweave.functions import values as V
from slotweave.operators import analyze, detect, generate, normalize, packed, segment, store, vectors
from slotweave.session import read

_REGISTRY: dict = {}


def _query(f):
    _REGISTRY[f.__name__] = f
    return f


def queries() -> dict:
    from slotweave.plans import pipeline

    return _REGISTRY | pipeline.queries()


def _t(s, d):
    return read(s, d, "task_templates")


def _o(s, d):
    return read(s, d, "task_options")


def _g(s, d):
    return read(s, d, "generated_prompts")


def _joined(c: str):
    return F.array_join(F.col(c), "|").alias(c)


@_query
def p2_found(s: SparkSession, d: str) -> DataFrame:
    return packed.packed_options(_o(s, d), read(s, d, "slot_catalog"))


# sources


@_query
def load_user_prompts(s, d):
    p = analyze.deliveries(_g(s, d))
    return p.where(~X.blank("prompt")).select("id", F.length("prompt").cast("long").alias("n_chars"), X.word_count(F.col("prompt")).cast("long").alias("n_words"))


@_query
def cap_per_source(s, d):
    docs = read(s, d, "documents").where(~X.blank("text")).select("source", "doc_id")
    return normalize.capped(docs, "source", "doc_id", 20)


@_query
def instruction_text(s, d):
    p = analyze.deliveries(_g(s, d)).withColumn("t", X.instruction_text(F.col("task"), F.array_join(F.coalesce("constraints", F.array().cast("array<string>")), "\n")))
    return p.select("id", F.md5("t").alias("text_md5"))


@_query
def hashed_sample(s, d):
    """The 100 documents that come first by hash: a sample that is the same at each run."""
    return read(s, d, "documents").select("doc_id", F.md5(F.concat(F.lit("42|"), F.col("doc_id").cast("string"))).alias("h")).orderBy("h", "doc_id").limit(100).select("doc_id")


@_query
def level_remap(s, d):
    old = F.create_map(*[F.lit(x) for kv in V.OLD_LEVELS.items() for x in kv])
    return _t(s, d).groupBy(F.coalesce(F.element_at(old, F.col("level")), "level", F.lit("")).alias("level")).agg(F.count("*").alias("n"))


# labels and mining


@_query
def detect_labels(s, d):
    return detect.detect(_t(s, d).select("template_seq", "text"), "text").select("template_seq", F.explode_outer("labels").alias("label")).where("label is not null")


@_query
def label_prevalence(s, d):
    docs = read(s, d, "documents").select("source", "text")
    return detect.prevalence(detect.detect(docs, "text"), "source")


@_query
def presence_matrix(s, d):
    t = _t(s, d).select(F.coalesce("level", F.lit("")).alias("level"), "text")
    return detect.presence(detect.detect(t, "text"), "level")


@_query
def verb_phrases(s, d):
    return detect.verb_phrases(_t(s, d).select("template_seq", "text"), "text").select("template_seq", F.col("pos").cast("long").alias("pos"), "verb", "canon", F.md5("phrase").alias("phrase_md5"))


@_query
def constraint_hits(s, d):
    h = detect.constraint_hits(_t(s, d).select("template_seq", "text"), "text")
    return h.groupBy("idx", "level", "label").agg(F.count("*").alias("n"), F.min("snippet").alias("example")).where("n >= 3")


@_query
def category_map(s, d):
    return detect.categories(_t(s, d), "task_type")


@_query
def suggest_labels(s, d):
    found = detect.detect(_t(s, d).select("template_seq", "text"), "text")
    return detect.suggest(found, "template_seq", "text")


# normalising


@_query
def canonical_slots(s, d):
    return normalize.renamed_slots(_o(s, d))


@_query
def rename_in_templates(s, d):
    t, _ = normalize.with_canonical_slots(_t(s, d), _o(s, d))
    return t.select("template_seq", F.md5("text").alias("text_md5"), F.coalesce(F.array_join("slots", "|"), F.lit("")).alias("slots"))


@_query
def placeholder_sync(s, d):
    return normalize.synced_slots(_t(s, d).where(~X.blank("text"))).select("template_seq", _joined("slots"))


@_query
def expand_lists(s, d):
    o = _o(s, d).withColumn("slot", F.when(F.lower("slot") == "keyword_pool", "keyword").otherwise(F.col("slot")))
    return normalize.expanded_lists(o).where("slot = 'keyword'").select("option_seq", "value")


@_query
def drop_broken(s, d):
    return normalize.without_broken(_o(s, d)).agg(F.count("*").alias("kept"), F.count_if(X.blank("value")).alias("blank"))


@_query
def repeated_placeholders(s, d):
    t = _t(s, d)
    return t.select("template_seq").join(normalize.without_repeated_placeholders(t).select("template_seq"), "template_seq", "left_anti")


@_query
def dedup_templates(s, d):
    return normalize.merged_templates(_t(s, d)).select("template_seq", "id", "n", F.size("compatible_with").cast("long").alias("n_links"), F.md5(F.array_join("compatible_with", "|")).alias("links_md5"))


@_query
def dedup_options(s, d):
    o = normalize.merged_options(_o(s, d))
    return o.select("option_seq", "n", F.array_join("compatible_task_types", "|").alias("types"), F.array_join("compatible_templates", "|").alias("templates"))


@_query
def orphan_options(s, d):
    return normalize.orphans(_o(s, d), _t(s, d))


@_query
def relink(s, d):
    return normalize.relinked(_t(s, d), _o(s, d))


@_query
def numbered_slots(s, d):
    return normalize.numbered_groups(_t(s, d))


@_query
def content_ids(s, d):
    return normalize.content_ids(_t(s, d), _o(s, d))


@_query
def normalize_all(s, d):
    t, o = normalize.normalized(_t(s, d), _o(s, d))
    a = t.agg(F.count("*").alias("n"), F.sum("n").alias("copies")).select(F.lit("templates").alias("kind"), "n", "copies")
    return a.unionByName(o.agg(F.count("*").alias("n"), F.sum("n").alias("copies")).select(F.lit("options").alias("kind"), "n", "copies"))


@_query
def few_shot_fixes(s, d):
    t = segment.few_shot_fixed(_t(s, d))
    return t.select("template_seq", "level", F.array_join("slots", "|").alias("slots"), F.md5("text").alias("text_md5"))


@_query
def inferred_levels(s, d):
    return _o(s, d).where(~X.blank("slot")).groupBy(X.inferred_level(F.col("slot")).alias("level")).agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"))


# store, compatibility, validation


@_query
def store_summary(s, d):
    return store.summary(_t(s, d), _o(s, d))


@_query
def compatible_options(s, d):
    return store.compatible_counts(_t(s, d), _o(s, d))


@_query
def undercovered_templates(s, d):
    return store.undercovered(_t(s, d), _o(s, d))


@_query
def reusable_filter(s, d):
    return store.reusable(_t(s, d))


@_query
def slot_coverage(s, d):
    return store.slot_coverage(_t(s, d), _o(s, d))


@_query
def first_fill(s, d):
    return store.first_fill(_t(s, d), _o(s, d)).select("id", F.md5("filled").alias("filled_md5"))


def _filled(s, d):
    return store.first_fill(_t(s, d), _o(s, d))


@_query
def same_type_collisions(s, d):
    return store.same_type_collisions(_filled(s, d))


@_query
def cross_type_collisions(s, d):
    return store.cross_type_groups(_filled(s, d))


@_query
def semantic_collisions(s, d):
    return store.semantic_collisions(_filled(s, d))


@_query
def substitution_rates(s, d):
    every = [p for _, level, ps in V.LABELS if level == "task_type" for p in ps]
    return store.substitution_rates(_t(s, d), _o(s, d), lambda c: detect.label_flag(c, every))


# vectors


@_query
def cosine_topk(s, d):
    e = read(s, d, "embeddings").select("vec_id", "embedding")
    return vectors.top_k(e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), e, k=10, least=0.3)


@_query
def type_means(s, d):
    m = vectors.means(read(s, d, "embeddings").select("label", "embedding"), "label")
    return m.select("label", F.posexplode("embedding").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("x"))


@_query
def slot_clusters(s, d):
    return vectors.slot_clusters(_o(s, d))


# augmenting and generating


@_query
def augment_numeric(s, d):
    return generate.numeric_options(s)


@_query
def augment_pools(s, d):
    return generate.missing(generate.pool_options(s), _o(s, d))


@_query
def augment_combos(s, d):
    return generate.combo_options(s)


@_query
def seed_selection(s, d):
    """Up to 500 seeds from the slots of the catalog that hold one thing each."""
    content = read(s, d, "slot_catalog").where("not list_like").select(F.col("slot_name").alias("slot"))
    return generate.seeds(_o(s, d), content, 500)


@_query
def merge_augmented(s, d):
    """The store's options and the new pool values, by slot."""
    o = _o(s, d)
    new = generate.missing(generate.pool_options(s), o).select("slot")
    return o.select("slot").unionByName(new).where(~X.blank("slot")).groupBy("slot").agg(F.count("*").alias("n"))


@_query
def generate_parallel(s, d):
    return _generated(generate.generate(_t(s, d), _o(s, d), 2000))


@_query
def generate_window(s, d):
    """Four instructions a prompt, of 20 to 60 words, in up to three tries."""
    return _generated(generate.generate(_t(s, d), _o(s, d), 1000, density=4, min_tokens=20, max_tokens=60))


def _generated(p):
    flat = [_joined(c) for c in ("constraint_template_ids", "option_ids", "active_labels", "constraints")]
    return p.select("prompt_no", F.col("try").cast("long").alias("try"), F.md5("prompt").alias("prompt_md5"), "task_template_id", *flat, "task", F.col("density").cast("long").alias("density"), F.col("token_length").cast("long").alias("token_length"), "combo_id")


@_query
def generate_exact(s, d):
    return generate.generate_exact(_t(s, d), _o(s, d), 500)


@_query
def token_window(s, d):
    return generate.token_window(analyze.deliveries(_g(s, d)), 20, 200).select("id")


@_query
def feasible_density(s, d):
    return generate.feasible_density(_t(s, d), _o(s, d)).select("id", "feasible_log10", "full_log10")


# analysis


@_query
def density_stats(s, d):
    return analyze.density_stats(_g(s, d))


@_query
def density_histogram(s, d):
    return analyze.density_histogram(_g(s, d))


@_query
def length_stats(s, d):
    return analyze.length_stats(_g(s, d))


@_query
def label_frequency(s, d):
    return analyze.label_counts(_g(s, d), read(s, d, "taxonomy_leaves"))


@_query
def label_balance(s, d):
    return analyze.balance(analyze.label_counts(_g(s, d), read(s, d, "taxonomy_leaves")))


@_query
def never_sampled(s, d):
    return analyze.never_sampled(analyze.label_counts(_g(s, d), read(s, d, "taxonomy_leaves")))


@_query
def cooccurrence(s, d):
    return analyze.cooccurrence(_g(s, d))


@_query
def pmi(s, d):
    return analyze.top_pmi(analyze.cooccurrence(_g(s, d)))


@_query
def level_cooccurrence(s, d):
    return analyze.level_cooccurrence(_g(s, d), read(s, d, "taxonomy_leaves"))


@_query
def combo_coverage(s, d):
    return analyze.coverage(_g(s, d), read(s, d, "taxonomy_leaves"))


@_query
def dead_rare(s, d):
    return analyze.sparsity(_g(s, d), read(s, d, "taxonomy_leaves"))


@_query
def effective_rank(s, d):
    return analyze.spectrum(_g(s, d), read(s, d, "taxonomy_leaves"))


# segments


def _segments(s, d):
    """Each prompt's labels as segments, text by position: the shape a segmenter returns."""
    p = analyze.deliveries(_g(s, d))
    known = read(s, d, "taxonomy_leaves").select(F.lower("label").alias("label"), "level").dropDuplicates(["label"])
    x = p.select(F.col("id").alias("prompt_id"), F.posexplode("active_labels").alias("seg_idx", "raw")).where(~X.blank("raw")).withColumn("label", F.lower(F.trim("raw")))
    return x.join(known, "label", "left").select("prompt_id", F.col("seg_idx").cast("long").alias("seg_idx"), "label", F.coalesce("level", F.lit("unknown")).alias("level"), F.concat("label", F.lit("#"), F.col("seg_idx").cast("string")).alias("span_text"))


@_query
def merge_adjacent(s, d):
    # Levels in place of labels, so that neighbours do coincide.
    x = _segments(s, d).withColumn("label", F.col("level"))
    return segment.merged_adjacent(x).select("prompt_id", "seg_idx", "label", "span_text")


@_query
def absorb_context(s, d):
    x = _segments(s, d).withColumn("label", F.when(F.col("label") == "explain_concept", "explanation").when(F.col("label") == "pull_out_facts", "information_extraction").otherwise(F.col("label")))
    return segment.absorbed_context(x)
