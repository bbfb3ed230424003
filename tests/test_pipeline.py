"""The steps around the store on small fixtures with each kind of case; queries against their SQL where they have one."""

import json

import pytest
from oracle import same
from pyspark.sql import functions as F

from slotweave.functions import backends
from slotweave.operators import compat, fixes, generate, normalize, replies, segment, store, taxonomy, vectors
from slotweave.plans import pipeline, pipeline_sql, queries, sql
from slotweave.streaming import growing

TEMPLATE = "template_seq long, id string, text string, slots array<string>, task_type string, level string, compatible_with array<string>, source string, token_length int"
OPTION = "option_seq long, id string, slot string, value string, compatible_task_types array<string>, compatible_templates array<string>, token_length int, source string, source_option_id string, option_type string"


@pytest.fixture(scope="module")
def store_dir(spark, tmp_path_factory):
    """A store in which texts come out alike within and across types, templates repeat within and across levels, and
    slots have no, few and many options."""
    d = str(tmp_path_factory.mktemp("store"))
    t = [
        (1, "a", "Write about {animal} in {n} words.", ["animal", "n"], "x", "task_type"), (2, "b", "Write about {pet} in {n} words.", ["pet", "n"], "x", "task_type"),
        (3, "c", "Write about {animal} in {n} words.", ["animal", "n"], "y", "task_type"), (4, "d", "Write about {pet} in {n} words.", ["pet", "n"], "z", "task_type"),
        (5, "e", "First repeat the request, then answer.", [], "r", "process_directive"), (6, "f", "First repeat the request, then answer.", [], "r2", "format_constraint"),
        (7, "g", "Use {number1}, {number2} and {x}.", ["number1", "number2", "x"], "q", "format_constraint"), (8, "h", "Use {number1}, {number2} and {x}.", ["number1", "number2", "x"], "p", "format_constraint"),
        (9, "i", None, None, None, None), (10, "j", " ", [None, ""], "x", "task_type"), (11, "369c0ad2aa", "No {constraint} here.", ["constraint"], "c", "format_constraint"),
        (12, "949ef12351", "No capitals. {constraints}", ["constraints"], "c", "content_style_constraint"), (13, "a", "Write about {animal} in {n} words.", ["animal", "n"], "x", "task_type"),
    ]
    spark.createDataFrame([(*r, ["l" + r[1]], "ablation_degenerate" if r[1] == "g" else "s", 3) for r in t], TEMPLATE).write.parquet(f"{d}/task_templates.parquet")
    o = [
        (1, "o1", "animal", "cats", ["x"], ["c"]), (2, "o2", "pet", "cats", ["x", "z"], []), (3, "o3", "animal", "dogs", ["_universal"], None), (4, "o4", "animal", "eels", None, ["a", "h"]),
        (5, "o5", "number", "number", [], ["b", "h", "h"]), (6, "o6", "x", "markdown", ["q"], ["h", "g"]), (7, "o7", "text_type", "markdown", ["q"], ["h", "g"]), (8, "o8", None, "v", [], []), (9, "o9", "x", " ", [], []),
        (11, "o1", "animal", "cats", ["x"], ["c"]), (10, "oa", "x", "Write about wool in dogs words.", ["q"], ["b"]),
    ]
    spark.createDataFrame([(*r, 2, None, None, ("t1", "t2")[r[0] % 2]) for r in o], OPTION).write.parquet(f"{d}/task_options.parquet")
    return d


@pytest.mark.parametrize("name", "same_type_collisions cross_type_collisions semantic_collisions slot_coverage substitution_rates template_replacements templates_deduplicated option_references id_fixes self_replicating validation_report generate_parallel generate_window compat_index slot_contexts numbered_slots compatible_options undercovered_templates first_fill relink".split())
def test_fixture_same_as_sql(spark, store_dir, name):
    same(spark, store_dir, queries.queries()[name], sql.oracle_sql()[name])


def test_fixture_holds_the_cases(spark, store_dir):
    q = lambda n: {tuple(r) for r in queries.queries()[n](spark, store_dir).collect()}
    assert q("same_type_collisions") == {("a", "b")}
    assert {(r[0], r[1]) for r in q("semantic_collisions")} == {("a", "a"), ("a", "c"), ("a", "d")}
    assert q("template_replacements") == {("c", "a"), ("d", "b"), ("f", "e"), ("h", "g")}
    assert {r[0]: r[1] for r in q("self_replicating")}
    assert ("degenerate_templates", 1) in q("validation_report")


def test_references_follow_replacements(spark, store_dir):
    o, t = spark.read.parquet(f"{store_dir}/task_options.parquet"), spark.read.parquet(f"{store_dir}/task_templates.parquet")
    got = {r["id"]: (r["slot"], r["compatible_templates"]) for r in fixes.referenced(o, fixes.replaced(t)).collect()}
    assert got["o5"] == ("number", ["b", "g"]) and got["o6"] == ("x", ["g"]) and got["o7"] == ("format", ["g"])


def test_numbered_slots_become_one(spark):
    t = spark.createDataFrame([(1, 1, "Use {w1}, {w2} and {x}. {w3}", ["w1", "w2", "x", "w3"]), (1, 2, "No slot", None), (2, 3, "{w1}", ["w1"])], "unit long, template_seq long, text string, slots array<string>")
    o = spark.createDataFrame([(1, 1, "w1", "a", 5), (1, 2, "w2", "b", 6), (1, 3, "x", "c", 7), (2, 4, "w1", "d", 8)], "unit long, option_seq long, slot string, value string, extra int")
    a, b = fixes.numbered_merged(t, o)
    assert {r["template_seq"]: (r["text"], r["slots"]) for r in a.collect()} == {1: ("Use {w_list} and {x}. ", ["w_list", "x"]), 2: ("No slot", None), 3: ("{w1}", ["w1"])}
    assert {(r["unit"], r["slot"], r["value"], r["extra"]) for r in b.collect()} == {(1, "w_list", "a, b", 5), (1, "x", "c", 7), (2, "w1", "d", 8)}
    assert {(r["slot"], r["value"]) for r in fixes.numbered_merged(t, o, False)[1].collect()} == {("w_list", "a"), ("w_list", "b"), ("x", "c"), ("w1", "d")}


def test_generation_keeps_its_rules(spark, store_dir):
    o, t = spark.read.parquet(f"{store_dir}/task_options.parquet"), spark.read.parquet(f"{store_dir}/task_templates.parquet")
    rows = generate.generate(t, o, 200, density=4).collect()
    assert len(rows) == 200 and all(len(set(r["constraints"])) == len(r["constraints"]) <= 3 for r in rows)
    levels = {r["id"]: r["level"] for r in t.collect()}
    assert all(sum(levels[i] == "format_constraint" for i in r["constraint_template_ids"]) <= 2 for r in rows)
    fits = {"x": {"o1", "o2", "o3", "o4"}, "y": {"o1", "o3"}, "z": {"o2"}}
    assert all(set(r["option_ids"][:1]) <= fits[r["task"]] | {"o6", "oa", "o5"} for r in rows)
    assert any("{" not in r["prompt"] for r in rows) and all("{n}" not in r["prompt"] for r in rows)
    assert generate.generate(t, o.limit(0), 5).count() == 5 and generate.generate(t.limit(0), o, 5).count() == 0
    assert all(5 <= r["token_length"] <= 9 for r in generate.generate(t, o, 50, 3, min_tokens=5, max_tokens=9).collect())


def test_replies_in_all_states(spark):
    leaves = spark.createDataFrame([("law", "task_type"), ("short", "format_constraint")], "label string, level string")
    good = json.dumps({"templates": [{"text": "Say {n} {formal}", "slots": ["n", "formal"], "task_type": "law", "level": "odd"}, {"text": "x", "slots": [], "task_type": "none", "level": "task_type"}], "options": [{"value": "Formal", "slot": "formal", "compatible_task_types": ["no"]}, {"value": "number", "slot": "n"}, {"value": "a, b", "slot": "keyword"}, {"value": "{x}", "slot": "z"}, {"value": None, "slot": "z"}]})
    df = spark.createDataFrame([(1, good), (2, None), (3, "no"), (4, "```json\n" + good[:-1] + "\n```"), (5, "{}")], "unit long, reply string")
    t, o = replies.extracted(df, leaves)
    assert {(r["unit"], r["text"], tuple(r["slots"]), r["level"], r["token_length"]) for r in t.collect()} == {(u, "Say {number} {writing_tone}", ("number", "writing_tone"), "task_type", 1) for u in (1, 4)}
    got = {(r["unit"], r["slot"], r["value"]): (r["compatible_task_types"], len(r["compatible_templates"])) for r in o.collect()}
    assert got == {(u, s, v): x for u in (1, 4) for s, v, x in (("writing_tone", "Formal", (["content_style_constraint"], 1)), ("keyword", "a", (["law"], 0)), ("keyword", "b", (["law"], 0)))}
    made = replies.extraction(spark.createDataFrame([(1, "p")], "unit long, prompt string"), leaves, lambda: backends.RuleGenerator(lambda p, good=good: good), ["law"])
    assert made[0].count() == 1
    assert replies.extracted(df.limit(0), leaves)[0].count() == 0


def test_variations_and_append(spark):
    o = spark.createDataFrame([(1, "o1", "s", "Old", ["t"], None)], "option_seq long, id string, slot string, value string, compatible_task_types array<string>, compatible_templates array<string>")
    r = spark.createDataFrame([(1, '{"variations": [{"value": "old "}, {"value": "new", "variation_type": "shortened"}, {"value": "NEW"}, {"value": ""}]}'), (1, "none"), (2, None)], "option_seq long, reply string")
    (x,) = replies.variations(r, o).collect()
    assert (x["value"], x["tags"], x["source_option_id"], x["compatible_task_types"]) == ("new", ["shortened"], "o1", ["t"])
    once = replies.appended(o, replies.variations(r, o))
    assert once.count() == 2 and replies.appended(once.select("option_seq", "id", "slot", "value"), replies.variations(r, o)).count() == 2


def test_types_from_replies(spark):
    rows = [("a", '{"categories": [{"name": "K", "types": [{"name": "City ", "description": "d", "compatible_slots": ["town"], "example_values": ["[x] Ulm", "Ulm"]}, {"name": "", "description": "d"}]}]}'), ("b", '{"types": [{"name": "city", "description": "e", "compatible_slots": [" place ", ""], "example_values": ["Bonn"]}]}'), ("c", "nothing"), ("d", None)]
    (r,) = taxonomy.merged_types(taxonomy.parsed_types(spark.createDataFrame(rows, "key string, reply string"))).collect()
    assert (r["name"], r["category"], r["description"], r["compatible_slots"], r["example_values"]) == ("city", "k", "d", ["city", "town", "place"], ["Ulm", "Bonn"])


def test_flattened_taxonomy(spark):
    file = {"_meta": {"x": {}}, "task": {"info": {"qa": {"level": "l", "more": {}}, "deep": {"leaf": {"level": "l"}}}}, "format": {"length": {"level": "l"}}, "alone": {"level": "l"}}
    df = spark.createDataFrame([(json.dumps(file),)], "value string")
    assert {r["label"] for r in taxonomy.flattened(df).collect()} >= {"length", "alone"}


def test_links_and_topk_with_names(spark):
    df = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [0.6, 0.8]), ("r", [0.0, 1.0]), ("s", None)], "k string, embedding array<double>")
    assert {(r["a"], r["b"]) for r in vectors.links(df, "k", 0.6, block=2).collect()} == {("p", "q"), ("q", "r")}
    got = vectors.top_k(df.select(F.col("k").alias("query_id"), "embedding"), df.select(F.col("k").alias("vec_id"), "embedding"), k=1, least=0.5).collect()
    assert {(r["query_id"], r["vec_id"]) for r in got} == {("p", "q"), ("q", "r"), ("r", "q")}


def test_sources_of_segments(spark):
    s = spark.createDataFrame([(1, "p"), (2, "q"), (3, None)], "k int, source_prompt string")
    p = spark.createDataFrame([("p", "a", 1), ("p", "b", 2)], "source_prompt string, source string, at int")
    assert {r["k"]: r["source"] for r in segment.with_source(s, p, "at").collect()} == {1: "b", 2: None, 3: None}


def test_type_table_goes_on_after_a_restart(spark, tmp_path):
    schema = "option_seq long, slot string, value string, token_length int"
    for i, row in enumerate([(1, "a", "x", 1), (2, "b", "y", 1)]):
        growing.TypeTable(spark, str(tmp_path / "t")).apply(spark.createDataFrame([row], schema), i)
    growing.TypeTable(spark, str(tmp_path / "t")).apply(spark.createDataFrame([(3, "c", "z", 1)], schema), 1)  # applied already
    assert {r["name"] for r in growing.TypeTable(spark, str(tmp_path / "t")).read().collect()} == {"a", "b"}


def test_tiers_need_no_rows(spark, store_dir):
    o, t = spark.read.parquet(f"{store_dir}/task_options.parquet"), spark.read.parquet(f"{store_dir}/task_templates.parquet")
    none = compat.index(t, o, least=0.99)
    got = {(r["id"], r["slot"]): (r["tier"], r["n1"], r["n2"], r["n3"]) for r in compat.tiers(t, o, spark.createDataFrame([("t1", "n")], "option_type string, slot string"), none).collect()}
    assert got["a", "n"][:2] == (2, 0) and got["a", "animal"] == (1, 3, None, None) and got["d", "pet"] == (3, 1, 0, 0)
    assert store.find(t, level="task_type", slot="pet").count() == 2
    assert normalize.numbered_groups(t).where("merged_slot = 'number_list' or merged_slot like 'number%'").count() == 2
    assert pipeline.queries().keys() >= pipeline_sql.oracle_sql().keys()


def test_slots_beyond_the_bound_are_clustered_too(spark):
    names = ["city name", "city names", "city named", "tone of voice", "tone of voices", "zinc ore", "zinc ores"]
    rows = [(10 * i + j, n, v) for i, n in enumerate(names) for j, v in enumerate(["red", "blue", "green"])]
    df = spark.createDataFrame(rows, "option_seq long, slot string, value string")
    whole = {r["slot"]: r["cluster"] for r in vectors.slot_clusters(df, most=0.5).collect()}
    few = {r["slot"]: r["cluster"] for r in vectors.slot_clusters(df, most=0.5, max_slots=2).collect()}
    same_of = lambda m: {(a, b) for a in m for b in m if m[a] == m[b]}
    assert set(few) == set(names) and min(few.values()) >= 0 and same_of(few) == same_of(whole)


@pytest.fixture(scope="module")
def many_contexts(spark):
    """Templates of 5,000 contexts: more than one block that the index once held on the driver."""
    n = 5_000
    t = spark.range(n).select(F.col("id").alias("template_seq"), F.concat(F.lit("t"), "id").alias("id"), F.concat(F.lit("word "), "id", F.lit(" tell {x}")).alias("text"), F.array(F.lit("x")).alias("slots"), F.lit("q").alias("task_type"), F.lit("task_type").alias("level"))
    o = [(i, f"o{i:02d}", "y", v, None, None) for i, v in enumerate(["word 7 tell", "tell word", "tell", "word tell 4999", "word 12 tell something", "word 12 tell something", "far away"])]
    return t, spark.createDataFrame(o, "option_seq long, id string, slot string, value string, compatible_task_types array<string>, compatible_templates array<string>")


def to_driver(spark, f):
    """What f gives and the most rows that one call brought to the driver meanwhile."""
    from pyspark.sql.classic.dataframe import DataFrame

    sizes, was = [0], DataFrame.collect

    def collect(self):
        rows = was(self)
        sizes.append(len(rows))
        return rows

    DataFrame.collect = collect
    try:
        out = f()
    finally:
        DataFrame.collect = was
    return out, max(sizes)


@pytest.mark.parametrize("least", [0.7, 0.35])
def test_index_keeps_contexts_off_the_driver(spark, many_contexts, least):
    t, o = many_contexts
    found, most = to_driver(spark, lambda: compat.index(t, o, least=least, most=2))
    assert most < 100
    got = {}
    for r in found.where("id in ('t7', 't12', 't4999', 't300')").collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["option_id"], r["score"])
    texts = {i: f"word {i} tell [SOMETHING]" for i in (7, 12, 4999, 300)}
    values = {r["id"]: r["value"] for r in o.collect()}
    x, y = backends.WordEmbedder().embed(list(texts.values())), backends.WordEmbedder().embed(list(values.values()))
    for i, a in zip(texts, x):
        want = sorted((-round(float(a @ b), 6), k) for k, b in zip(values, y) if round(float(a @ b), 6) >= least)[:2]
        assert got.get(f"t{i}", {}) == {j: (k, -s) for j, (s, k) in enumerate(want, 1)}


def test_near_index_leaves_the_driver_empty(spark, many_contexts, tmp_path, monkeypatch):
    """The registered query, written out: its rows are those of its SQL, and neither rows nor vectors pass the driver."""
    t, o = many_contexts
    t.write.parquet(f"{tmp_path}/task_templates.parquet")
    o.write.parquet(f"{tmp_path}/task_options.parquet")
    sent, was = [0], spark.sparkContext.broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(len(value)) or was(value))
    _, most = to_driver(spark, lambda: queries.queries()["compat_index_near"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out"))
    assert most < 100 and max(sent) < 100_000
    same(spark, str(tmp_path), lambda s, d: s.read.parquet(f"{d}/out"), sql.oracle_sql()["compat_index_near"])


def test_tiers_ask_the_index_for_few(spark, many_contexts):
    t, o = many_contexts
    o = o.unionByName(spark.createDataFrame([(100 + i, f"x{i}", "x", f"v{i}", ["_universal"], None) for i in range(3)], o.schema)).withColumn("option_type", F.lit(None).cast("string"))
    t = t.withColumn("slots", F.when(F.col("template_seq") == 7, F.array(F.lit("z"))).otherwise(F.col("slots")))
    asked = []
    kinds = spark.createDataFrame([], "option_type string, slot string")
    out, most = to_driver(spark, lambda: compat.tiers(t, o, kinds, lambda few: asked.append(few.collect()) or compat.index(t, o, least=0.35, only=few)))
    assert asked == [[("t7", "z")]] and most < 100
    assert {(r["id"], r["tier"]) for r in out.where("id in ('t7', 't8')").collect()} == {("t7", 3), ("t8", 1)}
    assert out.where("id = 't7'").collect()[0]["n3"] == compat.index(t, o, least=0.35).where("id = 't7'").count()


@pytest.mark.parametrize("least", [0.2, 0.5])
def test_nearest_of_any_vectors(spark, least):
    """Counts, long counts and dense numbers, among them equal scores and several ids of a text."""

    class Mixed:
        def embed(self, texts):
            import numpy as np

            out = []
            for x in texts:
                r = np.random.default_rng(int(x[1:]))
                v = r.normal(size=16) if int(x[1:]) % 5 == 0 else r.integers(-1, 2, 16) * (9 if int(x[1:]) % 7 == 0 else 1) + (r.integers(0, 40, 16) == 0) * 30.0
                out.append(v / (np.linalg.norm(v) or 1))
            return np.stack(out)

    texts = [f"v{i}" for i in range(4000)]
    q = spark.createDataFrame([(f"q{i}", [f"a{i}"]) for i in range(60)], "text string, about array<string>")
    v = spark.createDataFrame([(x, [f"{hash_(x)}-{j}" for j in range(1 + i % 3)]) for i, x in enumerate(texts) for hash_ in [lambda x: f"{int(x[1:]) * 7919 % 4001:05d}"]], "text string, ids array<string>")
    got = {}
    for r in vectors.nearest(q, v, Mixed, k=5, least=least).collect():
        got.setdefault(r["about"], []).append((r["rank"], r["vec_id"], r["score"]))
    a, b = Mixed().embed([f"q{i}" for i in range(60)]), Mixed().embed(texts)
    ids = {r["text"]: r["ids"] for r in v.collect()}
    for i in range(60):
        s = (b @ a[i]).round(6)
        want = sorted((-float(s[j]), k) for j, x in enumerate(texts) if s[j] >= least for k in ids[x])[:5]
        assert [(k, y) for _, k, y in sorted(got.get(f"a{i}", []))] == [(k, -y) for y, k in want]
