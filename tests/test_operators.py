import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slotweave.functions import backends
from slotweave.functions import text as X
from slotweave.functions.bktree import BKTree, Block, damerau, levenshtein
from slotweave.functions.names import NameMatcher, words
from slotweave.operators import detect, generate, mapping, normalize, segment, vectors
from slotweave.sources import readers, writers
from slotweave.streaming import growing


@given(st.lists(st.text("abcd", max_size=9), min_size=1, max_size=30), st.lists(st.text("abcde", max_size=9), min_size=1, max_size=8), st.integers(0, 4))
@settings(max_examples=60, deadline=None)
def test_bktree_is_exact(words, asked, radius):
    tree = BKTree(words)
    got = {(asked[i], tree.words[k], d) for i, k, d in tree.search(Block(asked), radius)}
    assert got == {(a, w, levenshtein(a, w)) for a in asked for w in set(words) if levenshtein(a, w) <= radius}


@given(st.text("abc", max_size=6), st.text("abc", max_size=6), st.text("abc", max_size=6))
@settings(max_examples=100, deadline=None)
def test_damerau_is_a_metric(a, b, c):
    assert damerau(a, b) == damerau(b, a) <= levenshtein(a, b)
    assert damerau(a, c) <= damerau(a, b) + damerau(b, c)
    assert (damerau(a, b) == 0) == (a == b)


def test_long_patterns():
    w = "x" * 70 + "abc"
    assert BKTree([w, "short"]).search(Block([w + "d"]), 2) == [(0, 0, 1)]


def test_names():
    assert words("  {Main-Character_2 (optional)} ") == ["main", "character", "2"]
    m = NameMatcher([(1, "main_character", ["hero"]), (2, "city_stops", []), (3, "number", ["n"])])
    cases = {"MainCharacter": 1, "main_charactre": 1, "Hero": 1, "cty_stps": 2, "city stops_list": 2, "stops city": 2, "numbers": 3, "N": 3, "number_3": 3, "quite other": -1, "": -1, "???": -1, "moon_phase": -1}
    assert {k: v[0] for k, v in zip(cases, m.match(list(cases)))} == cases


LISTED = [(1, "target audience", ["readers"]), (2, "tariff audience", []), (3, "x" * 99 + "y", []), (4, "readers", []), (5, "city stops", ["readers"]), (6, "stop", []), (7, "target area", [])]


@pytest.mark.parametrize("most", [100, 3, 2, 1])
def test_shards_of_a_list_find_what_the_whole_list_finds(spark, most):
    names = {"tar aud": -1, "tar audience": -1, "x" * 99: 3, "readers": 4, "stops city": 5, "stops": 6, "targt area": 7, "trget audience": 1, "tar are": 7, "reeders": 4, " ": -1}
    ref = spark.createDataFrame([(*r, 1) for r in LISTED] + [(9, None, None, 1)], "slot_id int, slot_name string, known_aliases array<string>, name int")
    df = spark.createDataFrame([(n,) for n in names] * 2 + [(None,)], "name string")
    got = {r["name"]: r["slot_id"] for r in mapping.mapped(df, "name", ref, max_broadcast=most).collect()}
    assert got == names | {None: -1}


def test_text_functions(spark):
    df = spark.createDataFrame([("Say {a} to {b} and {a}.", ["a", "b"]), ("", []), (None, None)], "t string, s array<string>")
    pairs = F.transform("s", lambda x: F.struct(x.alias("slot"), F.upper(x).alias("value")))
    got = df.select(X.placeholders(F.col("t")).alias("p"), X.word_count(F.col("t")).alias("n"), X.fill_all(F.col("t"), pairs).alias("f"), X.replace_first(F.col("t"), F.lit("{a}"), F.lit("Z")).alias("r")).collect()
    assert got[0].p == ["a", "b", "a"] and got[0].n == 6 and got[0].f == "Say A to B and A." and got[0].r == "Say Z to {b} and {a}."
    assert got[1].n == got[2].n == 0 and got[2].f is None


def test_canonical_slot_is_single_pass(spark):
    df = spark.createDataFrame([(x,) for x in ("n1", "n", "animal_list", "option_1", "p", "12", "fine")], "s string")
    assert [r[0] for r in df.select(X.canonical_slot(F.col("s"))).collect()] == ["n", "number", "animal", "option", "passage", None, None]


def test_repair():
    ok = {"a": [1, {"b": "x"}]}
    for s in (json.dumps(ok), "<think>{no}</think>" + json.dumps(ok), "```json\n" + json.dumps(ok) + "\n```", "Sure! " + json.dumps(ok) + " Done {", "{'a': [1, {'b': 'x'}]}", '{a: [1, {b: "x"},],}', '{"a": [1, {"b": "x"'):
        assert json.loads(segment.repaired(s)) == ok, s
    assert segment.repaired("nothing") is None and segment.repaired(None) is None and segment.repaired("") is None


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_repair_never_raises(s):
    got = segment.repaired(s)
    assert got is None or json.loads(got) is not Ellipsis


def test_segments(spark):
    rows = [(1, 0, "explanation", "task_type", "a"), (1, 1, "planning", "task_type", "b"), (1, 2, "explanation", "task_type", "c"), (2, 0, "tone", "style", "x"), (2, 1, "planning", "task_type", "y"), (2, 2, "description", "task_type", "z")]
    df = spark.createDataFrame(rows, "prompt_id long, seg_idx long, label string, level string, span_text string")
    got = {(r["prompt_id"], r["seg_idx"]): (r["label"], r["span_text"]) for r in segment.absorbed_context(df).collect()}
    assert got == {(1, 1): ("planning", "a b c"), (2, 0): ("tone", "x"), (2, 1): ("planning", "y z")}
    assert segment.merged_adjacent(df.withColumn("label", F.col("level"))).where("prompt_id = 1").collect()[0]["span_text"] == "a b c"


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in r], "clash") for i, r in enumerate(v)] + [(99, None, "clash")], "vec_id long, embedding array<double>, score string")
    q = df.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in vectors.top_k(q, df, k=3, least=0.2, block=2).collect()}
    for a in range(0, 60, 10):
        s = [(round(float(v[a] @ v[b]), 6), b) for b in range(60) if b != a and v[a] @ v[b] >= 0.2]
        for i, (_, b) in enumerate(sorted(s, key=lambda t: (-t[0], t[1]))[:3]):
            assert got[(a, i + 1)] == b


def test_cluster():
    v = np.array([[1, 0], [0.99, 0.14], [0, 1], [0.1, 0.99]], float)
    assert vectors.cluster(list("abcd"), v / np.linalg.norm(v, axis=1, keepdims=True)) == [0, 0, 1, 1]


def test_detect_nulls(spark):
    df = spark.createDataFrame([("Translate this into French.",), (None,), ("",)], "t string")
    assert [r["labels"] for r in detect.detect(df, "t").orderBy(F.desc("t")).collect()][0] == ["translation"]
    assert detect.detect(df, "t").where("size(labels) = 0").count() == 2


def _store(spark):
    t = spark.createDataFrame([(1, "t1", "Say {a}.", ["a"], "x", "task_type", []), (2, "t2", "Use {b} words.", ["b"], "y", "format_constraint", [])], "template_seq long, id string, text string, slots array<string>, task_type string, level string, compatible_with array<string>")
    o = spark.createDataFrame([(1, "o1", "a", "hi", ["x"], []), (2, "o2", "a", "ho", ["z"], []), (3, "o3", "b", "5", [], [])], "option_seq long, id string, slot string, value string, compatible_task_types array<string>, compatible_templates array<string>")
    return t, o


def test_generate_is_repeatable(spark):
    t, o = _store(spark)
    a = sorted(map(tuple, generate.generate(t, o, 20, 2).select("prompt_no", "prompt", "density").collect()))
    assert len(a) == 20 and a == sorted(map(tuple, generate.generate(t.repartition(3), o.repartition(5), 20, 2).select("prompt_no", "prompt", "density").collect()))
    assert all("{" not in p and d <= 2 for _, p, d in a)
    b = generate.generate_exact(t, o, 30, 2).collect()
    assert len(b) == 30 and all(len(set(r["active_labels"])) == len(r["active_labels"]) for r in b)


def test_numbered_ranks_are_dense(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), "id")
    got = generate.numbered(df, ["g"], F.col("id").cast("string")).groupBy("g").agg(F.count_distinct("rank").alias("n"), F.max("rank").alias("m"), F.max("size").alias("s")).collect()
    assert all(r["n"] == r["m"] + 1 == r["s"] for r in got)


def test_merge_keeps_order(spark):
    o = spark.createDataFrame([(2, "a", "v", ["q", "p"], None), (1, "a", "v", ["p", "r"], ["t"]), (3, None, "v", [], []), (4, "a", " ", [], [])], "option_seq long, slot string, value string, compatible_task_types array<string>, compatible_templates array<string>")
    (r,) = normalize.merged_options(o).collect()
    assert (r["option_seq"], r["n"], r["compatible_task_types"], r["compatible_templates"]) == (1, 2, ["p", "r", "q"], ["t"])


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"msg": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "no"}]}\n{"msg": null}\n')
    (tmp_path / "b.json").write_text('{"meta": 1, "data": [{"q": "one"}, {"q": " "}, {"q": "two"}]}')
    reg = [readers.Source("a", "jsonl", (str(tmp_path / "a.jsonl"),), ("msg",)), readers.Source("b", "json", (str(tmp_path / "b.json"),), ("q", "none"), sample=1), readers.Source("c", "parquet", ("/no/such",), ("x",))]
    with pytest.warns(UserWarning):
        got = [(r["source"], r["prompt"]) for r in readers.load_prompts(spark, reg).collect()]
    assert ("a", "hi") in got and len(got) == 2
    t, o = _store(spark)
    writers.save_store(t, o, str(tmp_path / "s"))
    assert readers.load_store(spark, [], [])[0].count() == 0
    assert spark.read.parquet(str(tmp_path / "s/options")).count() == 3
    (tmp_path / "f.json").write_text('{"d": [{"prompt": "p", "annotation": null}, {"prompt": "q", "annotation": {"templates": [], "options": [{"value": "v", "slot": "s"}]}}]}')
    assert readers.load_few_shots(spark, str(tmp_path / "f.json")).count() == 2
    (tmp_path / "x.py").write_text("a = 'a string of some length'\n")
    assert readers.scrape_strings(spark, str(tmp_path / "x.py")).count() == 1


def test_streaming(spark, tmp_path):
    src = tmp_path / "in"
    schema = "option_seq long, slot string, value string, token_length int"
    table = growing.TypeTable(spark, str(tmp_path / "types"))
    for i, rows in enumerate([[(1, "A", "x", 1), (2, "a", "y", 1), (3, " ", "z", 1)], [(4, "a", "y", 1), (5, "a", "w", 1), (6, "b", "long", 99)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        growing.grow_types(spark.readStream.schema(schema).parquet(str(src)), table, str(tmp_path / "cp")).awaitTermination()
    got = {r["name"]: (r["n"], r["examples"]) for r in table.read().collect()}
    assert got == {"a": (4, ["x", "y", "w"]), "_uncategorized": (1, ["z"])}


def test_windowed_counts(spark, tmp_path):
    spark.createDataFrame([("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:50:00"), ("b", "2024-01-01 01:10:00")], "k string, t string").select("k", F.to_timestamp("t").alias("ts")).write.parquet(str(tmp_path / "e"))
    q = growing.windowed_counts(spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "e")), "ts", "k").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["k"], r["n"]) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1)}


def test_backends(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b")], "key long, prompt string")
    got = {r["key"]: r["reply"] for r in backends.generated(df, "prompt", lambda: backends.RuleGenerator(str.upper)).collect()}
    assert got == {1: "A B", 2: "", 3: "A B"}
    assert backends.embedded(df, "prompt", backends.HashEmbedder).where("embedding is not null").count() == 2
    assert [m["role"] for m in df.select(backends.messages("s", [("u", "a")], "prompt").alias("m")).first()["m"]] == ["system", "user", "assistant", "user"]

