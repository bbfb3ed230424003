import itertools
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import same
from pyspark.sql import functions as F

from slotweave.llm import canonical, cooccur, frequency, leakage, ledger, packing, queries, residue, sql, subjects

LONG = "word " * 60_000


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_same_as_sql(spark, sf, name):
    same(spark, sf, queries.queries()[name], sql.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(sql.oracle_sql())))
def test_runs(spark, sf, name):
    assert queries.queries()[name](spark, sf).count() > 0


# 1 canonical values


def _catalog(spark):
    return spark.createDataFrame([(1, "main_character", ["hero"], 0), (2, "city_stops", None, 0), (3, "number", ["n", "amount"], 0)], "slot_id int, slot_name string, known_aliases array<string>, name int")


@pytest.mark.parametrize("most", [canonical.MAX_BROADCAST, 2, 1])
def test_mapping_and_shards(spark, most):
    names = ["number", "Main Character", "citystop", "amuont", "moon phase", None, "", "  ", "???", "n", "x" * 5000, "Main Character"]
    df = spark.createDataFrame([(i, n, -5) for i, n in enumerate(names)], "k int, name string, slot_id int")
    got = {r["k"]: r["slot_id"] for r in canonical.canonical(df, "name", _catalog(spark), most).collect()}
    assert got == {0: 3, 1: 1, 2: 2, 3: 3, 4: -1, 5: -1, 6: -1, 7: -1, 8: -1, 9: 3, 10: -1, 11: 1}


def test_mapping_of_tables(spark):
    o = spark.createDataFrame([(1, "number", 1), (2, "numbers", 1), (3, None, 1), (4, " ", 1)], "option_seq long, slot string, name int")
    t = spark.createDataFrame([(9, ["city_stops", None, "", "hero", "hero"], 1), (8, None, 1)], "template_seq long, slots array<string>, name int")
    got = sorted(tuple(r) for r in canonical.mapped_slots(o, t, _catalog(spark)).collect())
    assert got == [("option", 2, 0, 3), ("template", 9, 4, 1), ("template", 9, 5, 1)]
    assert canonical.mapped_slots(o.limit(0), t.limit(0), _catalog(spark)).count() == 0
    assert {r["slot_id"] for r in canonical.mapped_slots(o, t, _catalog(spark).limit(0)).collect()} == {-1}


# 3 copies


def _records(spark, rows):
    return spark.createDataFrame([("r", i, t, "clash", 7) for i, t in enumerate(rows)], "record_kind string, seq long, text string, words string, copies long")


TEXTS = [
    "Name: Ann; Age: 5; Home: Ulm", "home = ulm, age = 5, name = ann", "Name: 5; Age: Ann; Home: Ulm", "NAME: ann\nAGE: 5\nHOME: Ulm!", "name ann age 5 home ulm",
    "Say it, again.", "say it again", "say again it", None, "", " ", "…", " … ", "!!", LONG, LONG.upper(), "café ​bar", "CAFÉ bar",
    '{"age": "5", "home": "Ulm", "name": "Ann"}',
]
GROUPS = [{0, 1, 3, 4, 18}, {2}, {5, 6}, {7}, {11, 12}, {13}, {14, 15}, {16, 17}]


def test_copies(spark):
    got = {(r["keep_seq"], r["copy_seq"]) for r in ledger.find_copies(_records(spark, TEXTS), 3).collect()}
    assert got == {(min(g), x) for g in GROUPS for x in g - {min(g)}}
    assert sorted(r["copies"] for r in ledger.collapsed(_records(spark, TEXTS), 3).collect()) == sorted(map(len, GROUPS))
    assert ledger.find_copies(_records(spark, [])).count() == 0


def test_ledger_in_batches_is_the_same(spark, tmp_path):
    all_ = _records(spark, TEXTS * 2)
    for part in (all_.where("seq % 3 = 1"), all_.where("seq % 3 = 0"), all_.where("seq % 3 = 2")):
        ledger.Ledger(spark, str(tmp_path / "ledger")).add(part)  # a new object each time, as after a restart
    shape = lambda rows: {(bytes(r["words"]), bytes(r["parts"]), r["copies"], r["first_seq"]) for r in rows.collect()}
    book = ledger.Ledger(spark, str(tmp_path / "ledger"))
    want = shape(ledger.batch_counts(ledger.canonical_records(all_)))
    assert book.version == 3 and shape(book.read()) == want
    held = dict(book.held)
    book.add(all_.where("seq = 0"))  # one key: only its bucket is written anew
    assert book.version == 4 and {b for b, v in book.held.items() if v == 4} == {b for b in book.held if held.get(b) != book.held[b]} and list(book.held.values()).count(4) == 1
    assert sum(r["copies"] for r in book.read().collect()) == sum(c for _, _, c, _ in want) + 1


def test_restarted_ledger_keeps_counts(spark, tmp_path):
    for i in (7, 3):
        ledger.Ledger(spark, str(tmp_path / "l")).add(_records(spark, TEXTS[:1]).withColumn("seq", F.lit(i).cast("long")))
    (r,) = ledger.Ledger(spark, str(tmp_path / "l")).read().collect()
    assert (r["copies"], r["first_seq"]) == (2, 3)


def test_groups_join_over_words_and_parts(spark):
    rows = ["name: ann lee, age: nine", "age: nine, name: ann lee", "name: ann, lee age: nine", "lee age: nine, name: ann", "name ann lee age nine"]
    assert {(r["keep_seq"], r["copy_seq"]) for r in ledger.find_copies(_records(spark, rows)).collect()} == {(0, 1), (0, 2), (0, 3), (0, 4)}


def test_roots_are_components(spark):
    rng = random.Random(5)
    edges = {(f"g{g}", rng.randrange(7), rng.randrange(7)) for g in range(30) for _ in range(rng.randrange(1, 12))}
    df = spark.createDataFrame([(g, bytes([w]) * 16, bytes([100 + p]) * 16, 1, 1) for g, w, p in edges], "record_kind string, words binary, parts binary, copies long, first_seq long")
    of = {x: {x} for g, w, p in edges for x in ((g, "w", w), (g, "p", p))}
    for g, w, p in edges:
        both = of[g, "w", w] | of[g, "p", p]
        for x in both:
            of[x] = both
    got = {(r["record_kind"], r["words"][0]): bytes(r["root"]) for r in ledger.roots(df).collect()}
    for g, a in got:
        for h, b in got:
            if g == h:
                assert (got[g, a] == got[h, b]) == ((h, "w", b) in of[g, "w", a])


# 4 pairs


def test_pairs_against_brute_force(spark):
    rows = [["b", "a", "c"], ["a", "b"], ["a"], [], None, ["c", "b", "a", "d"], ["a", "b"]] * 7
    df = spark.createDataFrame([(r, 1) for r in rows], "items array<string>, code int").where("items is not null").withColumn("items", F.array_sort("items"))
    got = {(r["label_a"], r["label_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in cooccur.pair_counts(df).collect()}
    sets = [set(r) for r in rows if r]
    single = Counter(x for s in sets for x in s)
    pairs = Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
    assert got == {p: (c, single[p[0]], single[p[1]], len(sets)) for p, c in pairs.items()}
    assert cooccur.pair_counts(df.limit(0)).count() == 0


def test_pair_runs_survive_small_runs(spark, monkeypatch):
    monkeypatch.setattr(cooccur, "RUN", 3)
    df = spark.createDataFrame([([str(x) for x in range(12)],)] * 5, "items array<string>")
    assert {r["n_ab"] for r in cooccur.pair_counts(df).collect()} == {5}


def test_labels_are_cleaned(spark):
    rows = [(1, [" A", "a", "B ", None, " "], 2), (1, ["z"], 3), (2, None, 1), (3, [], 1)]
    df = spark.createDataFrame(rows, "id long, active_labels array<string>, loaded_at int").withColumn("items", F.lit(1)).withColumn("labels", F.lit(1))
    assert {r["id"]: r["items"] for r in cooccur.clean_labels(df).collect()} == {1: ["a", "b"], 2: None, 3: []}


# 5 terms


@given(st.lists(st.text("ab c", max_size=6), max_size=400))
@settings(max_examples=30, deadline=None)
def test_trie_counts(terms):
    trie = frequency.BurstTrie()
    for t in terms:
        trie.add(t, 2, 1)
    got = list(trie.items())
    assert got == sorted((t, 2 * n, n) for t, n in Counter(terms).items())


def test_terms(spark):
    rows = [["x", "x", "y"], ["x"], [], None, ["z" * 40_000], ["é"]]
    df = spark.createDataFrame([(r,) for r in rows], "terms array<string>")
    got = {r["term"]: (r["occurrences"], r["records"]) for r in frequency.count_terms(df).collect()}
    assert got == {"x": (3, 2), "y": (1, 1), "z" * 40_000: (1, 1), "é": (1, 1)}
    assert frequency.count_terms(df.limit(0)).count() == 0
    table = frequency.term_table({"f": df, "empty": df.limit(0)}, rare=2, common=0.3).collect()
    assert {(r["field_name"], r["term"][:3], r["mark"], r["total"]) for r in table} == {("f", "x", "common", 6), ("f", "y", "rare", 6), ("f", "zzz", "rare", 6), ("f", "é", "rare", 6)}


# 6 residue

GOOD = ["Write a short note on the harvest for {n} readers.".replace("{n}", str(i)) for i in range(40)] + ["Fix this line: print(f\"{total} of {limit}\")."] * 4 + ["Explain what a captcha is for."] * 3
BAD = ["Page not found. The address no longer exists.", "Please enable JavaScript to view this page.", "Lorem ipsum dolor sit amet.", "Write a short note on [TODO: subject] for readers.", "Write a note for {{ name }} today."]


def test_residue(spark):
    rows = [("prompt", i, t, 1) for i, t in enumerate(GOOD * 5 + BAD * 2)] + [("prompt", 9_000, None, 1), ("prompt", 9_001, "  ", 1), ("template", 1, "Write a note for {name} today.", 1), ("prompt", 9_002, LONG, 1)]
    df = spark.createDataFrame(rows, "record_kind string, record_key long, text string, known int")
    got = {(r["record_kind"], r["record_key"]) for r in residue.mark_residue(df).collect()}
    n = len(GOOD) * 5
    assert got == {("prompt", n + i) for i in range(10)}
    assert residue.mark_residue(df.limit(0)).count() == 0


def test_slots_are_content_of_templates_only():
    assert not list(residue.signs("Say { name } twice", True)) and len(list(residue.signs("Say {name} twice", False))) == 1


# 7 packing


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=25))
@settings(max_examples=80, deadline=None)
def test_plan_places_all(counts):
    planned = packing.plan(counts, 60)
    placed = Counter()
    for shape, times in planned:
        assert sum(shape) <= 60
        for n in shape:
            placed[n] += times
    assert placed == Counter(counts)
    rooms = []  # first-fit decreasing, piece by piece
    for n in sorted(Counter(counts).elements(), reverse=True):
        at = next((i for i, r in enumerate(rooms) if r >= n), None)
        if at is None:
            rooms.append(60)
            at = -1
        rooms[at] -= n
    assert sum(t for _, t in planned) <= len(rooms) * 1.05 + 1


def test_packing(spark):
    texts = [None, "", "  ", "one", "one", LONG, "a b c d e f g h i j"] + ["x y"] * 30
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, n int, shard int")
    rows = packing.pack(df, capacity=64, ranked=3).collect()
    lengths = {r["doc_id"]: r["n_tokens"] for r in packing.token_lengths(df).collect()}
    total, by = Counter(), {}
    for r in rows:
        total[r["doc_id"]] += r["n_tokens"]
        by.setdefault(r["container"], []).append((r["container_offset"], r["n_tokens"]))
    assert dict(total) == lengths and set(lengths) == set(range(3, len(texts)))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 64
    assert sorted(by) == list(range(len(by)))
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["hello\n" * 500, "a" * 3000 + " b", "word  and\t more, x1 " * 200, "\n\n  " * 400 + "end", "x" * 2500])
def test_stretches_change_no_count(monkeypatch, text):
    encode = packing._encoder(packing.TOKENIZER).encode_ordinary
    whole = len(encode(text))
    monkeypatch.setattr(packing, "CHUNK", 100)
    parts = list(packing._stretches(text))
    assert "".join(parts) == text and sum(len(encode(x)) for x in parts) == whole


def test_tokens_are_the_public_ones():
    from tokenizers import Tokenizer

    ours = packing._encoder(packing.TOKENIZER).encode_ordinary
    theirs = Tokenizer.from_file(packing.TOKENIZER.replace(".tiktoken", ".json"))
    for t in ("Hello, world's  end\n\n x", "  über 12,5 % — ok?", "a" * 300, "tab\tand space "):
        assert ours(t) == theirs.encode(t, add_special_tokens=False).ids


# 8 leakage

PASSAGE = "On day 14 Marla of Quell counted 39 herons by the old mill, and 17 of them stood in the shallow ford until Orvik rang the bell at 6."


def test_leaks(spark):
    w = PASSAGE.split()
    docs = {
        1: f"Before. {PASSAGE} After.", 2: PASSAGE.upper().replace(" ", "  ").replace("E", "Е"), 3: " ".join(w[:14]), 4: " ".join(w[:8]) + " something else came between these many other words " + " ".join(w[-10:]),
        5: "On day 3 Tunde of Brask counted 8 swans by the new weir, and 2 of them stood in the deep pool until Ilse rang the gong at 9.", 6: " ".join(w[:5]), 7: None, 8: " ", 9: LONG + PASSAGE,
        10: " ".join(x for i, x in enumerate(w) if i % 11),
    }
    d = spark.createDataFrame([(k, v, 1) for k, v in docs.items()], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(100, PASSAGE, "x"), (101, None, "x"), (102, " ", "x")], "item_id long, passage string, text string")
    for slices in (200_000, 1):
        assert {r["doc_id"] for r in leakage.find_leaks(d, i, max_items=slices).collect()} == {1, 2, 3, 4, 9, 10}
    assert leakage.find_leaks(d.limit(0), i).count() == 0 and leakage.find_leaks(d, i.limit(0)).count() == 0


@given(st.lists(st.integers(0, 40), min_size=leakage.K + leakage.WINDOW - 1, max_size=40), st.lists(st.integers(41, 90), max_size=20), st.lists(st.integers(41, 90), max_size=20))
@settings(max_examples=60, deadline=None)
def test_shared_spans_share_fingerprints(span, a, b):
    import numpy as np

    def prints(x):
        g = leakage.grams(np.array(x, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return {int(h) for h in g[leakage.winnow(g)]}

    assert prints(a + span + b) & prints(b + span + a)


# 9 subjects


def test_subjects(spark, sf):
    d = queries.read(spark, sf, "subject_examples")
    rows = [(r["text"], r["subject"]) for r in d.orderBy("example_id").collect()]
    names = sorted({k for _, k in rows})
    train, held = [r for i, r in enumerate(rows) if i % 7], [r for i, r in enumerate(rows) if not i % 7]
    docs = queries.read(spark, sf, "documents").select("doc_id", "text")
    extra = spark.createDataFrame([(1_000_000 + i, t) for i, (t, _) in enumerate(held)] + [(2_000_000, None), (2_000_001, " "), (2_000_002, LONG)], "doc_id long, text string")
    got = {}
    for r in subjects.mark_subjects(docs.unionByName(extra), train, names).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    right = sum(k in got.get(1_000_000 + i, ()) for i, (_, k) in enumerate(held))
    assert right >= 0.8 * len(held)
    assert not got.keys() & {2_000_000, 2_000_001, 2_000_002}
    assert subjects.mark_subjects(docs.limit(0), train, names).count() == 0
    assert subjects.mark_subjects(docs.limit(3), [], []).count() == 0


def test_nothing_outside_imports_this_part():
    import pathlib

    import slotweave

    root = pathlib.Path(slotweave.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"slotweave\.llm|from \.+llm", f.read_text()), f
