"""The llm operators do the whole job: nothing is cut by length, rarity or table size."""

import pytest

from slotweave.llm import leakage, residue, subjects

PASSAGE = (
    "On day 14 Marla of Quell counted 39 herons by the old mill, and 17 of them stood in the shallow ford until Orvik rang the bell at 6. "
    "Nobody at Tarn asked why the ledger of week 52 named only Brisk and the seven boats that left before dawn with the salt."
)


def _leaks(spark, docs, items, **kw):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(d, spark.createDataFrame(items, "item_id long, passage string"), **kw).collect()}


def test_leaks_in_short_pieces(spark):
    w = PASSAGE.split()
    other = " but then came quite different words that nobody had set there before "
    docs = [
        " ".join(w[:16]) + other + " ".join(w[-6:]),  # 16 + 6 of 53 words
        " ".join(w[:15]) + other + " ".join([*w[-7:-4], "more", *w[-3:]]),  # the same with a changed word
        " ".join(w[-6:]) + other + " ".join(w[:16]),  # out of order
        " ".join(w[:19]) + other + "and the bell",
    ]
    assert _leaks(spark, docs, [(1, PASSAGE)]) == {(0, 1), (1, 1)}


def test_leaks_of_passages_that_many_items_share(spark):
    w = PASSAGE.split()
    docs = [" ".join(w[:24]), " ".join(x if i % 6 else "other" for i, x in enumerate(w)), "the ledger of week 52 named"]
    assert _leaks(spark, docs, [(i, PASSAGE) for i in range(6)] + [(6, "Quite another text about the price of wool in the north and of all that came of it later on.")]) == {(d, i) for d in (0, 1) for i in range(6)}


@pytest.mark.parametrize("questions", [1, 4, 5, 8])
def test_leaks_of_benchmarks_with_several_questions_a_passage(spark, questions):
    names = [f"Name{chr(97 + i)}{chr(122 - i)}ar" for i in range(20)]
    passages = [f"In the year {1900 + i} {n} of Port {n[::-1].title()} sold {i + 11} red boats to the guild of {n}mouth, and the {i + 40} rowers left before the ice came to the bay." for i, n in enumerate(names)]
    items = [(100 * i + q, p) for i, p in enumerate(passages) for q in range(questions)]
    docs = [f"Before. {p} After." for p in passages] + ["In the year of the guild they sold red boats, and the rowers left before the ice came to the bay."]
    want = {(i, 100 * i + q) for i in range(20) for q in range(questions)}
    assert _leaks(spark, docs, items) == want
    assert _leaks(spark, docs, items, max_items=7) == want
    assert _leaks(spark, docs, items, max_chars=500) == want


@pytest.mark.parametrize("sign", ["{name}", "${name}", "[date tbd]", "[name here]", "(address goes here)", "<x_here>", "[[ name ]]", "[your name]"])
def test_all_trusted_kinds_are_topped_up(spark, sign):
    bad = f"Write to {sign} today."
    assert residue.has_trusted(bad, False) and not residue.has_trusted("Write to [them] today (soon).", False)
    df = spark.createDataFrame([("prompt", i, bad if i % 2 else "Write to [them] today (soon).") for i in range(400)], "record_kind string, record_key long, text string")
    few, sure, weight = residue.fit_sample(df, 40)
    assert weight == 10 and {t for t, _ in sure} == {bad} and len(sure) == 40


def test_metadata_label_documents_weakly():
    names = ["law", "sport"]
    examples = [(f"The court heard plea {w}.", "law") for w in "abcdef"] + [(f"The team won match {w}.", "sport") for w in "abcdef"]
    known = [f"The court heard plea {i}. The court heard plea {i} again. Juzgado cerrado {i}." for i in range(30)] + [f"The team won match {i}. The team won match {i} again." for i in range(30)]
    foreign = [f"Juzgado y fianza numero {i}." for i in range(30)] + [f"Portero y liga numero {i}." for i in range(30)]
    labels = [("news/law",)] * 30 + [("news/sport",)] * 30
    m = subjects.learn(names, examples, known + foreign, labels + labels)
    grams = subjects.Grams(m.rows)
    assert [m.bearing(grams(s)) for s in ("Portero y liga numero 3.", "Juzgado y fianza numero 3.")] == [1, 0]
