import pytest
from pyspark.sql import functions as F

from slotweave.functions.packing import lattice, pieces
from slotweave.operators import packed, skew

COLUMN = ["red, green", "red", "green", "blue", '"salt, smoked", red', "and/or", "and/or, red", "red; green; blue", "supply and demand", "supply and demand, red", "red, green and blue"]


def items(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "value string")
    return {r["value"]: r["items"] for r in packed.split_packed(df).collect()}


def test_splits(spark):
    got = items(spark, COLUMN + [
        '["a", "b, c"]', "1) red 2) green", "(1) red; (2) green", "- red\n- green", "bolts\\, M6,red", "'left, right', 'blue'", '"""big"" sign", red', "red (a, b)", "(red|green)",
        ",red, ,green,", "red|green", "red、green", " red , red ", "salt, smoked",
    ])
    assert got["red, green"] == ["red", "green"]
    assert got['"salt, smoked", red'] == ["salt, smoked", "red"]
    assert got["and/or, red"] == ["and/or", "red"] and got["and/or"] == ["and/or"]
    assert got["supply and demand"] == ["supply and demand"]
    assert got["red, green and blue"] == ["red", "green", "blue"]
    assert got['["a", "b, c"]'] == ["a", "b, c"]
    assert got["1) red 2) green"] == got["(1) red; (2) green"] == got["- red\n- green"] == got["(red|green)"] == ["red", "green"]
    assert got["bolts\\, M6,red"] == ["bolts, M6", "red"]
    assert got["'left, right', 'blue'"] == ["left, right", "blue"]
    assert got['"""big"" sign", red'] == ['"big" sign', "red"]
    assert got["red (a, b)"] == ["red (a, b)"]
    assert got[",red, ,green,"] == got["red|green"] == got["red、green"] == ["red", "green"]
    assert got[" red , red "] == ["red", "red"]


def test_items_of_many_pieces(spark):
    title = "a man, a plan, a canal, a cat, a ham, a yak"
    longer = ", ".join(f"part {chr(97 + i)}" for i in range(15))
    assert (0, 5) in set(zip(*lattice(title)[:2])) and (0, 14) in set(zip(*lattice(longer)[:2]))
    assert (1, 15) in set(zip(*lattice(f"red, {longer}, blue", [longer])[:2]))
    assert (0, 19) in set(zip(*lattice("/".join("abcdefghijklmnopqrst"))[:2]))
    # Both stand quoted, whole or in lists, so their one bare occurrence is one item too.
    got = items(spark, [f'"{x}"; {y}' for x in (title, longer) for y in ("red", "green", "blue")] + [f"{title}; red", f"blue; {longer}; red", "red", "green", "blue", "red; blue"])
    assert got[f"{title}; red"] == [title, "red"]
    assert got[f"blue; {longer}; red"] == ["blue", longer, "red"]


def test_edges(spark):
    assert items(spark, [None, "", "  ", ",", "[]", "[1", '"open']).keys() <= {",", "[]", "[1", '"open'}
    long = "a, " * 5000 + "b"
    assert len(items(spark, [long])[long]) == 5001
    assert spark.createDataFrame([], "value string").transform(packed.split_packed).count() == 0


def test_lattice_covers():
    first, last, texts, gaps = lattice("a, b; c")
    assert ("a" in texts) and max(last) == len(gaps)
    assert pieces("x")[0] == [(0, 1)]


def test_options_extra_columns(spark):
    rows = [(1, "colours", "red, green", 9), (2, "colour", "red, green", 9), (3, None, "a, b", 9), (4, "The Colours_list", "red; blue", 9), (5, "weight", "1, 2", 9), (1_000, "colours", "red, green", 9)]
    df = spark.createDataFrame(rows, "option_seq long, slot string, value string, n int").withColumn("slot_id", F.lit(7)).withColumn("items", F.lit("x"))
    catalog = spark.createDataFrame([(1, "colours", ["hues"], True), (2, "weight", [], False)], "slot_id int, slot_name string, known_aliases array<string>, list_like boolean")
    got = packed.packed_options(df, catalog).collect()
    assert {(r["option_seq"], r["item_pos"], r["item_text"]) for r in got} == {(s, p, t) for s in (1, 2, 1_000) for p, t in ((1, "red"), (2, "green"))} | {(4, 1, "red"), (4, 2, "blue")}


@pytest.mark.parametrize("hot", [1, 3, 1_000])
def test_salted_join(spark, hot):
    left = spark.range(20).select((F.col("id") % 3).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    assert skew.salted_join(left, right, ["k"], "n", F.col("id"), hot_rows=hot).count() == 20
