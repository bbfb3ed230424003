"""Operators do the whole job: nothing is cut by length, rank or table size."""

from slotweave.operators import generate
from slotweave.plans import queries


def _store(spark, path, templates, options):
    """Tables of templates (id, text, task_type, level) and options (slot, value), in the form the queries read."""
    t = [(i, *r, []) for i, r in enumerate(templates)]
    o = [(i, *r) for i, r in enumerate(options)]
    spark.createDataFrame(t, "template_seq long, id string, text string, task_type string, level string, slots array<string>").write.parquet(f"{path}/task_templates.parquet")
    spark.createDataFrame(o, "option_seq long, slot string, value string").write.parquet(f"{path}/task_options.parquet")
    return str(path)


def test_collisions_are_of_whole_texts(spark, tmp_path):
    same = "Write a short story about {animal} and 12 friends."
    d = _store(
        spark, tmp_path,
        [("a", same, "x", "task_type"), ("b", "Write a short story about {pet} and 12 friends.", "x", "task_type"), ("c", same.replace("12", "13"), "x", "task_type"), ("d", same.replace("friends", "foes"), "y", "task_type"), ("e", same.lower(), "y", "task_type"), ("f", same, "z", "task_type")],
        [("animal", "cats"), ("pet", "cats")],
    )
    assert [tuple(r) for r in queries.queries()["same_type_collisions"](spark, d).select("first_id", "other_id").collect()] == [("a", "b")]
    assert [tuple(r) for r in queries.queries()["cross_type_collisions"](spark, d).select("first_id", "types", "slot_sets", "kind").collect()] == [("a", 2, 1, "merge")]


def test_exact_generation_draws_from_all_templates_and_values(spark):
    t = spark.range(20_100).selectExpr("id as template_seq", "concat('t', id) as id", "concat('Say {x} ', id) as text", "if(id < 20000, 'a', concat('late', id)) as task_type", "'task_type' as level")
    o = spark.range(40).selectExpr("id as option_seq", "'x' as slot", "concat('v', id, 'v') as value")
    rows = generate.generate_exact(t, o, 3_000, density=1).collect()
    assert max(int(r["task_id"][1:]) for r in rows) >= 20_000
    assert {r["prompt"].split()[1] for r in rows} == {f"v{i}v" for i in range(40)}
