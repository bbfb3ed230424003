"""Frequency of every distinct term: burst-trie counting.

Each task counts its terms in a burst trie (small containers of whole suffixes that burst into a node once they grow), so
a term leaves a task once with its two counters, in order. Terms are then routed by range: the bounds are drawn from the
terms themselves, so prefixes that carry many terms are cut finer, and each range is a set of whole subtrees. There the
subtrees are merged. Null and blank terms don't count; terms are compared as given (clean them before)."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.session import cut

#: Terms a container holds before it bursts; terms a task's trie holds before it is passed on.
BURST, FULL = 64, 500_000


class BurstTrie:
    """Inner nodes branch on one character; leaves are containers {suffix: [occurrences, records]}."""

    def __init__(self):
        self.root: tuple[dict, dict] = ({}, {})  # children by character, container
        self.size = 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        children, container = self.root
        at = 0
        while at < len(term) and term[at] in children:
            children, container = children[term[at]]
            at += 1
        kept = container.get(term[at:])
        if kept is not None:
            kept[0] += occurrences
            kept[1] += records
            return
        container[term[at:]] = [occurrences, records]
        self.size += 1
        if len(container) > BURST:
            self._burst(children, container)

    @staticmethod
    def _burst(children: dict, container: dict) -> None:
        for suffix in [s for s in container if s]:
            child = children.setdefault(suffix[0], ({}, {}))
            child[1][suffix[1:]] = container.pop(suffix)
        for c, box in children.values():
            if len(box) > BURST and any(box):
                BurstTrie._burst(c, box)

    def items(self) -> Iterator[tuple[str, int, int]]:
        """In the order of the terms."""
        stack: list[tuple[str, object]] = [("", self.root)]
        while stack:
            prefix, x = stack.pop()
            if isinstance(x, list):
                yield prefix, x[0], x[1]
                continue
            children, container = x
            found = [(prefix + s, v) for s, v in container.items()] + [(prefix + c, child) for c, child in children.items()]
            stack.extend(sorted(found, key=lambda t: t[0], reverse=True))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (term, occurrences in the record) counted into tries."""
    trie = BurstTrie()
    for b in batches:
        grouped = pa.table([b.column(0), b.column(1)], ["t", "n"]).group_by("t").aggregate([("n", "sum"), ("n", "count")])
        for t, n, r in zip(grouped["t"].to_pylist(), grouped["n_sum"].to_pylist(), grouped["n_count"].to_pylist()):
            trie.add(t, n, r)
        if trie.size >= FULL:
            yield from _emit(trie)
            trie = BurstTrie()
    yield from _emit(trie)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (term, occurrences, records): equal neighbours are one leaf; a finished subtree is passed on."""
    trie = BurstTrie()
    for b in batches:
        terms = b.column(0).to_pylist()
        for t, n, r in zip(terms, b.column(1).to_pylist(), b.column(2).to_pylist()):
            if trie.size >= FULL and t != last:
                yield from _emit(trie)
                trie = BurstTrie()
            trie.add(t, n, r)
            last = t
    yield from _emit(trie)


def _emit(trie: BurstTrie) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[str, int, int]] = []
    for x in trie.items():
        rows.append(x)
        if len(rows) == 50_000:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    t, n, r = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(n, pa.int64()), pa.array(r, pa.int64())], ["term", "occurrences", "records"])


def count_terms(records: DataFrame) -> DataFrame:
    """records: (terms array<string>), one row a record, terms clean. (term, occurrences, records)."""
    schema = "term string, occurrences long, records long"
    # A record's own repeats are folded first, so that each row is one record holding the term.
    single = records.where(F.size("terms") == 1).select(F.col("terms")[0].alias("term"), F.lit(1).cast("long").alias("n"))
    several = records.where(F.size("terms") > 1).select(
        F.explode(F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.size(F.filter("terms", lambda x: x == t)).cast("long").alias("n")))).alias("x")
    ).select("x.term", "x.n")
    local = cut(single.unionByName(several).mapInArrow(_count, schema))
    return local.repartitionByRange("term").sortWithinPartitions("term").mapInArrow(_merge, schema)


def clean(c: str):
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def fields(options: DataFrame, templates: DataFrame, prompts: DataFrame) -> dict[str, DataFrame]:
    """For each counted field one row a record with its clean terms; a prompt id counts once, as first delivered."""
    whole = lambda c: F.filter(F.array(clean(c)), lambda x: x.isNotNull() & (x != ""))
    first = prompts.groupBy("id").agg(F.min_by("active_labels", F.struct("loaded_at", "active_labels")).alias("active_labels"))
    labels = F.filter(F.transform("active_labels", lambda x: F.lower(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x.isNotNull() & (x != ""))
    return {
        "option.slot": options.select(whole("slot").alias("terms")),
        "template.task_type": templates.select(whole("task_type").alias("terms")),
        "prompt.active_labels": first.select(F.coalesce(labels, F.array().cast("array<string>")).alias("terms")),
    }


def term_table(sources: dict[str, DataFrame], rare: int = 5, common: float = 0.08) -> DataFrame:
    """(field_name, term, occurrences, records, total, mark): mark is 'rare' below `rare` records, 'common' above the
    part `common` of all records of the field (those without a term included), else null."""
    # One pass for all fields: the field's number leads the term, so a field is a subtree of its own.
    names = {f"{i}": name for i, name in enumerate(sources)}
    tagged, totals = None, None
    for i, (name, df) in enumerate(sources.items()):
        t = df.select(F.transform("terms", lambda x: F.concat(F.lit(f"{i}:"), x)).alias("terms"))  # noqa: B023
        tagged = t if tagged is None else tagged.unionByName(t)
        n = df.agg(F.count("*").alias("total")).select(F.lit(name).alias("field_name"), "total")
        totals = n if totals is None else totals.unionByName(n)
    field = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.substring_index("term", ":", 1))
    counted = count_terms(tagged).select(field.alias("field_name"), F.expr("substring(term, instr(term, ':') + 1)").alias("term"), "occurrences", "records")
    return counted.join(F.broadcast(totals), "field_name").withColumn(
        "mark", F.when(F.col("records") < rare, "rare").when(F.col("records") > common * F.col("total"), "common")
    )

