"""Freely typed names against a reference list of any size: shards of the list in turn, winners merged."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotweave.functions.names import MISSPELT, NameMatcher, settled
from slotweave.operators.skew import salted_join
from slotweave.session import opened, share

#: Names and aliases of a reference list that one tree is built of at most (each has 24 word orders or fewer).
MAX_BROADCAST = 50_000
#: Letters of those names and aliases.
MAX_CHARS = 5_000_000


def _matcher(reference: DataFrame) -> NameMatcher:
    return NameMatcher([(r[0], r[1], list(r[2] or [])) for r in reference.orderBy("slot_id").collect()])


def mapped(rows: DataFrame, column: str, reference: DataFrame, out: str = "slot_id", max_broadcast: int = MAX_BROADCAST, max_chars: int = MAX_CHARS) -> DataFrame:
    """rows with the id of the entry that the name in column means, -1 if none.

    reference: slot_id, slot_name, known_aliases. Its names and aliases and their letters are counted first: up to
    max_broadcast and max_chars the tree of all is built once, sent to the tasks, and rows stream past it without a
    shuffle; a longer list is cut into shards, the distinct names stream past the tree of each, and what all shards found
    is merged by the same order of preference, so the result is the same."""
    reference = reference.select("slot_id", "slot_name", "known_aliases").where("slot_name is not null")
    rows = rows.drop(out)
    size = F.lit(1) + F.size(F.coalesce("known_aliases", F.array().cast("array<string>")))
    letters = F.length("slot_name") + F.coalesce(F.length(F.array_join("known_aliases", "")), F.lit(0))
    names, chars = reference.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(letters), F.lit(0))).first()
    shards = max(1, -(-names // max_broadcast), -(-chars // max_chars))
    if shards == 1:
        return _streamed(rows, column, _matcher(reference), out)
    asked = rows.where(F.trim(column) != "").groupBy(F.col(column).alias("_name")).agg(F.count("*").alias("_n"))
    found = None
    for s in range(shards):
        shared = share(rows.sparkSession, _matcher(reference.where(F.pmod(F.xxhash64("slot_id"), F.lit(shards)) == s)))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            matcher = opened(shared)
            for b in batches:
                got = [(n, k, *f) for n, k, fs in zip(b["_name"], b["_n"], matcher.findings(list(b["_name"]))) for f in _least(fs)]
                yield pd.DataFrame(got, columns=["_name", "_n", "stage", "d", "lev", "rank", "id"])

        one = asked.mapInPandas(run, "_name string, _n long, stage int, d int, lev int, rank int, id int")
        found = one if found is None else found.unionByName(one)
    # A shard gives a name a few findings, so a group is as large as there are shards.
    lists = found.groupBy("_name").agg(F.max("_n").alias("_n"), F.collect_set(F.struct("stage", "d", "lev", "rank", "id")).alias("_f"))

    @F.pandas_udf("int")
    def best(f: pd.Series) -> pd.Series:
        return f.map(lambda x: settled([tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in x])[0])

    winners = lists.select(F.col("_name").alias(column), "_n", best("_f").alias(out))
    return salted_join(rows, winners, [column], "_n", F.monotonically_increasing_id(), "left").drop("_n").fillna(-1, [out])


def _least(findings: list[tuple]) -> set[tuple]:
    """What the merge needs of one shard's findings: the least of each stage, and all abbreviations (two at most a stage)."""
    best: dict[int, tuple] = {}
    for f in findings:
        best[f[0]] = min(f, best.get(f[0], f))
    return set(best.values()) | {f for f in findings if f[0] < MISSPELT and f[0] % 3 == 1}


def _streamed(rows: DataFrame, column: str, matcher: NameMatcher, out: str) -> DataFrame:
    """Each task looks a name up once; rows keep their order."""
    fields = list(rows.schema.fields)
    kept = [f.name for f in fields]
    shared = share(rows.sparkSession, matcher)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher, known = opened(shared), {}
        for b in batches:
            new = [x for x in b[column].dropna().unique() if x not in known]
            if len(known) + len(new) > 500_000:
                known, new = {}, list(b[column].dropna().unique())
            known.update(zip(new, (k for k, _ in matcher.match(new))))
            b[out] = b[column].map(known).fillna(-1).astype("int32")
            yield b[[*kept, out]]

    return rows.mapInPandas(run, T.StructType([*fields, T.StructField(out, T.IntegerType())]))
