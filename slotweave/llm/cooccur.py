"""Items that appear together: packed 64-bit pair codes, sorted in runs, merged and run-length counted.

Every record's distinct items get 32-bit codes; each pair of them is one 64-bit number. Tasks sort their codes in runs
and count equal neighbours, so that only (code, count) leaves a task; the runs are merged by a sort on the code, which
spills as it must, and counted again. Then each pair gets its lift and its odds ratio with 0.5 added to each cell.

Null and blank items don't count, nor do repeats within a record; records without items don't count either."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotweave.session import cut, opened, share

#: Codes that a task sorts at once.
RUN = 4_000_000


def dense_codes(terms: DataFrame, column: str) -> DataFrame:
    """terms with `code`: 0, 1, 2 ... in the order of column; ranges are numbered apart and shifted, so no task sees all."""
    ranged = cut(terms.repartitionByRange(column).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").count().collect()  # one row a partition
    at, shift = 0, []
    for r in sorted(sizes, key=lambda r: r["_range"]):
        shift.append((r["_range"], at))
        at += r["count"]
    if at >= 1 << 31:
        raise ValueError("more distinct items than 31-bit codes")
    if not shift:
        return ranged.withColumn("code", F.lit(0).cast("int")).drop("_range")
    shifts = terms.sparkSession.createDataFrame(shift, "_range int, _at long")
    return ranged.join(F.broadcast(shifts), "_range").withColumn("code", (F.row_number().over(W.partitionBy("_range").orderBy(column)) - 1 + F.col("_at")).cast("int")).drop("_range", "_at")


def _runs(codes: list[np.ndarray], weights: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    c = np.concatenate(codes) if codes else np.empty(0, np.int64)
    if weights is None:
        return np.unique(c, return_counts=True)
    w = np.concatenate(weights) if weights else np.empty(0, np.int64)
    if not len(c):
        return c, w
    starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    return c[starts], np.add.reduceat(w, starts)


def _pair_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def flush():
        code, count = _runs(held)
        return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(count, pa.int64())], ["code", "n"])

    for b in batches:
        lists = b.column(0)
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy())
        starts = np.r_[0, np.cumsum(ends)]
        for size in np.unique(ends):
            if size < 2:
                continue
            rows = np.flatnonzero(ends == size)
            block = np.sort(flat[starts[rows][:, None] + np.arange(size)], axis=1)
            for i in range(size - 1):  # one column against all later ones: a long record never holds all its pairs at once
                pairs = ((block[:, i : i + 1] << 32) | block[:, i + 1 :]).ravel()
                held.append(pairs)
                n += len(pairs)
                if n >= RUN:
                    yield flush()
                    held, n = [], 0
    if held:
        yield flush()


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple[int, int] | None = None
    for b in batches:
        code, n = _runs([b.column(0).to_numpy()], [b.column(1).to_numpy()])
        if not len(code):
            continue
        if last and last[0] == code[0]:
            n[0] += last[1]
        elif last:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64())], ["code", "n"])
        last = int(code[-1]), int(n[-1])
        yield pa.RecordBatch.from_arrays([pa.array(code[:-1], pa.int64()), pa.array(n[:-1], pa.int64())], ["code", "n"])
    if last:
        yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64())], ["code", "n"])


def pair_counts(records: DataFrame) -> DataFrame:
    """records: (items array<string>), one row a record, items clean and distinct. (label_a, label_b, n_ab, n_a, n_b, n)."""
    records = cut(records.where(F.size("items") > 0).select("items"))
    single = records.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n_item"))
    coded = cut(dense_codes(single, "item"))
    total = records.agg(F.count("*").alias("n"))
    with_id = records.where(F.size("items") > 1).withColumn("rid", F.monotonically_increasing_id())
    if coded.count() <= 100_000:  # a checked bound; a larger vocabulary is joined instead
        codes = {r["item"]: r["code"] for r in coded.select("item", "code").collect()}
        shared = share(records.sparkSession, codes)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = opened(shared)
            keys = pa.array(list(table), pa.string())
            values = np.array(list(table.values()), dtype=np.int32)

            def lists(bs):
                import pyarrow.compute as pc

                for b in bs:
                    col = b.column(0)
                    at = pc.index_in(col.flatten().cast(pa.string()), value_set=keys).to_numpy(zero_copy_only=False)
                    offsets = col.offsets.to_numpy() - col.offsets[0].as_py()
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[at], pa.int32()))], ["codes"])

            yield from _pair_runs(lists(batches))

        runs = with_id.select("items").mapInArrow(encode, "code long, n long")
    else:
        lists = with_id.select("rid", F.explode("items").alias("item")).join(coded.select("item", "code"), "item").groupBy("rid").agg(F.collect_list("code").alias("codes"))
        runs = lists.select("codes").mapInArrow(_pair_runs, "code long, n long")
    counted = runs.repartition("code").sortWithinPartitions("code").mapInArrow(_merge_runs, "code long, n long")
    a = coded.select(F.col("code").alias("ca"), F.col("item").alias("label_a"), F.col("n_item").alias("n_a"))
    b = coded.select(F.col("code").alias("cb"), F.col("item").alias("label_b"), F.col("n_item").alias("n_b"))
    return (
        counted.select(F.shiftright("code", 32).cast("int").alias("ca"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("cb"), F.col("n").alias("n_ab"))
        .join(a, "ca").join(b, "cb").crossJoin(F.broadcast(total)).select("label_a", "label_b", "n_ab", "n_a", "n_b", "n")
    )


def with_chance(pairs: DataFrame) -> DataFrame:
    """Adds lift (observed against expected by chance) and odds_ratio, 0.5 added to each cell of the fourfold table."""
    both, only_a, only_b = F.col("n_ab"), F.col("n_a") - F.col("n_ab"), F.col("n_b") - F.col("n_ab")
    neither = F.col("n") - F.col("n_a") - F.col("n_b") + F.col("n_ab")
    return pairs.withColumn("lift", F.round(both * F.col("n") / (F.col("n_a") * F.col("n_b")), 6)).withColumn(
        "odds_ratio", F.round((both + 0.5) * (neither + 0.5) / ((only_a + 0.5) * (only_b + 0.5)), 6)
    )


def clean_labels(prompts: DataFrame) -> DataFrame:
    """One row a prompt id (of its earliest delivery): its distinct non-blank labels, trimmed and lower-cased."""
    first = prompts.groupBy("id").agg(F.min_by("active_labels", F.struct("loaded_at", "active_labels")).alias("labels"))
    return first.select("id", F.array_sort(F.array_distinct(F.filter(F.transform("labels", lambda x: F.lower(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x.isNotNull() & (x != "")))).alias("items"))
