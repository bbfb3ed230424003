"""Duplicates hidden by formatting: an incremental ledger of canonical keys.

Two texts are copies if they have the same words in the same order once case, white space and punctuation are ignored,
or, where they consist of labelled parts ("name: content"), the same parts in any order; copies of copies are copies. The
ledger keeps for each canonical key (words and parts) its bucket, the number of copies and the earliest representative; a
batch is aggregated first, then full-outer-joined with the buckets it meets, counts added and the earlier representative
kept. Groups are the connected components of words and parts.

Null and blank texts are no records. Texts without a letter or digit are copies of each other if equal once trimmed.
Exact copies count. A key may have any number of copies: keys are counted by partial aggregation, and joins back to the
records spread hot keys (operators.skew)."""

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.operators.skew import salted_join
from slotweave.session import cut, ensure_checkpoint_dir

#: A label: one to four words, in quotes or not, before a colon, an equals sign or a dash, at the start of the text or after a separator.
_LABEL = r"""(?:^[^\p{L}\p{N}]*|[\n\r;|,][^\p{L}\p{N}\n\r]*)(\p{L}[\p{L}\p{N}'_-]*(?:[ \x{a0}\t]+[\p{L}\p{N}'_-]+){0,3})["'”»*_`]*[ \x{a0}\t]*(?:[:=]|[-–](?=[ \x{a0}\t]))"""
#: Buckets of a kept ledger; a folder keeps the number it was begun with.
BUCKETS = 64


def words_key(text: Column) -> Column:
    plain = F.regexp_replace(text, r"[\p{Cf}'’]+", "")
    words = F.trim(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}]+", " "))
    return F.when(words == "", F.concat(F.lit("="), F.regexp_replace(text, r"\s+", ""))).otherwise(words)


def parts_key(text: Column) -> Column:
    """The labelled parts of a text, reduced and sorted; null where it has fewer than two or begins without a label."""
    marked = F.regexp_replace(F.regexp_replace(text, r"\p{Cf}+", ""), _LABEL, "\u0001$1\u0002")
    parts = F.split(marked, "\u0001")
    parts = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    reduced = F.transform(parts, lambda p: F.array_join(F.transform(F.split(p, "\u0002", 2), lambda x: F.trim(F.regexp_replace(F.lower(F.regexp_replace(x, "['’]", "")), r"[^\p{L}\p{N}]+", " "))), "\u0002"))
    return F.when(F.instr(marked, "\u0001").eqNullSafe(1) & (F.size(parts) > 1), F.concat(F.lit("\u0001"), F.array_join(F.array_sort(reduced), "\u0001")))


def canonical_records(records: DataFrame) -> DataFrame:
    """records (record_kind, seq, text) as (record_kind, seq, words, parts): 128-bit keys, parts null if not labelled."""
    hashed = lambda c: F.unhex(F.md5(c))
    return records.where(F.length(F.regexp_replace("text", r"\s+", "")) > 0).select(
        "record_kind", "seq", hashed(words_key(F.col("text"))).alias("words"), hashed(parts_key(F.col("text"))).alias("parts")
    )


def batch_counts(keys: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row for each canonical key of a batch, in ledger form; parts is empty where the text has no labelled parts."""
    parts = F.coalesce("parts", F.lit(b""))
    return keys.groupBy("record_kind", "words", parts.alias("parts")).agg(F.count("*").alias("copies"), F.min("seq").alias("first_seq")).select(
        F.pmod(F.xxhash64("words"), F.lit(buckets)).cast("int").alias("bucket"), "record_kind", "words", "parts", "copies", "first_seq"
    )


def merge(ledger: DataFrame | None, counts: DataFrame) -> DataFrame:
    if ledger is None:
        return counts
    key = ["bucket", "record_kind", "words", "parts"]
    new = counts.select(*key, F.col("copies").alias("c"), F.col("first_seq").alias("s"))
    return ledger.join(new, key, "full_outer").select(
        *key, (F.coalesce("copies", F.lit(0)) + F.coalesce("c", F.lit(0))).alias("copies"), F.least("first_seq", "s").alias("first_seq")
    )


class Ledger:
    """A ledger kept between runs in a folder that all executors share (by default a new one in the session's checkpoint
    folder). Each batch writes one version with only the buckets it meets, partitioned by bucket, and then a list of which
    version holds which bucket; the highest listed version counts, so a batch that was lost half way changes nothing, and
    a new Ledger on the same folder goes on where the last one ended."""

    def __init__(self, spark, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path = spark, path or f"{ensure_checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"
        self.version, self.buckets, self.held = 0, buckets, {}
        for v in sorted(self._listed(), reverse=True):
            row = json.loads(spark.read.text(f"{self.path}/list/{v}").first()[0])
            self.version, self.buckets, self.held = v, row["buckets"], {int(b): int(k) for b, k in row["held"].items()}
            break

    def _listed(self) -> list[int]:
        """The versions whose list was written to its end."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/list")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(at)]
        return [int(n) for n in names if n.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/list/{n}/_SUCCESS"))]

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The ledger, or what it holds in some buckets."""
        out = None
        for v in sorted(set(self.held.values())):
            mine = [b for b, k in self.held.items() if k == v and (buckets is None or b in buckets)]
            if mine:
                one = self.spark.read.parquet(f"{self.path}/data/{v}").where(F.col("bucket").isin(mine)).select("bucket", "record_kind", "words", "parts", "copies", "first_seq")
                out = one if out is None else out.unionByName(one)
        return out

    def add(self, records: DataFrame) -> DataFrame | None:
        return self.add_keys(canonical_records(records))

    def add_keys(self, keys: DataFrame) -> DataFrame | None:
        """Adds a batch of canonical_records. Only the buckets that the batch meets are read and written."""
        counts = cut(batch_counts(keys, self.buckets))
        met = [r[0] for r in counts.select("bucket").distinct().collect()]
        if met:
            version = self.version + 1
            merge(self.read(met), counts).repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{version}")
            held = self.held | dict.fromkeys(met, version)
            row = json.dumps({"buckets": self.buckets, "held": held})
            self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/list/{version}")
            self.version, self.held = version, held
        return self.read()


def roots(ledger: DataFrame) -> DataFrame:
    """(record_kind, words, parts, copies, first_seq, root): each key with its group, the connected component over equal
    words and equal parts. Where no words come with several parts, the parts (or the words, without parts) name the group;
    else the least name is handed on between words and parts until nothing changes, for the keys concerned only."""
    keys = ledger.withColumn("root", F.when(F.length("parts") > 0, F.col("parts")).otherwise(F.col("words")))
    by = ["record_kind", "words"]
    several = cut(ledger.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 1"))
    if several.isEmpty():
        return keys
    # Only words with several names join groups, so they alone are gone through; orig is the name that a key had at first.
    edges = cut(salted_join(keys.select(*by, "root"), several, by, "_n", F.col("root")).select(*by, F.col("root").alias("orig"), "root").distinct())
    while True:
        low = edges.groupBy(*by).agg(F.min("root").alias("low"), F.count("*").alias("_n"))
        moves = salted_join(edges, low, by, "_n", F.col("orig")).where("root <> low").groupBy("record_kind", "root").agg(F.min("low").alias("low"))
        # A name that several words move goes to the least; those words meet the others again in the next round.
        moves = cut(edges.groupBy("record_kind", "root").agg(F.count("*").alias("_n")).join(moves, ["record_kind", "root"]))
        if moves.isEmpty():
            break
        edges = cut(salted_join(edges, moves, ["record_kind", "root"], "_n", F.col("words"), "left").select(*by, "orig", F.coalesce("low", "root").alias("root")))
    names = edges.groupBy("record_kind", F.col("orig").alias("root")).agg(F.min("root").alias("low"))
    names = keys.groupBy("record_kind", "root").agg(F.count("*").alias("_n")).join(names, ["record_kind", "root"])
    return salted_join(keys, names, ["record_kind", "root"], "_n", F.col("words"), "left").withColumn("root", F.coalesce("low", "root")).drop("low", "_n")


def groups(ledger: DataFrame) -> DataFrame:
    """(record_kind, words, parts, copies, keep_seq) of the keys whose group has several copies."""
    root = cut(roots(ledger))
    total = root.groupBy("record_kind", "root").agg(F.sum("copies").alias("group_copies"), F.min("first_seq").alias("keep_seq"), F.count("*").alias("n"))
    several = total.where(F.col("group_copies") > 1)
    return salted_join(root.select("record_kind", "root", "words", "parts", "copies"), several, ["record_kind", "root"], "n", F.col("words")).select("record_kind", "words", "parts", "copies", "keep_seq")


def booked(records: DataFrame, batches: int, book: "Ledger | None" = None) -> tuple[DataFrame, DataFrame]:
    """The keys of all records, and the ledger after they arrived in `batches` batches in the order of seq."""
    keys = cut(canonical_records(records))
    book = book or Ledger(records.sparkSession)
    lo, hi = keys.agg(F.min("seq"), F.max("seq")).first()
    step = 1 if lo is None else max(1, -(-(hi - lo + 1) // batches))
    for i in range(batches if lo is not None else 0):
        book.add_keys(keys.where(F.col("seq").between(lo + i * step, lo + (i + 1) * step - 1)))
    empty = batch_counts(keys.limit(0))
    return keys, book.read() or empty


def find_copies(records: DataFrame, batches: int = 2) -> DataFrame:
    """(record_kind, keep_seq, copy_seq): each record that copies an earlier one, with the first of its group. records
    (record_kind, seq, text) are added to a ledger in `batches` batches in the order of seq."""
    keys, ledger = booked(records, batches)
    found = groups(ledger)
    keys = keys.select("record_kind", "seq", "words", F.coalesce("parts", F.lit(b"")).alias("parts"))
    return salted_join(keys, found, ["record_kind", "words", "parts"], "copies", F.col("seq")).where("seq <> keep_seq").select("record_kind", "keep_seq", F.col("seq").alias("copy_seq"))


def collapsed(records: DataFrame, batches: int = 2) -> DataFrame:
    """(record_kind, keep_seq, copies): one row a group, single records included."""
    _, ledger = booked(records, batches)
    return roots(ledger).groupBy("record_kind", "root").agg(F.min("first_seq").alias("keep_seq"), F.sum("copies").alias("copies")).drop("root")
