"""Filling fixed-capacity containers: a plan over the histogram of lengths, then documents take the planned places.

Lengths are tokens of a public tokenizer. A text longer than the capacity is cut into pieces of exactly the capacity and
a rest. The driver sees only how many pieces there are of each length (at most `capacity` numbers) and plans best-fit,
longest first, over those counts: whole runs of equal containers at once. Each piece gets its rank among those of its
length, from counts of (length, shard) and ranks within; a length has the more shards the more pieces it has, so none is
ranked in one task, and the plan tells from length and rank the container and the offset. Null and blank texts take no room and give no row."""

import bisect
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotweave.session import cut, opened, share

CAPACITY = 1024
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: GPT-2's published pattern for cutting text before byte-pair encoding.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Characters after which a text may be handed to the tokenizer in several stretches.
CHUNK = 1_000_000
#: Pieces of one length that are ranked together.
RANKED = 500_000


_BEGIN = re.compile(r"\S(?=\s)")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one container, number of such containers). Best-fit decreasing: the longest left opens a container,
    which takes the longest that still fits until none does; as many containers are made alike as the counts allow."""
    left = {n: c for n, c in counts.items() if n > 0 and c > 0}
    sizes = sorted(left)
    out: list[tuple[tuple[int, ...], int]] = []
    while sizes:
        room, taken = capacity, {}
        at = len(sizes)
        shape: list[int] = []
        while True:
            at = bisect.bisect_right(sizes, room, 0, len(sizes)) - 1
            while at >= 0 and taken.get(sizes[at], 0) >= left[sizes[at]]:
                at -= 1
            if at < 0:
                break
            n = sizes[at]
            # Two pieces that fill the room exactly are better than the longest one alone.
            pair = _exact(sizes, left, taken, room) if n < room else None
            for x in pair or (n,):
                taken[x] = taken.get(x, 0) + 1
                shape.append(x)
                room -= x
        times = min(left[n] // k for n, k in taken.items())
        out.append((tuple(shape), times))
        for n, k in taken.items():
            left[n] -= k * times
            if not left[n]:
                sizes.remove(n)
                del left[n]
    return out


def _exact(sizes: list[int], left: dict[int, int], taken: dict[int, int], room: int) -> tuple[int, int] | None:
    i, j = 0, bisect.bisect_left(sizes, room) - 1
    while i <= j:
        s = sizes[i] + sizes[j]
        if s == room:
            need = 2 if i == j else 1
            if left[sizes[i]] - taken.get(sizes[i], 0) >= need and left[sizes[j]] - taken.get(sizes[j], 0) >= need:
                return sizes[j], sizes[i]
            i, j = i + 1, j - 1
        elif s < room:
            i += 1
        else:
            j -= 1
    return None


def places(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For each length: first ranks of its segments, their first containers, places a container, offsets of those places."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    container = 0
    for shape, times in planned:
        offsets: dict[int, list[int]] = {}
        at = 0
        for n in shape:
            offsets.setdefault(n, []).append(at)
            at += n
        for n, o in offsets.items():
            out.setdefault(n, []).append((used.get(n, 0), container, len(o), np.array(o)))
            used[n] = used.get(n, 0) + len(o) * times
        container += times
    return {n: (np.array([s[0] for s in v]), np.array([s[1] for s in v]), np.array([s[2] for s in v]), [s[3] for s in v]) for n, v in out.items()}


def _encoder(path: str):
    import base64

    import tiktoken

    if not os.path.exists(path):
        from pyspark import SparkFiles

        path = SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens). The vocabulary file (a parameter) lies at the same path on each worker, or was sent there by
    SparkContext.addFile. Very long texts are tokenized in stretches that begin with white space behind a word, where the
    tokenizer begins a token too, so the count is that of the whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizer).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [sum(len(encode(x)) for x in _stretches(t)) for t in b["text"]]})

    return documents.where(F.length(F.regexp_replace("text", r"\s+", "")) > 0).select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long")


def _stretches(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > CHUNK:
        m = _BEGIN.search(text, at + CHUNK)
        if m is None:
            break
        yield text[at : m.start() + 1]
        at = m.start() + 1
    yield text[at:]


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, ranked: int = RANKED) -> DataFrame:
    """(doc_id, piece, container, container_offset, n_tokens, text_offset): where each document (or piece) lies; piece counts
    from 0, text_offset is the piece's first token within the document."""
    lengths = token_lengths(documents, tokenizer)
    cuts = F.sequence(F.lit(0), F.ceil(F.col("n_tokens") / capacity).cast("int") - 1)
    pieces = lengths.select("doc_id", "n_tokens", F.explode(cuts).alias("piece")).select(
        "doc_id", "piece", F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece") * capacity).cast("int").alias("n"),
        (F.col("piece") * capacity).cast("long").alias("text_offset"),
    )
    pieces = cut(pieces)
    # At most `capacity` lengths come to the driver, and as many more shards as there are pieces / ranked.
    parts = {r["n"]: -(-r["count"] // ranked) for r in pieces.groupBy("n").count().collect()}
    hot = {n: k for n, k in parts.items() if k > 1}
    shards = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv]), F.col("n")), F.lit(1)) if hot else F.lit(1)
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), shards).cast("int"))
    groups = pieces.groupBy("n", "shard").count().collect()
    first: dict[tuple[int, int], int] = {}
    counts: dict[int, int] = {}
    for r in sorted(groups, key=lambda r: (r["n"], r["shard"])):
        first[(r["n"], r["shard"])] = counts.get(r["n"], 0)
        counts[r["n"]] = counts.get(r["n"], 0) + r["count"]
    table = places(plan(counts, capacity))
    shared = share(documents.sparkSession, (first, table))
    ranked = pieces.withColumn("rank", F.row_number().over(W.partitionBy("n", "shard").orderBy("doc_id", "piece")) - 1)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, where = opened(shared)
        for b in batches:
            container, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for n, rows in b.groupby("n").indices.items():
                shard, rank = b["shard"].to_numpy()[rows], b["rank"].to_numpy()[rows].astype(np.int64)
                rank = rank + np.array([start[(int(n), int(s))] for s in shard])
                begins, firsts, many, offsets = where[int(n)]
                seg = np.searchsorted(begins, rank, side="right") - 1
                within = rank - begins[seg]
                container[rows] = firsts[seg] + within // many[seg]
                offset[rows] = [offsets[s][w] for s, w in zip(seg, within % many[seg])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "piece": b["piece"], "container": container, "container_offset": offset.astype(np.int32), "n_tokens": b["n"], "text_offset": b["text_offset"]})

    return ranked.mapInPandas(place, "doc_id long, piece int, container long, container_offset int, n_tokens int, text_offset long")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least number of containers that could hold them, unused room in per cent."""
    return packed.groupBy("container").agg(F.sum("n_tokens").alias("t")).agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"),
        F.ceil(F.coalesce(F.sum("t"), F.lit(0)) / capacity).alias("least_containers"),
        F.round(100 * (1 - F.sum("t") / (F.count("*") * capacity)), 4).alias("unused_percent"),
    )
