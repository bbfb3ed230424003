"""Embeddings: thresholded top-k by cosine, means per group, links between groups, clustering."""

import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotweave.functions.nearest import Nearest, joined, sparse
from slotweave.session import cut, opened, share


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 50, least: float = 0.7, block: int = 2048) -> DataFrame:
    """(query_id, vec_id, score, rank): for each query the k nearest vectors (unit length) with a cosine (to 6 places) of at
    least `least`; ids are numbers or strings; a vector isn't its own neighbour; ties by vec_id; null vectors take no part.

    queries is a stated set (query_id, embedding) that streams in blocks of `block` to the vectors: each task keeps its k
    best for a block, so the merge gets at most k rows per query and task."""
    out = None
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, score double"
    n = queries.count()
    blocks = max(1, -(-n // block))
    for i in range(blocks):
        part = queries.where(F.col("embedding").isNotNull() & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)).collect()
        if not part:
            continue
        q = share(vectors.sparkSession, ([r["query_id"] for r in part], np.array([r["embedding"] for r in part], dtype=np.float64)))

        def run(batches: Iterator[pd.DataFrame], q=q) -> Iterator[pd.DataFrame]:
            names, m = opened(q)
            ids = np.asarray(names)
            best: list[tuple] = []
            for b in batches:
                b = b[b["embedding"].notna()]
                if not len(b):
                    continue
                v = np.asarray(b["vec_id"].tolist())
                s = np.stack(b["embedding"].to_numpy()).astype(np.float64) @ m.T
                at, to = np.nonzero(np.round(s, 6) >= least)
                other = v[at] != ids[to] if v.dtype.kind == ids.dtype.kind else np.ones(len(at), bool)
                at, to = at[other], to[other]
                best.append((to, v[at], s[at, to]))
                if sum(len(x[0]) for x in best) > 500_000:
                    best = [_keep(best, k)]
            if best:
                a, v, s = _keep(best, k)
                if not len(a):
                    return
                yield pd.DataFrame({"query_id": [names[i] for i in a], "vec_id": v.tolist(), "score": s})

        one = vectors.select("vec_id", "embedding").mapInPandas(run, schema)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return out.withColumn("score", F.round("score", 6)).withColumn("rank", rank).where(F.col("rank") <= k)


def _keep(parts: list[tuple], k: int) -> tuple:
    a, v, s = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((v, -np.round(s, 6), a))
    a, v, s = a[order], v[order], s[order]
    starts = np.r_[0, np.flatnonzero(a[1:] != a[:-1]) + 1] if len(a) else np.empty(0, int)
    place = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
    return a[place < k], v[place < k], s[place < k]


def _packed(df: DataFrame, text: str, keep: list[str], make: Callable, size: int) -> DataFrame:
    """(part, number, data): df embedded by text, up to `size` rows in one: the numbers of their vectors that aren't zero, and
    the columns to keep. part is the partition, number goes on through it."""
    shared = share(df.sparkSession, make)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend, number, part = opened(shared)(), 0, TaskContext.get().partitionId()
        for b in batches:
            for i in range(0, len(b), size):
                x = b.iloc[i : i + size]
                m = np.asarray(backend.embed(list(x[text])))
                ends, dims, w = sparse(m)
                dims = dims.astype(np.uint8 if m.shape[1] <= 256 else np.int32)
                data = zlib.compress(pickle.dumps((m.shape[1], (ends.astype(np.int32), dims, w), *(x[c].tolist() for c in keep))), 1)
                yield pd.DataFrame({"part": [part], "number": [number], "data": [data]})
                number += 1

    return df.select(text, *keep).mapInPandas(run, "part int, number int, data binary")


def nearest(queries: DataFrame, vectors: DataFrame, make: Callable, k: int = 50, least: float = 0.7, held: int = 1 << 16, least_held: int = 1 << 11) -> DataFrame:
    """(about, vec_id, score, rank): for each query (text, about: array of what asks it) the k nearest of the vectors (text,
    ids: array, sorted, nulls last), texts being distinct within either: cosines (to 6 places) of at least `least`, ties by
    id. One row an entry of about.

    Nothing goes through the driver: each task holds up to some `held` queries with their best so far, and all vectors pass
    by, packed. The k best texts, those of one score
    by their first id, hold the k best ids."""
    n = queries.count()
    cores = queries.sparkSession.sparkContext.defaultParallelism
    groups = max(1, min(-(-n // least_held), cores * -(-n // (held * cores))))
    # Queries that begin alike share a task, and the sums that they begin with.
    asked = _packed(queries.repartitionByRange(groups, "text"), "text", ["about"], make, 4096).select("part", F.lit(0).alias("kind"), F.lit(0).alias("of"), "number", "data")
    first = F.get("ids", F.lit(0))
    sorted_ = vectors.orderBy(first.isNull(), first)
    # A text's ids travel and wait as one string.
    known = cut(_packed(sorted_.withColumn("ids", F.to_json("ids")), "text", ["ids"], make, 2048).select("part", "number", "data"))
    passed = known.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("to"), F.lit(1).alias("kind"), F.col("part").alias("of"), "number", "data").withColumnRenamed("to", "part")
    every = asked.unionByName(passed).repartitionById(groups, F.col("part")).sortWithinPartitions("part", "kind", F.xxhash64("of", "number"))
    of = queries.schema["about"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def told(best: Nearest, about: list) -> Iterator[pd.DataFrame]:
            for i in range(0, len(about), 1000):
                got = [(a, best.found(j)) for j, a in enumerate(about[i : i + 1000], i)]
                got = [(a, [x for x, _ in f], [y for _, y in f]) for a, f in got if f]
                if got:
                    yield pd.DataFrame(got, columns=["about", "ids", "scores"])

        at, best, parts, about = None, None, [], []
        for b in batches:
            for part, kind, of, number, data in b.itertuples(index=False):
                if part != at:
                    if best:
                        best.flush()
                        yield from told(best, about)
                    at, best, parts, about = part, None, [], []
                dims, (ends, d, w), x = pickle.loads(zlib.decompress(data))
                s = ends.astype(np.int64), d.astype(np.int32), w
                if kind == 0:
                    parts.append(s)
                    about += x
                elif about:
                    if best is None:
                        best = Nearest(joined(parts), k, least, dims)
                    best.add(s, (of << 40) + (number << 16) + np.arange(len(x)), x)
        if best:
            best.flush()
            yield from told(best, about)

    best = every.mapInPandas(run, f"about {of}, ids array<string>, scores array<double>")
    one = best.select("about", F.posexplode(F.arrays_zip("ids", "scores")).alias("i", "x"))
    return one.select(F.explode("about").alias("about"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"), (F.col("i") + 1).alias("rank"))


def means(vectors: DataFrame, by: str) -> DataFrame:
    """(by, embedding): element-wise mean of each group, brought to unit length."""
    m = vectors.where("embedding is not null").select(by, F.posexplode("embedding").alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    e = m.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda t: t["x"]).alias("e"))
    return e.withColumn("norm", F.sqrt(dot(F.col("e"), F.col("e"))) + 1e-8).select(by, F.transform("e", lambda x: x / F.col("norm")).alias("embedding"))


def links(groups: DataFrame, key: str, least: float, block: int = 8192) -> DataFrame:
    """(a, b, score) for a < b: pairs of groups whose means have a cosine (to 6 places) of at least `least`. groups is a
    summary table, one row a group; it is set against itself in blocks of `block` rows, as matrix products in the tasks."""
    groups = cut(groups.select(F.col(key).cast("string").alias("a"), "embedding").where("embedding is not null"))
    blocks = max(1, -(-groups.count() // block))
    out = None
    for i in range(blocks):
        part = groups.where(F.pmod(F.xxhash64("a"), F.lit(blocks)) == i).collect()
        shared = share(groups.sparkSession, ([r["a"] for r in part], np.array([r["embedding"] for r in part], dtype=np.float64)))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, m = opened(shared)
            for b in batches if len(names) else ():
                if not len(b):
                    continue
                s = np.round(np.stack(b["embedding"].to_numpy()).astype(np.float64) @ m.T, 6)
                rows = [(x, names[j], float(s[i, j])) for i, x in enumerate(b["a"]) for j in np.flatnonzero(s[i] >= least) if x < names[j]]
                if rows:
                    yield pd.DataFrame(rows, columns=["a", "b", "score"])

        one = groups.mapInPandas(run, "a string, b string, score double")
        out = one if out is None else out.unionByName(one)
    return out


def cluster(names: list[str], vectors: np.ndarray, most: float = 0.35) -> list[int]:
    """Average-linkage clusters by cosine distance up to `most`; cluster numbers by first member."""
    n = len(names)
    d = 1 - vectors @ vectors.T
    np.fill_diagonal(d, np.inf)
    size, of, alive = np.ones(n), {i: [i] for i in range(n)}, np.ones(n, bool)
    while alive.sum() > 1:
        i, j = np.unravel_index(np.argmin(d), d.shape)
        if d[i, j] > most:
            break
        i, j = min(i, j), max(i, j)
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        of[i] += of.pop(j)
        alive[j] = False
    out = [0] * n
    for c, (_, members) in enumerate(sorted((min(m), m) for m in of.values())):
        for m in members:
            out[m] = c
    return out


def hashed_vector(texts: pd.Series, dims: int = 256) -> list[np.ndarray]:
    """The offline embedding: hashed words and letter trigrams, to unit length."""
    import re
    import zlib

    out = []
    for t in texts:
        v = np.zeros(dims)
        for w in re.findall(r"\w+", (t or "").casefold()):
            for g in (w, *(w[i : i + 3] for i in range(len(w) - 2))):
                h = zlib.crc32(g.encode())
                v[h % dims] += 1 if h >> 31 else -1
        out.append(v / (np.linalg.norm(v) or 1))
    return out


def word_vectors(texts: list[str], dims: int = 256) -> list[np.ndarray]:
    """The plainest offline embedding: words of letters and figures by their md5, to unit length; null and empty texts get
    zeros."""
    import hashlib
    import re

    known: dict[str, int] = {}
    out = []
    for t in texts:
        v = np.zeros(dims)
        for w in re.findall(r"[A-Za-z0-9]+", t or ""):
            w = w.lower()
            h = known.get(w)
            if h is None:
                h = known[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            v[h % dims] += 1 if h // dims % 2 == 0 else -1
        out.append(v / (np.linalg.norm(v) or 1))
    return out


def slot_clusters(options: DataFrame, most: float = 0.35, examples: int = 8, max_slots: int = 5_000) -> DataFrame:
    """(slot, cluster): slots with two or more distinct values, clustered by the embedding of 'slot: values'. Average linkage
    needs all slots at once, so up to max_slots, the commonest first, are clustered together; every further slot goes to the
    cluster that is nearest on average if that is within the threshold, and what is left is clustered in the same way."""
    o = options.where("trim(slot) <> '' and trim(value) <> ''").groupBy(F.lower(F.trim("slot")).alias("slot"), F.lower(F.trim("value")).alias("value")).agg(F.min("option_seq").alias("s"), F.count("*").alias("n"))
    first = o.withColumn("r", F.row_number().over(W.partitionBy("slot").orderBy("s"))).where(F.col("r") <= examples)
    few = o.groupBy("slot").agg(F.sum("n").alias("n"), F.count("*").alias("v")).where("v >= 2")
    few = few.join(first.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("s", "value"))).alias("x")), "slot")
    left = cut(few.select("slot", "n", F.concat("slot", F.lit(": "), F.array_join(F.transform("x", lambda t: t["value"]), ", ")).alias("text")))
    spark, base = options.sparkSession, 0
    out = spark.createDataFrame([], "slot string, cluster int")
    while True:
        rows = left.orderBy(F.col("n").desc(), "slot").limit(max_slots).toPandas().sort_values("slot").reset_index(drop=True)
        if not len(rows):
            return out
        v = np.stack(hashed_vector(rows["text"]))
        clusters = np.array(cluster(list(rows["slot"]), v, most))
        found = spark.createDataFrame(list(zip(rows["slot"], (clusters + base).tolist())), "slot string, cluster int")
        out = out.unionByName(found)
        if len(rows) < max_slots:
            return out
        means = np.stack([v[clusters == c].mean(0) for c in range(clusters.max() + 1)])
        shared = share(spark, (means, base))

        def nearest(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            m, at = opened(shared)
            for b in batches:
                if len(b):
                    s = np.stack(hashed_vector(b["text"])) @ m.T
                    k = s.argmax(1)
                    yield b.assign(cluster=np.where(1 - s[np.arange(len(b)), k] <= most, at + k, -1).astype("int32"))

        rest = cut(left.join(found, "slot", "left_anti").mapInPandas(nearest, "slot string, n long, text string, cluster int"))
        out = out.unionByName(rest.where("cluster >= 0").select("slot", "cluster"))
        left, base = rest.where("cluster < 0").drop("cluster"), base + len(means)
