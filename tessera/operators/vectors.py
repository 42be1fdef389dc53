"""Vector retrieval: exact top-k of a stated query set against all rows, multi-probe retrieval, an LSH index, text embedding."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers (rows x dimensions) of a block of queries that is sent to the data at once: 64 MB as doubles.
BLOCK = 8_000_000


#: Cells (rows x queries) that are multiplied at once, and hits that a task holds before it prunes them.
TILE, HELD = 4_000_000, 1_000_000


class Nearest:
    """The best rows of each query that a task has seen so far, by distance, then id."""

    def __init__(self, queries: int, k: int):
        self.k, self.limit = k, np.full(queries, np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, at: int, d: np.ndarray, rows: np.ndarray) -> None:
        """d: rows x queries from number `at` on; rows: their numbers. Whatever ties with the k-th best stays until the end."""
        limit = self.limit[at : at + d.shape[1]]
        if len(d) >= self.k:
            limit = np.minimum(limit, np.partition(d, self.k - 1, axis=0)[self.k - 1])
            self.limit[at : at + d.shape[1]] = limit
        i, j = np.nonzero(d <= limit)
        self.parts.append((j + at, d[i, j], rows[i]))
        self.held += len(i)

    def prune(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, distance, row) of the k best of each query; ids: of all rows by number."""
        q, d, r = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=np.int64))
        order = np.lexsort((ids[r], d, q))
        q, d, r = q[order], d[order], r[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        q, d, r = q[rank < self.k], d[rank < self.k], r[rank < self.k]
        self.parts, self.held = [(q, d, r)], len(q)
        return q, d, r


def nearest(data: DataFrame, queries: DataFrame, passes: Sequence[tuple[int, Column | None]], id: str, vector: str, query_id: str = "query_id", keep: Sequence[str] = ()) -> DataFrame:
    """(query_id, pass, rank, id, keep..., distance): for every pass (k, predicate) the k nearest rows that it admits, by cosine, exactly.

    All passes share one scan and one multiplication. Queries go to the data in blocks of bounded size, one block held at
    a time: with more than one, a block's hits are written down before the next is sent out. A task multiplies tile by
    tile, keeps k rows a query and pass, and only those are shuffled to be ranked. Ties are broken by id. Null and zero
    vectors are near nothing.
    """
    from tessera.session import cut

    spark = data.sparkSession
    types = dict(data.dtypes)
    qtype = dict(queries.dtypes)[query_id]
    ks, flags = [k for k, _ in passes], F.lit(0)
    for i, (_, predicate) in enumerate(passes):
        flags = flags + (F.lit(1 << i) if predicate is None else F.when(predicate, 1 << i).otherwise(0))
    rows = data.where(F.col(id).isNotNull() & F.col(vector).isNotNull()).select(id, *keep, F.col(vector).cast("array<double>").alias("__v"), flags.alias("__p")).where("__p > 0")
    schema = ", ".join([f"query_id {qtype}", "pass int", f"`{id}` {types[id]}", *(f"`{c}` {types[c]}" for c in keep), "distance double"])

    def search(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            best = [Nearest(len(q), k) for k in ks]
            seen: pd.DataFrame | None = None

            def prune() -> None:
                """Keeps the rows that some query still holds."""
                nonlocal seen
                used = np.unique(np.concatenate([x.prune(seen[id].to_numpy())[2] for x in best]))
                for x in best:
                    x.parts = [(q, d, np.searchsorted(used, r)) for q, d, r in x.parts]
                seen = seen.iloc[used].reset_index(drop=True)

            for b in batches:
                if not len(b):
                    continue
                m = np.stack(b.pop("__v").to_numpy())
                norm = np.linalg.norm(m, axis=1)
                m, b = m[norm > 0] / norm[norm > 0][:, None], b.loc[norm > 0]
                if not len(b):
                    continue
                number = np.arange(len(b)) + (0 if seen is None else len(seen))
                flag = b.pop("__p").to_numpy()
                seen = b.reset_index(drop=True) if seen is None else pd.concat([seen, b], ignore_index=True)
                step = max(1, TILE // len(m))
                for at in range(0, len(q), step):
                    d = np.round(1 - m @ q[at : at + step].T, 6) + 0.0  # no negative zero
                    for i, x in enumerate(best):
                        own = flag >> i & 1 == 1
                        if own.any():
                            x.add(at, d if own.all() else d[own], number if own.all() else number[own])
                if sum(x.held for x in best) > HELD + 2 * sum(x.k for x in best) * len(q):
                    prune()
            if seen is None:
                return
            prune()
            for i, x in enumerate(best):
                j, d, r = x.parts[0]
                for a in range(0, len(j), 50_000):
                    hit = seen.iloc[r[a : a + 50_000]][[id, *keep]].reset_index(drop=True)
                    hit.insert(0, "query_id", pd.Series(ids[j[a : a + 50_000]]))
                    hit.insert(1, "pass", i)
                    hit["distance"] = d[a : a + 50_000]
                    yield hit

        return run

    found, sent, ids, block = None, None, [], []

    def add():
        nonlocal found, sent
        if sent is not None:
            found = cut(found)
            sent.destroy()
        q = np.array(block, dtype=np.float64)
        n = np.linalg.norm(q, axis=1)
        sent = spark.sparkContext.broadcast((np.array(ids)[n > 0], q[n > 0] / n[n > 0][:, None]))
        part = rows.mapInPandas(search(sent), schema)
        found = part if found is None else found.unionByName(part)

    for r in queries.where(F.col(query_id).isNotNull() & F.col(vector).isNotNull()).select(query_id, vector).toLocalIterator():
        ids.append(r[0])
        block.append(r[1])
        if len(block) * len(r[1]) >= BLOCK:
            add()
            ids, block = [], []
    if block:
        add()
    if found is None:
        found = spark.createDataFrame([], schema)
    most = F.element_at(F.array(*map(F.lit, ks)), F.col("pass") + 1)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "pass").orderBy("distance", id)))
    return ranked.where(F.col("rank") <= most).select(F.col("query_id").alias(query_id), "pass", "rank", id, *keep, "distance")


def top_k(data: DataFrame, queries: DataFrame, k: int, id: str, vector: str, query_id: str = "query_id", keep: Sequence[str] = ()) -> DataFrame:
    """(query_id, rank, id, keep..., distance): the k nearest rows by cosine of every query, exactly; see nearest."""
    return nearest(data, queries, [(k, None)], id, vector, query_id, keep).drop("pass")


def multi_probe(data: DataFrame, probes: DataFrame, id: str, vector: str, broad: Column, strict: Column, k_strict: int = 14, k_broad: int = 8, keep: Sequence[str] = ()) -> DataFrame:
    """(id, keep..., probe, pass, rank, distance): hits of all probes, strict before broad, each id once (first probe, pass, rank wins)."""
    hits = nearest(data, probes, [(k_strict, strict), (k_broad, broad)], id, vector, "probe", keep)
    w = Window.partitionBy(id).orderBy("probe", "pass", "rank")
    return hits.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def hashed_embedding(df: DataFrame, text: Column, into: str = "embedding", dimensions: int = 256) -> DataFrame:
    """A deterministic offline embedding: signed hashed word counts, L2-normalised; for use where no model is at hand. Zeros for a text without words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    @F.pandas_udf("array<float>")
    def embed(hashes: pd.Series) -> pd.Series:
        def one(h):
            h = np.asarray(h, dtype=np.int64)
            v = np.bincount(h % dimensions, weights=1.0 - 2.0 * ((h >> 40) & 1), minlength=dimensions) if len(h) else np.zeros(dimensions)
            return (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)

        return hashes.map(one)

    return df.withColumn(into, embed(F.transform(words, lambda w: F.xxhash64(w))))


#: Rows that the coarse centroids are fitted on at most (the smallest digests of the ids, so the choice is the same every time).
MOST_FITTED = 20_000


def fit_centroids(data: DataFrame, id: str, vector: str, lists: int = 16, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Unit centroids of spherical k-means over a bounded sample; every row is indexed afterwards, whatever the sample."""
    sample = data.where(F.col(vector).isNotNull()).select(vector, F.xxhash64(id).alias("h")).orderBy("h").limit(MOST_FITTED).toPandas()
    if not len(sample):
        return np.empty((0, 0))
    m = np.stack(sample[vector].to_numpy()).astype(np.float64)
    m = m[np.linalg.norm(m, axis=1) > 0]
    m /= np.linalg.norm(m, axis=1)[:, None]
    c = m[np.random.default_rng(seed).choice(len(m), min(lists, len(m)), replace=False)]
    for _ in range(rounds):
        near = (m @ c.T).argmax(axis=1)
        c = np.stack([m[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None]
    return c


def indexed_top_k(data: DataFrame, queries: DataFrame, k: int, id: str, vector: str, centroids: np.ndarray, query_id: str = "query_id", probes: int = 12) -> DataFrame:
    """Approximate top_k by an inverted file: a query is compared with the rows of its `probes` nearest centroids only.

    Every row belongs to the list of its nearest centroid. Recall depends on how clustered the vectors are; the tests
    measure it against the exact search. Queries go to the data in blocks, one held at a time; the data are not shuffled.
    """
    from tessera.session import cut

    spark = data.sparkSession
    types = dict(data.dtypes)
    rows = data.where(F.col(id).isNotNull() & F.col(vector).isNotNull()).select(id, F.col(vector).cast("array<double>").alias("__v"))
    schema = f"query_id {dict(queries.dtypes)[query_id]}, `{id}` {types[id]}, distance double"

    def search(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q, asked, c = shared.value
            for b in batches:
                m = np.stack(b["__v"].to_numpy()) if len(b) else np.empty((0, c.shape[1]))
                norm = np.linalg.norm(m, axis=1)
                own, m = b[id].to_numpy()[norm > 0], m[norm > 0] / norm[norm > 0][:, None]
                home = (m @ c.T).argmax(axis=1) if len(m) else np.empty(0, dtype=int)
                for i in range(len(c)):
                    here, who = np.flatnonzero(home == i), np.flatnonzero(asked[:, i])
                    if not len(here) or not len(who):
                        continue
                    d = np.round(1 - m[here] @ q[who].T, 6) + 0.0
                    best = np.argsort(d, axis=0, kind="stable")[: min(k, len(here))]
                    yield pd.DataFrame({"query_id": np.repeat([ids[j] for j in who], len(best)), id: own[here][best.T.ravel()], "distance": np.take_along_axis(d, best, axis=0).T.ravel()})

        return run

    found, sent = None, None
    ids, block = [], []

    def add():
        nonlocal found, sent
        if sent is not None:
            found = cut(found)
            sent.destroy()
        q = np.array(block, dtype=np.float64)
        n = np.linalg.norm(q, axis=1)
        q = q[n > 0] / n[n > 0][:, None]
        near = np.argsort(-(q @ centroids.T), axis=1)[:, :probes]
        asked = np.zeros((len(q), len(centroids)), dtype=bool)
        np.put_along_axis(asked, near, True, axis=1)
        sent = spark.sparkContext.broadcast(([i for i, x in zip(ids, n) if x > 0], q, asked, centroids))
        part = rows.mapInPandas(search(sent), schema)
        found = part if found is None else found.unionByName(part)

    for r in queries.where(F.col(query_id).isNotNull() & F.col(vector).isNotNull()).select(query_id, vector).toLocalIterator():
        ids.append(r[0])
        block.append(r[1])
        if len(block) * len(r[1]) >= BLOCK:
            add()
            ids, block = [], []
    if block and len(centroids):
        add()
    if found is None:
        found = spark.createDataFrame([], schema)
    w = Window.partitionBy("query_id").orderBy("distance", id)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("query_id").alias(query_id), "rank", id, "distance")
