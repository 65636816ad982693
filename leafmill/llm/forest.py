"""Nearest neighbours: a forest of random-projection trees searched through one priority queue, then exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.vectors import matrix, sizes, usable

TREES, DEPTH = 8, 6
INNER = 2**DEPTH
#: The trees are fitted on at most this many rows, those whose ids hash lowest; every row is then indexed.
SAMPLE = 20_000
#: A search goes on until its leaves hold this share of the rows, and this many for each neighbour asked for.
SHARE, FLOOR = 0.7, 10
#: A leaf of more rows is searched in several parts.
PART_ROWS = 20_000
SEED = 11


class Forest:
    """Trees of random hyperplanes at sample medians. Node k has children 2k and 2k + 1; leaves are numbered from 0.

    Of bounded size: TREES * 2^DEPTH planes and SAMPLE leaf numbers for each tree.
    """

    def __init__(self, sample: np.ndarray):
        rng = np.random.default_rng(SEED)
        inner = INNER
        self.planes = rng.normal(size=(TREES, inner, sample.shape[1]))
        self.planes /= np.linalg.norm(self.planes, axis=2, keepdims=True)
        self.cuts = np.zeros((TREES, inner))
        for t in range(TREES):
            groups = {1: np.arange(len(sample))}
            for k in range(1, inner):
                rows = groups.pop(k)
                along = sample[rows] @ self.planes[t, k]
                self.cuts[t, k] = np.median(along) if len(rows) else 0.0
                groups[2 * k], groups[2 * k + 1] = rows[along <= self.cuts[t, k]], rows[along > self.cuts[t, k]]
        self.sample_leaves = self.leaves(sample)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.empty((len(x), TREES), np.int16)
        for t in range(TREES):
            right = x @ self.planes[t].T > self.cuts[t]
            node = np.ones(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + right[np.arange(len(x)), node]
            out[:, t] = node - INNER
        return out

    def search(self, x: np.ndarray, share: float) -> list[tuple[int, int]]:
        """(tree, leaf) by how far the query is from them at most along the way down, nearest first over all trees,
        until they hold the share of the sample."""
        side = np.einsum("tkd,d->tk", self.planes, x) - self.cuts
        queue = [(0.0, t, 1) for t in range(TREES)]
        seen, found = np.zeros(len(self.sample_leaves), bool), []
        while queue and (share >= 1 or seen.sum() < share * len(seen)):
            far, t, k = heapq.heappop(queue)
            while k < INNER:
                right = side[t, k] > 0
                heapq.heappush(queue, (max(far, abs(side[t, k])), t, 2 * k + (not right)))
                k = 2 * k + int(right)
            found.append((t, k - INNER))
            seen |= self.sample_leaves[:, t] == k - INNER
        return found


def _nearest(x: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k rows nearest to the query, without rows of its own id; ties to the smaller id."""
    with np.errstate(over="ignore", invalid="ignore"):
        rough = np.einsum("ij,ij->i", x, x) - 2 * (x @ query)
    whole = bool(np.isfinite(rough).all())  # squares of huge components overflow; then all rows are measured exactly
    rough[ids == own] = np.inf
    if len(rough) > k and whole:
        slack = 1e-9 * (1 + query @ query + np.abs(rough[np.isfinite(rough)]).max(initial=0))
        at = np.nonzero(rough <= np.partition(rough, k - 1)[k - 1] + slack)[0]
    else:
        at = np.arange(len(rough))
    at = at[ids[at] != own]
    apart = x[at] - query
    most = np.abs(apart).max(axis=1, initial=0)
    scale = np.where((most > 1e150) & np.isfinite(most), most, 1.0)
    exact = scale * np.sqrt(((apart / scale[:, None]) ** 2).sum(1))
    order = np.lexsort((ids[at], exact))[:k]
    return ids[at][order], exact[order]


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found of each query row, by Euclidean distance in doubles.

    Every usable row is indexed: each tree sends it to a leaf. A query goes to the leaves that its search meets; a row
    is compared in the first tree that brings the two together only. Each leaf returns its k nearest by exact
    distance, and the k nearest of all leaves are the result, ties to the smaller id. Rows with null ids or vectors,
    zero and non-finite vectors take no part, others are candidates for queries of their size; rows with the query's
    own id are never found, and rows of one other id count once, by the nearest. Without rows or queries there is no
    result.
    """
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter("vec_id IS NOT NULL")
    found = None
    for size, total in sizes(named, "v").items():
        good = named.filter(usable(F.col("v")) & (F.size("v") == size)).select("vec_id", F.col("v").cast("array<double>").alias("v"), "asks")
        some = _search(good, total, k, share)
        found = some if found is None else found.union(some)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(good: DataFrame, total: int, k: int, share: float) -> DataFrame:
    """(query_id, vec_id, score) of the k nearest in each leaf that a query visits, of vectors of one size."""
    spark = good.sparkSession
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]
    forest = Forest(matrix(sample))
    shared = spark.sparkContext.broadcast(forest)
    wanted = max(share, FLOOR * k / total)
    counts = np.stack([np.bincount(forest.sample_leaves[:, t], minlength=INNER) for t in range(TREES)])
    parts = np.maximum(1, np.ceil(counts * (total / len(sample)) / PART_ROWS)).astype(np.int64)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, ids = matrix(pdf["v"]), pdf["vec_id"].to_numpy(np.int64)
                leaves, data = shared.value.leaves(x), [r.tobytes() for r in x]
                marks = [r.tobytes() for r in leaves]
                for t in range(TREES):
                    leaf = leaves[:, t].astype(np.int64)
                    yield pd.DataFrame({"tree": t, "leaf": leaf, "part": _mixed(ids) % parts[t, leaf], "vec_id": ids, "data": data, "leaves": marks})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for query, v in zip(pdf["vec_id"], pdf["v"]):
                x = np.array(v, dtype=np.float64)
                visits, data = shared.value.search(x, wanted), x.tobytes()
                met = np.zeros((TREES, INNER), bool)
                met[tuple(np.array(visits).T)] = True
                out += [(t, leaf, p, query, data, np.packbits(met).tobytes()) for t, leaf in visits for p in range(parts[t, leaf])]
            yield pd.DataFrame(out, columns=["tree", "leaf", "part", "vec_id", "data", "leaves"])

    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            x = np.frombuffer(b"".join(rows["data"]), np.float64).reshape(len(rows), -1)
            ids, tree = rows["vec_id"].to_numpy(np.int64), int(rows["tree"].iloc[0])
            leaves = np.frombuffer(b"".join(rows["leaves"]), np.int16).reshape(len(rows), TREES)
            for query, data, met in zip(queries["vec_id"], queries["data"], queries["leaves"]):
                met = np.unpackbits(np.frombuffer(met, np.uint8)).reshape(TREES, INNER).astype(bool)
                fresh = np.nonzero(~np.logical_or.reduce([met[t, leaves[:, t]] for t in range(tree)], initial=False) if tree else np.ones(len(ids), bool))[0]
                found, score = _nearest(x[fresh], ids[fresh], np.frombuffer(data, np.float64), query, k)
                out.append(pd.DataFrame({"query_id": query, "vec_id": found, "score": score}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    place = "tree int, leaf int, part int, vec_id long, data binary, leaves binary"
    keys = ["tree", "leaf", "part"]
    rows = good.mapInPandas(index, place)
    queries = good.filter("asks").mapInPandas(ask, place)
    return rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Ids as evenly spread numbers from 0."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(1)).astype(np.int64)
