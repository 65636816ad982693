"""Embedding near-dedup by collision counting over many one-dimensional projections."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.graph import components, local_components
from leafmill.llm.scratch import Table
from leafmill.llm.vectors import matrix, sizes, unit, usable

COSINE = 0.9
PROJECTIONS = 48
#: Half the width of a window, in standard deviations of the projected difference of a pair just at the threshold.
WIDTH = 1.5
#: The chance that a pair just at the threshold collides too seldom to be verified.
MISS = 1e-7
SEED = 7
TILE = 1024
BLOCK_ROWS, MIN_BLOCKS = 16384, 16


def calibrated(cosine: float, projections: int, width: float, miss: float) -> tuple[float, int]:
    """The window's half width on unit vectors, and the most collisions that can be asked for with such a chance of
    missing a pair at the threshold (closer pairs collide more often)."""
    hit = math.erf(width / math.sqrt(2))
    below, count = 0.0, 0
    while count < projections:
        below += math.comb(projections, count) * hit**count * (1 - hit) ** (projections - count)
        if below > miss:
            break
        count += 1
    return width * math.sqrt(2 - 2 * cosine), count


def _near_pairs(a: np.ndarray, b: np.ndarray, same: bool, cosine: float):
    """Yield (i, j) of rows of a and b at the cosine or above (i < j if same), tile by tile."""
    half, least = calibrated(cosine, PROJECTIONS, WIDTH, MISS)
    rng = np.random.default_rng(SEED)
    lines = rng.normal(size=(a.shape[1], PROJECTIONS))
    ua = unit(a)
    ub = ua if a is b else unit(b)
    pa, pb = ua @ lines, ub @ lines
    step = 32.0  # a window's ends are moved outwards by what rounding may take
    width = np.uint8(min(127, math.ceil(half * step) + 1))
    qa, qb = (np.ascontiguousarray(np.clip(np.rint(p * step), -127, 127).astype(np.int8).view(np.uint8).T) for p in (pa, pb))
    bounds = [[(p[t : t + TILE].min(0), p[t : t + TILE].max(0)) for t in range(0, len(p), TILE)] for p in (pa, pb)]
    for ti, (low, high) in enumerate(bounds[0]):
        s = slice(ti * TILE, (ti + 1) * TILE)
        for tj, (low2, high2) in enumerate(bounds[1]):
            if (same and tj < ti) or np.sum((low - high2 <= half) & (low2 - high <= half)) < least:
                continue
            t = slice(tj * TILE, (tj + 1) * TILE)
            count = np.zeros((len(ua[s]), len(ub[t])), np.uint8)
            for x, y in zip(qa[:, s], qb[:, t]):
                count += (x[:, None] - y[None] + width) <= 2 * width
            i, j = np.nonzero(count >= least)
            parts = [np.einsum("ij,ij->i", ua[s][i[k : k + TILE]], ub[t][j[k : k + TILE]]) for k in range(0, len(i), TILE)]
            near = np.concatenate([np.empty(0), *parts]) >= cosine
            i, j = i[near], j[near]
            i, j = i + s.start, j + t.start
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j


def pair_links(a: np.ndarray, b: np.ndarray | None, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """For the rows of a and then b: how many links each has between the two (within a if b is None), and the place
    of the first row that links connect it to."""
    same, off = b is None, 0 if b is None else len(a)
    n = len(a) + (0 if same else len(b))
    links, label = np.zeros(n, np.int64), np.arange(n)
    for i, j in _near_pairs(a, a if same else b, same, cosine):
        j = j + off
        links += np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
        i, j = label[i], label[j]
        new = i != j
        if new.any():
            used, at = np.unique(np.concatenate([i[new], j[new]]), return_inverse=True)
            half = len(at) // 2
            step = np.arange(n)
            step[used] = used[local_components(len(used), at[:half], at[half:])]
            label = step[label]
    return links, label


def _links(good: DataFrame, size: int, total: int, cosine: float) -> DataFrame:
    """(row, links, root) for each pair of blocks of vectors (row, v) of one size, for each row with links there."""
    n_blocks = max(min(MIN_BLOCKS, -(-total // 256)), -(-total // BLOCK_ROWS), 1)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "ids": [pdf["row"].to_numpy(np.int64).tobytes()], "data": [matrix(pdf["v"]).tobytes()]})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("side")
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["ids"]])
        sides = [np.frombuffer(x, np.float64).reshape(-1, size) for x in pdf["data"]]
        links, label = pair_links(sides[0], sides[1] if len(sides) > 1 else None, cosine)
        at = np.nonzero(links)[0]
        return pd.DataFrame({"row": ids[at], "links": links[at], "root": ids[label[at]]})

    packed = good.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int")).groupBy("block").applyInPandas(pack, "block int, ids binary, data binary")
    other = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    paired = other.select((F.least("block", "other").cast("long") * n_blocks + F.greatest("block", "other")).alias("pair"), (F.col("block") > F.col("other")).cast("int").alias("side"), "ids", "data")
    return paired.groupBy("pair").applyInPandas(compare, "row long, links long, root long")


def near_dups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Unit vectors are projected on random lines; a pair is verified by its exact cosine in doubles if it shares as
    many windows, each centred on one of the two, as a pair at the threshold misses with a chance of MISS only.
    Rows are dealt at random to blocks; a task takes a pair of blocks and returns, for each row with links there,
    their number and one row that it is connected to. Null, zero and non-finite vectors link with nothing, others
    with those of their size. Rows with one id, or with null ids, stay rows of their own; a component of
    null ids only has a null id and is kept.
    """
    rows = Table(vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).withColumn("row", F.monotonically_increasing_id()), "vectors").df
    found = None
    for size, total in sizes(rows, "v").items():
        good = rows.filter(usable(F.col("v")) & (F.size("v") == size)).select("row", F.col("v").cast("array<double>").alias("v"))
        linked = _links(good, size, total, cosine)
        found = linked if found is None else found.union(linked)
    found = Table(found if found is not None else rows.sparkSession.createDataFrame([], "row long, links long, root long"), "vector-links").df
    links = found.groupBy("row").agg(F.sum("links").alias("n_links")).withColumnRenamed("row", "linked")
    parts = components(found, "row", "root")
    table = (
        rows.select("row", "vec_id").join(links, F.col("row") == F.col("linked"), "left").join(parts, F.col("row") == F.col("node"), "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "row").alias("part"))
    )
    least = table.groupBy("part").agg(F.min("vec_id").alias("component_id"))
    return table.join(least, "part").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


NEAR_DUPS_SQL = """
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS v FROM embeddings
), good AS (
  SELECT row, v, sqrt(list_dot_product(v, v)) AS size FROM rows
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.row AS a, b.row AS b FROM good a JOIN good b ON a.row <> b.row AND len(a.v) = len(b.v) AND CASE WHEN len(a.v) = len(b.v) THEN list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.9 ELSE false END
), reach(a, b) AS (
  SELECT row, row FROM rows UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
  SELECT reach.a AS row, min(vec_id) AS component_id FROM reach JOIN rows ON rows.row = reach.b GROUP BY 1
)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = rows.row)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM rows JOIN least USING (row)
"""
