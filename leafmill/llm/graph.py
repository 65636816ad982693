"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.scratch import Table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge to another one.

    Each step keeps at most as many edges as it was given and ends as stars around the smallest nodes. A hot node
    meets only partial aggregates and plain equi-joins, which adaptive execution can split. Loops and null ends
    are ignored; no edges give no rows.
    """
    now = Table(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u > v").distinct(), "edges")
    seen = None
    while True:
        row = now.df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        mark = (row["n"], row["h"])
        if mark == seen or not row["n"]:
            return now.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark
        after = Table(_small_star(_large_star(now.df)), "edges")
        now.drop()
        now = after


def local_components(n: int, i, j):
    """Labels 0..n-1, in numpy: each node's smallest reachable one over the links i-j."""
    import numpy as np

    label = np.arange(n)
    while True:
        a, b = label[i], label[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low < high
        if not open_.any():
            return label
        np.minimum.at(label, high[open_], low[open_])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
