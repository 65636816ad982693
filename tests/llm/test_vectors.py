"""Vectors of several sizes, huge components, pairs near the threshold and more blocks than usual."""

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import collisions, forest

SCHEMA = "vec_id long, embedding array<double>"


def test_links_within_each_size_and_at_the_threshold(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k, list(map(float, rng.normal(size=24)))) for k in range(300)]
    for k, cosine in enumerate((0.89, 0.899, 0.901, 0.91, 0.95)):  # planted beside the threshold
        a = np.array(rows[k][1]) / np.linalg.norm(rows[k][1])
        b = rng.normal(size=24)
        b -= (a @ b) * a
        rows.append((1000 + k, list(map(float, cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b)))))
    rows += [(2000, [1.0, 2.0]), (2001, [1.0, 2.0]), (2002, [2.0, -1.0]), (3000, [1e200, -1e200, 3.0]), (3001, [1e200, -1e200, 2.0]), (3002, [1e-200, 0.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(collisions, "BLOCK_ROWS", 10)  # many blocks
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in collisions.near_dups(df).collect()}
    assert {k for k, r in got.items() if r[0]} == {2, 3, 4, 1002, 1003, 1004, 2000, 2001, 3000, 3001}
    assert got[1003] == (1, 3, False) and got[2001] == (1, 2000, False) and got[3001] == (1, 3000, False) and got[3002] == (0, 3002, True)


def test_neighbours_within_each_size(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 0.0, 1e200]), (1, [1.0, 1.0]), (2, [1.0, -1.0]), (3, [0.0, 0.0, -1e200]), (4, [0.0, 3.0, 1e200]), (200, [5.0])]
    got = [tuple(r) for r in forest.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (100, 1, 4, 3.0), (100, 2, 3, 2e200)]


def test_ties_go_to_smaller_ids_in_a_partial_search(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 8))
    x[1:60] = x[0]
    got = [tuple(r) for r in forest.nearest(spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(x)], SCHEMA), F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, k, k, 0.0) for k in range(1, 11)]
