"""The pipeline's near copies go through SimHash fingerprints; the exact join adds what these miss."""

import random

import numpy as np

import corpus_pipeline
from leafmill.llm import shingles, simhash
from test_near_copies import SCHEMA, first_ids


def made():
    rng = random.Random(9)
    rows = []
    for k in range(60):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([60, 200, 600]))]
        copy = list(base)
        for at in rng.sample(range(len(base)), max(1, len(base) // 100)):
            copy[at] = "edited"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    return rows


def test_fingerprints_link_near_copies(spark, monkeypatch):
    rows = made()
    docs = spark.createDataFrame([(k, t, "x", "s", len(t)) for k, t in rows], SCHEMA).repartition(3)
    monkeypatch.setattr(shingles, "links", lambda firsts, texts, settled, *a: settled)  # fingerprints alone
    left = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    want = set(first_ids(rows))
    assert left >= want and len(left - want) <= 3


def test_the_join_adds_what_fingerprints_miss(spark):
    rows = made()
    docs = spark.createDataFrame([(k, t, "x", "s", len(t)) for k, t in rows], SCHEMA).repartition(3)
    assert sorted(r["doc_id"] for r in shingles.keep_first(docs, radius=0).collect()) == first_ids(rows)


def test_closest_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    fps[100:200] = fps[:100] ^ (np.uint64(1) << rng.integers(0, 63, 100).astype(np.uint64))
    fps[200:220] = fps[0]
    sizes = rng.choice([50, 60, 100], 300)
    want = set()
    for k in range(300):
        gaps = np.bitwise_count(fps ^ fps[k])
        near = [(int(gaps[x]), x) for x in range(300) if x != k and gaps[x] <= 12 and 10 * min(sizes[k], sizes[x]) >= 8 * max(sizes[k], sizes[x])]
        want |= {(min(k, x), max(k, x)) for x in (min(y for _, y in near), min(near)[1])} if near else set()
    df = spark.createDataFrame([(k, int(f), int(sizes[k])) for k, f in enumerate(fps.view(np.int64))], "row long, fp long, size int")
    assert {tuple(r) for r in simhash.closest(df, 12, 0.8).collect()} == want and want
    assert simhash.closest(df.limit(1), 12, 0.8).count() == 0
