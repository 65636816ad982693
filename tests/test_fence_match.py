"""The band join of rules and fences, against a plain walk, and what it compares whole texts for."""

import random

from pyspark.sql import functions as F

from leafmill.functions import markdown
from leafmill.operators import refine


def _norm(text):
    return " ".join(text.lower().split())


def _expected(rules, fences):
    out = set()
    for post, check, index, content in rules:
        near = sorted((i for p, i, _ in fences if p == post and abs(i - index) <= 2), key=lambda i: (abs(i - index), i < index))
        of = {i: _norm(c) for p, i, c in fences if p == post}
        sample = _norm(content)
        same = [i for i in near if of[i] == sample] or [i for i in near if refine._alike(of[i][: len(sample)], sample) >= refine.ALIKE]
        out.add((post, check, index, same[0] if same else None))
    return out


def test_rules_with_and_without_their_fingerprint(spark):
    rng = random.Random(3)
    texts = ["int a = 1;", "INT  a = 1;", "int a = 2;", "select x from y", "select x from z", "", "end"]
    fences = [(p, i, rng.choice(texts)) for p in range(40) for i in range(6)]
    rules = [(p, c, i, rng.choice(texts)) for p in range(41) for i in range(8) for c in ("prose_in_code", None)]
    f = spark.createDataFrame(fences, "post long, idx int, content string").withColumn("fingerprint", markdown.fingerprint(F.col("content")))
    r = spark.createDataFrame(rules, "post long, check string, fence_index int, content_sample string").withColumn("fingerprint", markdown.fingerprint(F.col("content_sample")))
    got = [tuple(x) for x in refine.match(r, f).collect()]
    assert len(got) == len(set(got)) == len(rules) and set(got) == _expected(rules, fences)


def test_whole_texts_are_not_joined_to_whole_texts_before_fingerprints(spark):
    """Rules that a fingerprint answers compare no texts: a similarity that raises is never reached."""
    f = spark.createDataFrame([(p, i, f"fence {p} {i}") for p in range(3) for i in range(4)], "post long, idx int, content string").withColumn("fingerprint", markdown.fingerprint(F.col("content")))
    r = f.select("post", F.lit("language_tag_missing").alias("check"), F.col("idx").alias("fence_index"), "fingerprint", F.col("content").alias("content_sample"))
    before = markdown.similarity
    markdown.similarity = lambda a, b: F.raise_error(F.concat(F.lit("compared "), a, b)).cast("double")
    try:
        assert {(x["post"], x["fence_index"], x["idx"]) for x in refine.match(r, f).collect()} == {(p, i, i) for p in range(3) for i in range(4)}
    finally:
        markdown.similarity = before
