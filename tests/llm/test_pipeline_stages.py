"""The pipeline's middle stages against plain Python versions, on the smallest documents."""

import re

import corpus_pipeline
from test_near_copies import first_ids

FOLDER = "/root/testdata/sf0.001"


def plain_lines(rows):
    """Texts by id without the lines that match an earlier line at Jaccard 0.8 of their words."""
    seen, out = [], {}
    for doc_id, text in sorted(rows):
        left = []
        for line in text.split("\n"):
            words = set(re.findall(r"[^\x20\x09-\x0D]+", line))
            if not words or not any(4 * max(len(words), len(s)) <= 5 * min(len(words), len(s)) and 10 * len(words & s) >= 8 * len(words | s) for s in seen):
                left.append(line)
            if words:
                seen.append(words)
        out[doc_id] = "\n".join(left)
    return out


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len({k for k, _ in rows}) == len(rows) and all(t is not None for _, t in rows)
    got = corpus_pipeline.drop_repeated_lines(spark, docs, FOLDER).collect()
    want = plain_lines(rows)
    assert {r["doc_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)
    lined = spark.createDataFrame(got, docs.schema)
    for given, texts in ((lined, sorted(want.items())), (docs, rows)):
        left = corpus_pipeline.drop_near_copies(spark, given, FOLDER).collect()
        assert sorted(r["doc_id"] for r in left) == first_ids(texts) and {(r["doc_id"], r["text"]) for r in left} <= set(texts)
    toxic = corpus_pipeline.drop_toxic(spark, docs, FOLDER).collect()
    assert {(r["doc_id"], r["text"]) for r in toxic} <= set(rows)
