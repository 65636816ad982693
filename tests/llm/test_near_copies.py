"""The pipeline's near copies against brute force over whole sets of shingles."""

import random
import re

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def first_ids(rows):
    """The smallest id of each class of (id, text) that pairs at Jaccard 0.8 or more connect."""
    sets = [shingle_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    classes = {}
    for k, (doc_id, _) in enumerate(rows):
        classes.setdefault(find(k), []).append(doc_id)
    return sorted(min(ids) for ids in classes.values())


def test_near_copies_by_shingles(spark):
    rng = random.Random(5)
    texts = []
    for n in (12, 40, 100, 400, 1000, 3000):
        for edits in (0, 1, 2, 4, 8, 15, 25, 45):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)]
            copy = list(base)
            for at in rng.sample(range(n), min(n, edits)):
                copy[at] = "Edited"
            texts += [" ".join(base), "\t".join(copy).upper()]
    chain = [f"c{k}" for k in range(200)]
    texts += [" ".join(chain[k : k + 160]) for k in range(0, 40, 8)]  # ends meet only through the middle
    texts += ["a b c d", "A b c d", "a b c", "a b c d e", "", None, " \n", texts[0]]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(k, t, "x", "s", len(t or "")) for k, t in rows], SCHEMA).repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == first_ids(rows)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0
