"""Shards of contexts: memory that stays bounded when a part grows, and the merge over several ranges of strings."""

import tracemalloc

import numpy as np

from leafmill.llm import suffixes


def made(rng, n, size):
    """Contexts of one length, each tenth a copy of part of the first ones, and ids."""
    raw = rng.integers(97, 123, (n, size)).astype(np.uint8)
    raw[::10, :60] = raw[rng.integers(0, 5, len(raw[::10])), :60]
    return [x.tobytes() for x in raw], rng.permutation(n).astype(np.int64)


def test_memory_of_large_parts():
    contexts, ids = made(np.random.default_rng(3), 120_000, 70)
    suffixes.least_ids(contexts[:10], ids[:10])
    tracemalloc.start()
    try:
        suffixes.least_ids(contexts, ids)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40 * sum(map(len, contexts))


def test_merge_in_ranges():
    contexts, ids = made(np.random.default_rng(4), 400, 75)
    contexts += [b"\0" * 60, b"\0" * 59 + b"a", b"\xff" * 70]
    ids = np.append(ids, [5, 3, suffixes.NO_ID])
    least = {}
    for c, i in zip(contexts, ids.tolist()):
        for p in range(len(c) - 49):
            least[c[p : p + 50]] = min(i, least.get(c[p : p + 50], i))
    want = [least[c[p : p + 50]] for c in contexts for p in range(len(c) - 49)]
    done = [suffixes._shard(contexts[a : a + 40], ids[a : a + 40]) for a in range(0, len(contexts), 40)]
    suffixes._merge(done, strings=300)
    assert np.concatenate([low[kind] for kind, low, _, _ in done]).tolist() == want
    assert suffixes.least_ids(contexts, ids, 1000).tolist() == suffixes.least_ids(contexts, ids).tolist() == want
