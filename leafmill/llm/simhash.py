"""SimHash near-dedup: tiled exact comparison of fingerprints with exclusive-or and bit counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.graph import components, local_components
from leafmill.llm.scratch import Table, give_back

RADIUS = 4
WORDS = 4
SEED = 42
QUARTERS = 4
TILE = 1024
BLOCK_ROWS = 131072
MIN_BLOCKS = 16


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of one text as an unsigned integer."""
    import xxhash

    found = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z and the six ASCII white spaces
    if not found:
        return 0
    runs = zip(*(found[k:] for k in range(words))) if len(found) > words else [found]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(x, seed) for x in map(b" ".join, runs)], dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """The fingerprint of hashes: the bits set in over half of them."""
    over = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        over += np.unpackbits(h[at : at + 65536].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * over > len(h), bitorder="little").view("<u8")[0])


def fingerprint_column(text, words: int = WORDS, seed: int = SEED):
    """A column of fingerprints, as signed 64-bit integers."""

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        prints = np.array([fingerprint(t, words, seed) for t in texts], dtype=np.uint64).view(np.int64)
        give_back()
        return pd.Series(prints)

    return of(text)


def _quarters(fp: str):
    return [F.bit_count(F.shiftrightunsigned(F.col(fp), 16 * k).bitwiseAND(0xFFFF)).cast("int") for k in range(QUARTERS)]


def _gap(low, high, low2, high2):
    """The least sum of differences of population counts between members of boxes (rows against rows)."""
    return np.maximum(0, np.maximum(low[:, None] - high2[None], low2[None] - high[:, None])).sum(-1)


def close_pairs(a: np.ndarray, b: np.ndarray | None, radius: int):
    """Yield arrays (i, j) of places of a and b (a against itself if b is None) within the radius, tile by tile.

    Both arrays are ordered by the population counts of their 16-bit quarters; a pair of tiles whose counts differ
    by more than the radius is skipped, as no fingerprints in it can be close enough.
    """

    def boxes(x):
        counts = np.bitwise_count(x.view("<u2").reshape(-1, QUARTERS)).astype(np.int16)
        cuts = np.arange(0, len(x), TILE)
        return np.minimum.reduceat(counts, cuts), np.maximum.reduceat(counts, cuts)

    same = b is None
    b = a if same else b
    if not len(a) or not len(b):
        return
    for ti, tj in np.argwhere(_gap(*boxes(a), *boxes(b)) <= radius):
        if same and tj < ti:
            continue
        x, y = a[ti * TILE : (ti + 1) * TILE], b[tj * TILE : (tj + 1) * TILE]
        for at in range(0, len(x), 256):
            i, j = np.nonzero(np.bitwise_count(x[at : at + 256, None] ^ y[None]) <= radius)
            i, j = i + (ti * TILE + at), j + tj * TILE
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j


def _spanning(fps: np.ndarray, split: int | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each fingerprint to the smallest one that it reaches inside this pair of blocks."""
    a, b = (fps, None) if split is None else (fps[:split], fps[split:])
    off = 0 if split is None else split
    label = np.arange(len(fps))
    for i, j in close_pairs(a, b, radius):
        i, j = label[i], label[j + off]
        new = i != j
        if new.any():
            used, at = np.unique(np.concatenate([i[new], j[new]]), return_inverse=True)
            half = len(at) // 2
            step = np.arange(len(fps))
            step[used] = used[local_components(len(used), at[:half], at[half:])]
            label = step[label]
    moved = np.nonzero(label != np.arange(len(fps)))[0]
    return fps[moved].view(np.int64), fps[label[moved]].view(np.int64)


def _dealt(nodes: DataFrame, radius: int) -> tuple[DataFrame, DataFrame] | None:
    """nodes (column fp) with their block, and rows (pair, block, side) of the pairs of blocks worth comparing; None of
    fewer than two nodes.

    The fingerprints are cut into blocks ordered by the population counts of their quarters. Only the number of
    fingerprints for each quarter count (17^4 at most) comes to the driver, which plans the blocks and the pairs.
    """
    spark = nodes.sparkSession
    quarters = _quarters("fp")
    cell = sum((q * 17 ** (QUARTERS - 1 - k) for k, q in enumerate(quarters)), F.lit(0)).cast("int")
    nodes = nodes.withColumn("cell", cell)
    counts = nodes.groupBy("cell").agg(F.count("*").alias("n")).toPandas().sort_values("cell", ignore_index=True)
    total = int(counts["n"].sum())
    if total < 2:
        return None
    n_blocks = max(min(MIN_BLOCKS, -(-total // 256)), -(-total // BLOCK_ROWS))
    rows = -(-total // n_blocks)
    before = counts["n"].cumsum() - counts["n"]
    cells = counts["cell"].to_numpy()
    parts = np.stack([cells // 17 ** (QUARTERS - 1 - k) % 17 for k in range(QUARTERS)], 1).astype(np.int16)
    first, last = (before // rows).to_numpy(), ((before + counts["n"] - 1) // rows).to_numpy()
    low, high = np.full((n_blocks, QUARTERS), 99, np.int16), np.full((n_blocks, QUARTERS), -99, np.int16)
    for p, x, y in zip(parts, first, last):
        low[x : y + 1], high[x : y + 1] = np.minimum(low[x : y + 1], p), np.maximum(high[x : y + 1], p)
    i, j = np.nonzero(np.triu(_gap(low, high, low, high) <= radius))
    number = np.arange(len(i))
    table = pd.concat([pd.DataFrame({"pair": number, "block": i, "side": 0}), pd.DataFrame({"pair": number, "block": j, "side": 1})[j != i]])
    plan = spark.createDataFrame(pd.DataFrame({"cell": cells, "before": before, "n": counts["n"]}), "cell int, before long, n long")
    placed = nodes.join(F.broadcast(plan), "cell").withColumn("block", F.floor((F.col("before") + F.pmod(F.xxhash64("fp"), F.col("n"))) / rows).cast("int"))
    return placed.drop("cell", "before", "n"), spark.createDataFrame(table, "pair int, block int, side int")


def _order(fps: np.ndarray) -> np.ndarray:
    """The order of fingerprints by the population counts of their quarters."""
    counts = np.bitwise_count(fps.view("<u2").reshape(-1, QUARTERS))
    return np.lexsort((fps, *counts.T[::-1]))


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(src, dst) between distinct fingerprints of nodes (column fp): enough links within the radius to connect
    all that are connected by such links. A task compares one pair of blocks and returns at most one link for each
    fingerprint.
    """
    dealt = _dealt(nodes.select("fp"), radius)
    if dealt is None:
        return nodes.sparkSession.createDataFrame([], "src long, dst long")
    placed, table = dealt

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "fps": [fps[_order(fps)].tobytes()]})

    blocks = Table(placed.groupBy("block").applyInPandas(pack, "block int, fps binary"), "fp-blocks").df

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [np.frombuffer(x, dtype="<u8") for x in pdf.sort_values("side")["fps"]]
        src, dst = _spanning(np.concatenate(sides), len(sides[0]) if len(sides) > 1 else None, radius)
        return pd.DataFrame({"src": src, "dst": dst})

    return blocks.join(F.broadcast(table), "block").groupBy("pair").applyInPandas(compare, "src long, dst long")


def closest(nodes: DataFrame, radius: int, ratio: float) -> DataFrame:
    """(src, dst), src below dst: each row of nodes (row, fp, size; rows from 0 on, below 2^56) with the smallest row within
    the radius and with the closest one, of equally close ones the smallest; of pairs whose sizes have the ratio at least.

    All pairs of fingerprints are compared, but a row leaves with two partners at most, so no group is expanded.
    """
    dealt = _dealt(nodes.select("row", "fp", "size"), radius)
    if dealt is None:
        return nodes.sparkSession.createDataFrame([], "src long, dst long")
    placed, table = dealt

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        by = _order(fps)
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "fps": [fps[by].tobytes()], "ids": [pdf["row"].to_numpy(np.int64)[by].tobytes()], "sizes": [pdf["size"].to_numpy(np.int64)[by].tobytes()]})

    blocks = Table(placed.groupBy("block").applyInPandas(pack, "block int, fps binary, ids binary, sizes binary"), "fp-blocks").df

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("side")
        sides = [np.frombuffer(x, "<u8") for x in pdf["fps"]]
        fps = np.concatenate(sides)
        ids, sizes = (np.concatenate([np.frombuffer(x, "<i8") for x in pdf[c]]) for c in ("ids", "sizes"))
        least, near = np.full((2, len(fps)), np.iinfo(np.int64).max)
        off = len(sides[0]) if len(sides) > 1 else 0
        for i, j in close_pairs(sides[0], sides[1] if off else None, radius):
            j = j + off
            fit = np.minimum(sizes[i], sizes[j]) >= ratio * np.maximum(sizes[i], sizes[j]) - 1e-9
            i, j = i[fit], j[fit]
            gap = np.bitwise_count(fps[i] ^ fps[j]).astype(np.int64) << 56
            for mine, other in ((i, j), (j, i)):
                np.minimum.at(least, mine, ids[other])
                np.minimum.at(near, mine, gap | ids[other])
        met = least < np.iinfo(np.int64).max
        give_back()
        return pd.DataFrame({"row": ids[met], "least": least[met], "near": near[met]})

    found = blocks.join(F.broadcast(table), "block").groupBy("pair").applyInPandas(compare, "row long, least long, near long")
    found = found.groupBy("row").agg(F.min("least").alias("least"), F.min("near").bitwiseAND((1 << 56) - 1).alias("near"))
    pairs = found.select("row", F.explode(F.array("least", "near")).alias("other"))
    return pairs.select(F.least("row", "other").alias("src"), F.greatest("row", "other").alias("dst")).distinct()


def classes(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, class_fp, class_id) for each distinct fingerprint of a table (doc_id, fp): the class of fingerprints
    that links within the radius connect, and its smallest doc_id."""
    nodes = Table(fingerprints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "fp-nodes").df
    found = components(links(nodes.select("fp"), radius))
    labelled = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "doc_id", F.coalesce("component", "fp").alias("class_fp"))
    least = labelled.groupBy("class_fp").agg(F.min("doc_id").alias("class_id"))
    return labelled.join(least, "class_fp").select("fp", "class_fp", "class_id")


def near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, class_fp, class_id) for every row of docs.

    A null text counts as empty; texts without words have fingerprint 0 and link with each other. A null id takes
    no part in the smallest id; a class of null ids has class_id null. Repeated rows stay.
    """
    prints = Table(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), words).alias("fp")), "fingerprints").df
    return prints.join(classes(prints, radius), "fp").select("doc_id", "fp", "class_fp", "class_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each class of near copies: one with the smallest id.

    Of several rows with that id in one class, any one stays; of a class of null ids, too. Columns stay as they are,
    whatever their names. A null text counts as empty; an empty table stays empty.
    """
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[id_col].alias("id"), fingerprint_column(docs[text_col], words).alias("fp")).withColumn("row", F.monotonically_increasing_id())
    prints = Table(packed, "printed").df
    found = classes(prints.select(F.col("id").alias("doc_id"), "fp"), radius)
    kept = prints.select("row", "id", "fp").join(found, "fp").filter(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("class_fp").agg(F.min("row").alias("row")).select("row")
    return prints.join(kept, "row").select("doc.*")
