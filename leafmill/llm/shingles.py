"""Near copies by SimHash fingerprints of word shingles, completed by an exact set-similarity join; every link is verified on whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm import simhash
from leafmill.llm.graph import components
from leafmill.llm.scratch import Buckets, Table, give_back, partitions

WORDS = 5
SIMILARITY = 0.8
SEED = 42
#: Of 64 bits: sets at similarity 0.8 differ in 10 on average; within this radius are two in 100,000 unrelated pairs.
RADIUS = 14
#: Classes of shingle hashes of which it is counted how many texts have one; sent in pieces of CHUNK classes.
CLASSES, CHUNK = 1 << 20, 1 << 15


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hashes of a text's runs of words, distinct and ascending; a text of fewer words is one run."""
    import xxhash

    found = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z and the six ASCII white spaces
    if not found:
        return np.zeros(0, "<u8")
    runs = zip(*(found[k:] for k in range(words))) if len(found) > words else [found]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(x, SEED) for x in map(b" ".join, runs)], dtype="<u8"))


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two sets of distinct hashes is high enough."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _places(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """For each of CLASSES classes of hashes its place from the rarest on, 0 to 127: four steps for each doubling of
    the number of texts that have a shingle of the class. A fixed megabyte."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(CLASSES, np.int64)
        for pdf in batches:
            for t in pdf["text"]:
                np.add.at(seen, (shingles(t, words) % np.uint64(CLASSES)).astype(np.int64), 1)
            give_back()
        yield pd.DataFrame({"chunk": range(CLASSES // CHUNK), "counts": [seen[k : k + CHUNK].tobytes() for k in range(0, CLASSES, CHUNK)]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.sum([np.frombuffer(x, np.int64) for x in pdf["counts"]], axis=0)
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "places": [np.minimum(127, 4 * np.log2(np.maximum(counts, 1))).astype(np.uint8).tobytes()]})

    counted = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "chunk int, counts binary")
    rows = counted.groupBy("chunk").applyInPandas(total, "chunk int, places binary").orderBy("chunk").collect()
    return np.frombuffer(b"".join(bytes(r["places"]) for r in rows), np.uint8) if rows else np.zeros(CLASSES, np.uint8)


def prefix(hashes: np.ndarray, places: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """So many of the rarest shingles that two sets of the similarity share one: numbers with the place of a shingle's
    class on top and 56 bits of its hash below, ascending."""
    n = len(hashes)
    least = n - int(np.ceil(similarity * n - 1e-9)) + 1
    numbers = (places[(hashes % np.uint64(CLASSES)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (hashes >> np.uint64(8))
    return np.sort(np.partition(numbers, least - 1)[:least] if least < n else numbers).view(np.int64)


def _signed(docs: DataFrame, text: Column, places: np.ndarray, words: int, similarity: float) -> Column:
    """(key, n, fp, prefix): a digest of the set of shingles, its size, its fingerprint and its prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(places)

    @F.pandas_udf("key binary, n int, fp bigint, prefix array<bigint>")
    def of(texts: pd.Series) -> pd.DataFrame:
        import xxhash

        out = []
        for t in texts:
            s = shingles(t, words)
            fp = np.uint64(simhash.majority(s)).view(np.int64)
            out.append((xxhash.xxh128_digest(s.tobytes()), len(s), int(fp), prefix(s, shared.value, similarity)))
        give_back()
        return pd.DataFrame(out, columns=["key", "n", "fp", "prefix"])

    return of(text)


def _set_column(text: Column, words: int) -> Column:
    @F.pandas_udf(T.BinaryType())
    def of(texts: pd.Series) -> pd.Series:
        out = pd.Series([shingles(t, words).tobytes() for t in texts], dtype=object)
        give_back()
        return out

    return of(text)


def _at(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """texts of the given rows (column row); texts are in buckets by block and stay in place."""
    return texts.join(rows.withColumn("block", F.shiftrightunsigned("row", 33).cast("int")), ["block", "row"])


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (src, dst) of rows whose whole sets are similar enough; texts has columns block, row and text."""

    @F.pandas_udf(T.BooleanType())
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series([similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), similarity) for x, y in zip(a, b)], dtype=bool)
        give_back()
        return out

    wanted = pairs.select(F.col("src").alias("row")).union(pairs.select("dst")).distinct()
    sets = Table(_at(texts, wanted).select("row", _set_column(F.col("text"), words).alias("set")), "shingle-sets")
    mine, theirs = sets.df.select(F.col("row").alias("src"), F.col("set").alias("a")), sets.df.select(F.col("row").alias("dst"), F.col("set").alias("b"))
    found = Table(pairs.join(mine, "src").join(theirs, "dst").filter(alike("a", "b")).select("src", "dst"), "alike").df
    sets.drop()
    return found


def _possible(met: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) that can be so similar, of rows (src, n, at, dst, n2, at2) for each hash at which two
    prefixes meet.

    Of the two prefixes, all of the one that ends at the lower hash has been held against the other; so the sets share
    no more than the hashes counted and what lies beyond that prefix, or beyond the last hash shared in the other set.
    """
    most = met.filter(F.least("n", "n2") >= similarity * F.greatest("n", "n2") - 1e-9).groupBy("src", "dst").agg(
        F.first("n").alias("n"), F.first("n2").alias("n2"), F.max("at").alias("at"), F.max("at2").alias("at2"), F.count("*").alias("met")
    )
    beyond = lambda n: F.ceil(similarity * F.col(n) - 1e-9) - 1
    rest = F.greatest(F.least(beyond("n"), F.col("n2") - 1 - F.col("at2")), F.least(beyond("n2"), F.col("n") - 1 - F.col("at")))
    overlap = F.ceil((F.col("n") + F.col("n2")) * (similarity / (1 + similarity)) - 1e-9)
    return most.filter(F.col("met") + rest >= overlap).select("src", "dst")


def _grouped(rows: DataFrame, settled: DataFrame) -> DataFrame:
    """rows with the group that links settled connect them to."""
    return rows.join(components(settled).select(F.col("node").alias("row"), "component"), "row", "left").withColumn("group", F.coalesce("component", "row")).drop("component")


def links(firsts: DataFrame, texts: DataFrame, settled: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(src, dst): the links settled and more between rows of firsts (row, n, prefix; one of each set), that connect all
    that are connected by pairs similar enough.

    Sets that are so similar share one of their rarest shingles. At each of these, where not all are connected yet, all
    are first held against the earliest one, which connects most of a group of copies; then all pairs that are not
    connected yet are, so that a group isn't expanded into its pairs and none is missed. What many unrelated texts share
    is seldom among the rarest.
    """
    rows = _grouped(firsts.filter("n > 0"), settled).select("row", "n", "group", F.posexplode("prefix").alias("at", "token"))
    heads = rows.groupBy("token").agg(F.min(F.struct("row", "n", "at", "group")).alias("first"), F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high").drop("low", "high")
    shared = Table(rows.join(heads, "token"), "shared-shingles").df
    pair = lambda x, y: [F.col(f"{x}row").alias("src"), F.col(f"{x}n").alias("n"), F.col(f"{x}at").alias("at"), F.col(f"{y}row").alias("dst"), F.col(f"{y}n").alias("n2"), F.col(f"{y}at").alias("at2")]
    star = Table(_possible(shared.filter(F.col("group") != F.col("first.group")).select(*pair("first.", "")), similarity), "shingle-pairs").df
    settled = settled.union(_verified(star, texts, words, similarity))
    joined = _grouped(shared.drop("first", "group"), settled)
    apart = joined.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high").select("token")
    mixed = Table(joined.join(apart, "token"), "unsettled-shingles").df
    met = (F.col("x.token") == F.col("y.token")) & (F.col("x.row") < F.col("y.row")) & (F.col("x.group") != F.col("y.group"))
    left = _possible(mixed.alias("x").join(mixed.alias("y"), met).select(*pair("x.", "y.")), similarity)
    left = Table(left.join(star, ["src", "dst"], "left_anti"), "shingle-pairs").df
    return settled.union(_verified(left, texts, words, similarity))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each class of near copies: one with the smallest id.

    Near copies are texts whose sets of word shingles have the Jaccard similarity at least, and all that such pairs
    connect; texts with equal sets, such as those without words, are copies. Of several rows with that id in one
    class, any one stays; of a class of null ids, too. Columns stay as they are.

    SimHash fingerprints within the radius name the pairs, which are verified on whole sets; what fingerprints miss, as
    they are a sample of bits, the exact join between the groups found so far adds.

    Documents are written once, in buckets by the partition that they were read in, so that their texts are never
    shuffled; the numbers of their rarest shingles are.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # joins by block and row use the buckets
    places = _places(docs, text_col, words)
    given = docs.select(F.struct(*docs.columns).alias("doc"), docs[id_col].alias("id"), docs[text_col].alias("text")).withColumn("row", F.monotonically_increasing_id())
    given = given.withColumn("block", F.shiftrightunsigned("row", 33).cast("int")).withColumn("s", _signed(docs, F.col("text"), places, words, similarity)).drop("text")
    signed = Buckets(given, "shingled", partitions(spark), "block", shuffle=False).df
    sets = Table(signed.groupBy("s.key").agg(F.min("row").alias("first"), F.min("id").alias("least"), F.min("s.n").alias("n"), F.min("s.fp").alias("fp")), "shingle-keys").df
    prefixes = _at(signed.select("block", "row", "s.n", "s.prefix"), sets.select(F.col("first").alias("row")))
    texts = signed.select("block", "row", F.col("doc")[text_col].alias("text"))
    close = Table(simhash.closest(sets.filter("n > 0").select(F.col("first").alias("row"), "fp", F.col("n").alias("size")), radius, similarity), "fp-pairs").df
    settled = _verified(close, texts, words, similarity)
    found = components(links(prefixes, texts, settled, words, similarity))
    labelled = Table(sets.join(found, F.col("first") == F.col("node"), "left").select("key", "least", F.coalesce("component", "first").alias("class")), "shingle-classes").df
    least = labelled.groupBy("class").agg(F.min("least").alias("class_id"))
    classes = labelled.select("key", "class").join(least, "class")
    rows = signed.select("row", "id", F.col("s.key").alias("key"))
    kept = rows.join(classes, "key").filter(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("class").agg(F.min("row").alias("row")).select("row")
    return _at(signed.select("block", "row", "doc"), kept).select("doc.*")
