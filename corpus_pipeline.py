"""The corpus pipeline: toxic documents go, repeated lines go, near copies go, sources are mixed, texts become tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bpe, lines, mixing, shingles, toxicity
from leafmill.llm.scratch import Table

REJECT = 0.5
SHINGLE_WORDS, SIMILARITY, FINGERPRINT_BITS = 5, 0.8, 14
RANKS = "byte_bpe_50k.tiktoken"


def _with_text(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The columns of docs from found, with n_chars as long as the new text."""
    return found.select(*[F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under REJECT, learnt from the labels outside the held-out fifth; null and
    empty texts are scored as texts without words, without labels all stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.score_column(spark, model, docs["text"]) < REJECT)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier one; a document of which none is left stays, empty."""
    return _with_text(docs, lines.dedup(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id.

    Near copies share SIMILARITY of their shingles. SimHash fingerprints at most FINGERPRINT_BITS apart link them, each
    link verified on whole sets; as fingerprints don't find all of them, an exact join of the sets adds the rest.
    """
    return shingles.keep_first(docs, words=SHINGLE_WORDS, similarity=SIMILARITY, radius=FINGERPRINT_BITS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): token ids as little-endian 32-bit integers and the text decoded from them; other
    columns go. A null text counts as empty, repeated rows stay, an empty table gives none."""
    import public_tokenizers

    ranks = public_tokenizers.path(RANKS)
    coded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.col("bytes").cast("string").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level bpe", encode_and_decode),
]

#: SQL has no zstandard, no fingerprints by majority and no byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = Table(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}").df
    return STAGES[-1][1](spark, docs, sf_dir)
