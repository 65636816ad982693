"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bpe, collisions, extraction, forest, lines, mixing, simhash, suffixes, toxicity, urls

RANKS = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of near copies of each document."""
    found = simhash.near_dups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("class_id").alias("component_id"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of each page's URL."""
    return urls.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    found = extraction.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of each vector."""
    return collisions.near_dups(_table(spark, sf_dir, "embeddings"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of each row whose id is divisible by 100."""
    return forest.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    taken = mixing.plan(_table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each text's token ids and of the bytes decoded from them."""
    import public_tokenizers

    ranks = public_tokenizers.path(RANKS)
    coded = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and removed lines of each document, and the digest of what is left."""
    left = lines.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document, learnt outside the held-out fifth."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), toxicity.score_column(spark, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed of each document, and the digest of the bytes left."""
    found = suffixes.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_dedup": op1_simhash_near_dedup,
        "op2_url_filters": op2_url_filters,
        "op3_html_extraction": op3_html_extraction,
        "op4_embedding_near_dedup": op4_embedding_near_dedup,
        "op5_nearest_neighbours": op5_nearest_neighbours,
        "op6_mix_sources": op6_mix_sources,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_line_dedup": op8_line_dedup,
        "op9_toxicity": op9_toxicity,
        "op10_suffix_array_dedup": op10_suffix_array_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": urls.JUDGE_SQL, "op4_embedding_near_dedup": collisions.NEAR_DUPS_SQL, "op6_mix_sources": mixing.PLAN_SQL}
