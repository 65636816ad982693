"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.scratch import Table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
UNIT = 2**32


def _sources(docs: DataFrame) -> DataFrame:
    """One row per source: its size and its 0-based place by code point, null last.

    The place comes from a range sort and the row counts of the sorted partitions, so no task holds all sources.
    """
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = (
        sums.orderBy(F.col("source").asc_nulls_last())
        .withColumn("pid", F.spark_partition_id())
        .withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    table = Table(ordered, "mix-sources").df
    counts = table.groupBy("pid").agg(F.count("*").alias("n"))
    before = counts.alias("a").join(F.broadcast(counts.alias("b")), F.col("b.pid") < F.col("a.pid"), "left").groupBy("a.pid").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return table.join(before, "pid").select("source", "source_size", (F.col("before") + F.col("at")).alias("place"))


def source_targets(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) for docs with columns source and size.

    Sources take the weights in turn by code point, null last, and share the sum of all sizes by weight. A target
    stops at max_repeats times its source's size; the excess is shared anew by weight among the others until no
    target is above its limit. A source of size 0 has target 0. An empty table has no sources.
    """
    places = _sources(docs)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = places.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * max_repeats).alias("cap"))
    total = table.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    full, level = -1, 0.0
    while True:  # only sums reach the driver
        above = F.col("cap") <= F.col("weight") * F.lit(level) if full >= 0 else F.lit(False)
        row = table.agg(
            F.sum(F.when(above, F.col("cap")).otherwise(0)).alias("caps"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weights"),
            F.sum(F.when(above, 1).otherwise(0)).alias("full"),
        ).first()
        if not row["weights"] or row["full"] == full:
            break
        full, level = row["full"], (total - row["caps"]) / row["weights"]
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level)))
    return table.select("source", "source_size", target.alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """How many copies of each document the mix takes: (doc_id, source, size, source_size, target, copies).

    Size is the number of words in the text; a null text has size 0, and so has an empty one. Each document is
    taken floor(rate) times, rate = target / source_size, and once more if a number from the MD5 of seed and id is
    below the fraction. Rows with one id (or a null id) draw the same number, so reruns agree. A source of size 0
    has rate 0.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    targets = source_targets(sized, weights, max_repeats).withColumnRenamed("source", "mix_source")
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("mix_source")))
    return joined.select("doc_id", "source", "size", "source_size", "target", _copies(F.col("doc_id"), seed, max_repeats).alias("copies"))


def _copies(doc_id: Column, seed: str, max_repeats: int) -> Column:
    """floor(rate), and one more if the number drawn for the id is below the fraction; of columns source_size, target."""
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_repeats)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / UNIT
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mixed corpus: each row of docs, with all its columns whatever their names, as many times as plan() takes it.

    A null text has size 0 and is taken at its source's rate, as an empty one is; a null source is a source, the last.
    Repeated rows and rows of one id are taken equally often; an empty table stays empty.
    """
    size = F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long")
    targets = source_targets(docs.select(docs[source_col].alias("source"), size.alias("size")), weights, max_repeats).withColumnRenamed("source", "mix_source")
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[id_col].alias("id"), docs[source_col].alias("source"))
    joined = packed.join(targets, F.col("source").eqNullSafe(F.col("mix_source")))
    return joined.select("doc", F.explode(F.array_repeat(F.lit(1), _copies(F.col("id"), seed, max_repeats).cast("int")))).select("doc.*")


PLAN_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, 3 * source_size AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM sums
), filled AS (
  SELECT cap, weight, cap::DOUBLE / weight AS ratio, source,
         ((SELECT sum(source_size) FROM sums)::BIGINT - coalesce(sum(cap) OVER w, 0)::BIGINT)
         / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS l
  FROM ranked WINDOW w AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT coalesce((SELECT l FROM filled WHERE cap > weight * l ORDER BY ratio, source NULLS LAST LIMIT 1), 0.0) AS l
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * l) AS target FROM ranked, level
), rated AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""
