"""Proportional stratified interleaving into shards.

Rows of each source are ranked in seeded-shuffled order; a row's fraction is its place in its source,
(2 * rank + 1) / (2 * rows of the source). Sorted by that fraction, every stretch of the result holds
the sources in their proportions, and cutting it evenly gives shards that match the mixture and whose
row counts differ by one at most.

Both sorts are distributed range sorts of narrow rows, so a source with a third of the rows spreads
over a third of the tasks. Null sources are one stratum. Equal rows get separate slots. Null texts are
empty: 0 bytes, crc32 0. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import dense_rank_rows

SHARDS = 40
SEED = 17
ROW_OVERHEAD = 16


def text_measures() -> list[Column]:
    data = F.coalesce("text", F.lit("")).cast("binary")
    return [(F.octet_length(data) + ROW_OVERHEAD).cast("bigint").alias("size"), F.crc32(data).alias("text_crc32")]


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, source, shard, slot) for every row of ``docs`` (doc_id, text, source)."""
    rows = docs.select("doc_id", "source", *text_measures())
    rows = rows.withColumn("_shuffle", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))
    ranked = dense_rank_rows(rows, ["source", "_shuffle", "doc_id", "text_crc32", "size"], "_at")
    strata = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    total = strata.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    strata = strata.withColumnRenamed("source", "_source")
    own = ranked.join(strata, F.col("source").eqNullSafe(F.col("_source")))
    own = own.withColumn("_share", (2 * (F.col("_at") - F.col("_first")) + 1) / (2 * F.col("_n")))
    placed = dense_rank_rows(own.drop("_source", "_n", "_first", "_shuffle"), ["_share", "source", "_at"], "_place")
    # Shard s holds the places p with floor(p * shards / total) = s; its first is ceil(s * total / shards).
    shard = F.expr(f"(_place * {shards}) div {max(1, total)}")
    first = F.expr(f"(bigint(shard) * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", "source", "shard", (F.col("_place") - first.cast("bigint")).alias("slot")
    )
