"""Structured Streaming load of arriving record files, and index refresh for what they add."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from corvane.plans.index import build_index
from corvane.plans.ingest import load_batch
from corvane.plans.search import Index
from corvane.plans.store import compact_index, index_versions, manifest, read_index, refresh_index, write_index
from corvane.session import materialise
from corvane.sources.repositories import scan_position, typed_lists, with_order
from corvane.sources.schemas import STORED_SCHEMA, TEXT_SCHEMA


def stream_load(checkpoint: str, batch_id: int) -> str:
    """The load id of a micro-batch: its checkpoint names the stream, across restarts too."""
    return f"stream-{hashlib.sha256(checkpoint.rstrip('/').encode()).hexdigest()[:12]}-{batch_id}"


def stream_ingest(
    spark: SparkSession, source: str, path: str, checkpoint: str, files_per_batch: int | None = None
) -> StreamingQuery:
    """Load every file that has arrived since the last run, each key once, then stop.

    Stored keys live in the key table, not in streaming state, which would grow without bound; a small
    micro-batch reads the buckets of its own keys. Every
    micro-batch owns a folder named by the stream's checkpoint and the batch and compares with all
    the others, so a replay after a crash rebuilds the same rows, and batch loads and other streams
    into the same table are never replaced.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        load_batch(typed_lists(with_order(batch)), path, stream_load(checkpoint, batch_id))

    reader = spark.readStream.schema(TEXT_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    records = reader.json(source).select(*TEXT_SCHEMA.fieldNames(), *scan_position())
    return _run(records, load, checkpoint)


def stream_index(
    spark: SparkSession,
    curated: str,
    out: str,
    checkpoint: str,
    embed: Callable[[DataFrame], DataFrame] | None = None,
    compact_above: int = 32,
) -> StreamingQuery:
    """Index the rows of loads that have arrived since the last run, then stop.

    Every micro-batch is one change of the index store, named by the stream and the batch, so a replay adds
    nothing; its rows replace those of the same id. More than ``compact_above`` segments become one.
    """

    def index(batch: DataFrame, batch_id: int) -> None:
        name = stream_load(checkpoint, batch_id)
        built = build_index(materialise(batch, "arrived"), embed)
        if not index_versions(spark, out):
            write_index(Index(*(t.limit(0) for t in (built.repositories, built.vectors, built.doc_terms)), digests=built.digests.limit(0)), out)
        refresh_index(spark, out, built, name=name)
        if len(manifest(spark, out)["segments"]) > compact_above:
            compact_index(spark, out)

    rows = spark.readStream.schema(STORED_SCHEMA).parquet(curated).drop("load_id")
    return _run(rows, index, checkpoint)


def read_streamed_index(spark: SparkSession, out: str) -> Index:
    """The latest version of a streamed index."""
    if not index_versions(spark, out):
        raise ValueError(f"nothing indexed yet under {out!r}")
    return read_index(spark, out)


def _run(rows: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
