"""Stored keys and their ids: a bucketed, sorted table beside the curated one.

A key keeps its id for good. The table only grows: the newest entry of a key tells which load holds its
record, or that none does (``load_id`` NULL, after a replaced load left it out). It is bucketed by key, so
a join with a load's keys shuffles the load only, and a look-up of few keys reads their buckets alone.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.curated import path_exists
from corvane.sources.schemas import STORED_SCHEMA

KEY = "name_with_owner"
BUCKETS = 64
#: Up to so many keys of a load are listed in the look-up, which then reads their buckets only.
LISTED_KEYS = 200


def key_table(spark: SparkSession, path: str) -> str:
    """The name of the key table beside the curated table at ``path``, declared in this session.

    A curated table that was written without one gets it from its rows.
    """
    location = f"{path.rstrip('/')}-keys"
    name = f"keys_{hashlib.sha256(location.encode()).hexdigest()[:16]}"
    known = path_exists(spark, location)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({KEY} STRING, id BIGINT, load_id STRING, at BIGINT) USING parquet "
        f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {BUCKETS} BUCKETS LOCATION '{location}'"
    )
    if known:
        spark.catalog.refreshTable(name)
    elif path_exists(spark, path):
        rows = spark.read.schema(STORED_SCHEMA).parquet(path)
        append_keys(spark, name, rows.select(KEY, "id", "load_id"), 0)
    return name


def append_keys(spark: SparkSession, name: str, rows: DataFrame, at: int) -> None:
    """Add entries (key, id, load_id); each bucket is written by one task."""
    entries = rows.select(KEY, "id", "load_id", F.lit(at).cast("bigint").alias("at"))
    entries.repartition(BUCKETS, KEY).sortWithinPartitions(KEY).write.insertInto(name)


def newest(entries: DataFrame) -> DataFrame:
    """(key, id, load_id) of every key's newest entry; grouping by the bucket column needs no shuffle."""
    last = entries.groupBy(KEY).agg(F.max_by(F.struct("id", "load_id"), "at").alias("last"))
    return last.select(KEY, "last.id", "last.load_id")


def look_up(spark: SparkSession, name: str, keys: DataFrame) -> DataFrame:
    """(key, id, load_id) of those of ``keys`` (one column, distinct) that are stored."""
    stored = spark.table(name)
    few = [r[KEY] for r in keys.take(LISTED_KEYS + 1)]
    if len(few) <= LISTED_KEYS:
        return newest(stored.where(F.col(KEY).isin(few)))
    return newest(stored.join(keys, KEY))


def last_numbers(spark: SparkSession, name: str) -> tuple[int, int]:
    """The largest id and the newest entry number."""
    row = spark.table(name).agg(F.max("id"), F.max("at")).first()
    return row[0] or 0, row[1] or 0
