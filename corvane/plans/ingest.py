"""Incremental load: curate, first row per key, not yet stored, first N, ids, append.

What a load keeps is decided on keys and positions alone; texts are read once more for the rows that stay.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corvane.operators.curate import curate, with_identity
from corvane.operators.dedupe import assign_ids, dedupe_first, only_new, take_first_new, unreadable, violations
from corvane.operators.stats import load_states
from corvane.plans.keys import KEY, append_keys, key_table, last_numbers, look_up, newest
from corvane.session import BROADCAST_KEYS, is_small, materialise
from corvane.sources.curated import append_load, path_exists, stored_loads
from corvane.sources.repositories import SEQ, read_repositories
from corvane.sources.schemas import STORED_SCHEMA


@dataclass(frozen=True)
class LoadReport:
    """Rows stored before the load, rows it saved, how long it took, and rows that broke a constraint."""

    existing: int
    saved: int
    seconds: float
    rejected: int = 0

    @property
    def rate(self) -> float:
        return self.saved / max(0.001, self.seconds)


def first_keys(raw: DataFrame) -> DataFrame:
    """(key, seq) of the first record of every key: no text leaves the scan."""
    keys = with_identity(raw.select("owner", "name", "nameWithOwner", SEQ)).select(F.col("nameWithOwner").alias(KEY), SEQ)
    return dedupe_first(keys, KEY, SEQ)


def rows_at(raw: DataFrame, places: DataFrame) -> DataFrame:
    """The raw records at ``places`` (seq and more); few places are broadcast, so that no text is shuffled."""
    small = is_small(places, BROADCAST_KEYS)
    return raw.join(F.broadcast(places) if small else places, SEQ)


def ingest(raw: DataFrame, existing: DataFrame | None, n: int | None = None, **options) -> DataFrame:
    """Curated rows to append for one load of raw records (with ``seq``, which a second scan gives again)."""
    fresh = first_keys(raw)
    if existing is not None:
        fresh = only_new(fresh, existing, KEY, small=is_small(fresh, BROADCAST_KEYS))
    places = materialise(take_first_new(fresh, n, SEQ).select(SEQ), "places")
    return curate(rows_at(raw, places), **options)


def chosen_places(raw: DataFrame, path: str, load_id: str, n: int | None) -> DataFrame:
    """(seq, id) of the records that a load stores; enters their keys in the key table first.

    A key that another load holds is left out. A key that was stored before keeps its id, also when this
    load is written again or a replaced load had let it go.
    """
    spark = raw.sparkSession
    table = key_table(spark, path)
    first = materialise(first_keys(raw), "keys")
    # A load that died before its rows were stored holds nothing.
    loads = spark.createDataFrame([(x, x) for x in stored_loads(spark, path) if x != load_id], "load_id string, holder string")
    known = look_up(spark, table, first.select(KEY)).join(F.broadcast(loads), "load_id", "left")
    known = known.select(KEY, F.col("id").alias("known"), "holder", F.col("load_id").eqNullSafe(F.lit(load_id)).alias("own"))
    free = first.join(known, KEY, "left").where("holder is null").drop("holder")
    chosen = materialise(take_first_new(free, n, SEQ), "chosen")
    last, at = last_numbers(spark, table)
    fresh = assign_ids(chosen.where("known is null").select(KEY, SEQ, "own"), SEQ, start=last + 1)
    kept = chosen.where("known is not null").select(KEY, SEQ, "own", F.col("known").alias("id"))
    places = materialise(fresh.select(*kept.columns).unionByName(kept), "places")
    entries = places.where("own is null or not own").select(KEY, "id", F.lit(load_id).alias("load_id"))
    if path_exists(spark, f"{path.rstrip('/')}/load_id={load_id}"):
        # The load is written again: what it does not hold any more is free.
        mine = newest(spark.table(table)).where(F.col("load_id") == load_id)
        gone = mine.join(places.select(KEY), KEY, "left_anti").select(KEY, "id", F.lit(None).cast("string").alias("load_id"))
        entries = entries.unionByName(materialise(gone, "released"))
    append_keys(spark, table, entries, at + 1)
    return places.select(SEQ, "id")


def load_batch(
    raw: DataFrame, path: str, load_id: int | str, n: int | None = None, max_records_per_file: int | None = None
) -> LoadReport:
    """Ingest ``raw`` into the curated table at ``path`` as one load and report on it.

    Rows that break a constraint of the table, or hold a count that cannot be read, go to the same load of
    ``path``-rejected, with the names of what they break; their ids stay unused. The report's numbers are
    observed in the one write. Statistics of the load are kept in ``path``-stats.
    """
    started = time.monotonic()
    spark, load_id, root = raw.sparkSession, str(load_id), path.rstrip("/")
    existing = 0
    if path_exists(spark, path):
        existing = spark.read.schema(STORED_SCHEMA).parquet(path).where(F.col("load_id") != load_id).count()
    places = chosen_places(raw, path, load_id, n)
    marked = rows_at(raw.withColumn("unreadable", unreadable()), places)
    broken = F.concat(F.array_compact(F.array(*violations())), F.col("unreadable"))
    checked = curate(marked).withColumn("violations", broken).drop(SEQ, "unreadable")
    columns = ["id", *(c for c in checked.columns if c != "id")]
    seen = Observation()
    bad = F.size("violations") > 0
    counted = checked.select(*columns).observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("rejected"))
    folder = append_load(counted.where(~bad).drop("violations"), path, load_id, max_records_per_file)
    rows, rejected = seen.get["rows"], seen.get["rejected"]
    # A retried load replaces what it rejected before, too.
    if rejected or path_exists(spark, f"{root}-rejected/load_id={load_id}"):
        append_load(checked.select(*columns).where(bad), f"{root}-rejected", load_id, max_records_per_file)
    append_load(load_states(spark.read.schema(STORED_SCHEMA).parquet(folder)).coalesce(1), f"{root}-stats", load_id)
    return LoadReport(existing, rows - rejected, time.monotonic() - started, rejected)


def ingest_path(
    spark: SparkSession,
    source: str,
    path: str,
    load_id: int | str,
    layout: str = "lines",
    n: int | None = None,
    max_records_per_file: int | None = None,
) -> LoadReport:
    """Read, ingest and append; an input without a single usable record is an error."""
    raw = read_repositories(spark, source, layout)
    if is_small(with_identity(raw), 0):
        raise ValueError(f"no usable record in {source!r} read as {layout!r}: is the layout right?")
    return load_batch(raw, path, load_id, n, max_records_per_file)
