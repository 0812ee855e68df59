"""Readers for raw repository records (JSON lines or JSON arrays)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.arrays import SEQ, array_elements
from corvane.sources.schemas import LIST_FIELDS, TEXT_SCHEMA

def scan_position() -> list[Column]:
    """File and split start of a row; only valid directly on a file scan."""
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]


def with_order(df: DataFrame) -> DataFrame:
    """``seq`` from the scan position: file, then split start, then row within the split."""
    order = F.struct("file", "block", F.monotonically_increasing_id().alias("row"))
    return df.withColumn(SEQ, order).drop("file", "block")


def typed_lists(df: DataFrame) -> DataFrame:
    """Lists that were read as JSON text as arrays of their objects (as text) and strings; other items are left out."""

    def kept(text: Column) -> Column:
        kinds = F.transform(F.from_json(text, "array<variant>"), F.schema_of_variant)
        both = F.arrays_zip(F.from_json(text, "array<string>").alias("item"), kinds.alias("kind"))
        named = F.filter(both, lambda x: (x["kind"] == "STRING") | x["kind"].startswith("OBJECT"))
        return F.transform(named, lambda x: x["item"])

    return df.withColumns({c: kept(F.col(c)) for c in LIST_FIELDS})


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line, splittable; unreadable lines become all-NULL rows."""
    scan = spark.read.schema(TEXT_SCHEMA).json(path)
    return typed_lists(with_order(scan.select(*TEXT_SCHEMA.fieldNames(), *scan_position())))


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """Files that each hold one JSON array, of any size and layout; elements that are not objects are skipped."""
    items = array_elements(spark, path)
    return typed_lists(items.select(F.from_json("item", TEXT_SCHEMA).alias("r"), SEQ).select("r.*", SEQ))


def _line_items(line: Column) -> Column:
    """The elements a line of an array file holds; a line that cuts through an element is an error."""
    bare = F.regexp_replace(F.trim(line), r"^\[|,$|\],?$", "")
    items = F.from_json(F.concat(F.lit("["), bare, F.lit("]")), "array<string>")
    broken = F.raise_error(F.concat(F.lit("not whole elements, read the file as 'array': "), F.substring(line, 1, 80)))
    return F.coalesce(items, broken.cast("array<string>"))


def array_to_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (column ``value``) from array files whose lines hold whole elements.

    Reads splits of a file in parallel, so the file may be larger than one JVM value. A line that is
    not made of whole elements, as in an indented array, fails the read; nothing is left out unseen.
    """
    # The outer form keeps Spark from parsing twice, once to test for empty arrays.
    lines = spark.read.text(path).select(F.explode_outer(_line_items(F.col("value"))).alias("value"))
    return lines.where(F.ltrim("value").startswith("{"))


def read_array_lines(spark: SparkSession, path: str) -> DataFrame:
    """Array files of any size whose lines hold whole elements; see ``array_to_lines``."""
    lines = spark.read.text(path).select(F.explode_outer(_line_items(F.col("value"))).alias("item"), *scan_position())
    items = lines.where(F.ltrim("item").startswith("{"))
    rows = items.select(F.from_json("item", TEXT_SCHEMA).alias("r"), "file", "block").select("r.*", "file", "block")
    return typed_lists(with_order(rows))


def read_repositories(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Raw records plus ``seq``, their order in the input.

    The layout is explicit because a pretty-printed array read as lines gives only NULL rows.
    """
    readers = {"lines": read_lines, "array": read_array, "array_lines": read_array_lines}
    if layout not in readers:
        raise ValueError(f"layout must be one of {sorted(readers)}, not {layout!r}")
    return readers[layout](spark, path)


def sample_fraction(df: DataFrame, fraction: float | None) -> DataFrame:
    """Bernoulli sample with a fixed seed; anything outside (0, 1) keeps every row."""
    if fraction is not None and 0.0 < fraction < 1.0:
        return df.sample(fraction=fraction, seed=42)
    return df
