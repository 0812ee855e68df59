"""Sinks and sources of the curated table."""

from __future__ import annotations

import urllib.parse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import BROADCAST_KEYS, small_side


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists on whatever file system its address names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def stored_loads(spark: SparkSession, path: str) -> list[str]:
    """The loads of a curated table whose rows were stored whole."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(f"{path.rstrip('/')}/load_id=*/_SUCCESS")
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    names = [f.getPath().getParent().getName().removeprefix("load_id=") for f in found or []]
    return [urllib.parse.unquote(n) for n in names]


def write_curated(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: str | None = None,
    max_records_per_file: int | None = None,
) -> None:
    """Overwrite ``path``; rows are sorted by stars inside each file so that scans can skip.

    With ``partition_by``, rows of one value are brought together in files of even size: a
    rebalance lets adaptive execution split a value that fills a third of the table over many
    tasks and join small values into one.
    """
    if partition_by:
        df = df.hint("rebalance", F.col(partition_by))
    keys = [c for c in (partition_by, "stars") if c in df.columns]
    if keys:
        df = df.sortWithinPartitions(*keys)
    writer = df.write.mode("overwrite").format(fmt)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.save(path)


def append_load(df: DataFrame, path: str, load_id: int | str, max_records_per_file: int | None = None) -> str:
    """Append one load as its own folder and return that; a retry of the load replaces it whole."""
    folder = f"{path.rstrip('/')}/load_id={load_id}"
    writer = df.write.mode("overwrite")
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.parquet(folder)
    return folder


def read_curated(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """Relational sink; the driver jar comes from the caller's session."""
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    key: str = "id",
    lower: int = 0,
    upper: int = 1,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """Relational source, read in ranges of ``key``."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, **options)
        .option("partitionColumn", key)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", partitions)
        .load()
    )


def upsert_by_key(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace stored rows with the same key; other stored rows stay.

    A small update is broadcast, so the stored rows are scanned and not shuffled. Write the result
    to a new path: it still reads from the old one.
    """
    keys = small_side(new.select(key), BROADCAST_KEYS)
    return new.unionByName(existing.join(keys, key, "left_anti"))
