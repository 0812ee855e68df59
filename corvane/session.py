"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build_session(app_name: str = "corvane", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, bounded Arrow batches)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Documents are wide: keep one Arrow batch well under an executor's Python memory.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        # Spark 4.1 may treat a union of equally partitioned inputs as partitioned although
        # adaptive execution has coalesced them differently.
        "spark.sql.unionOutputPartitioning": "false",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str | None:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, or the context's checkpoint folder."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder; the caller of the session decides where that is."""
    root = shared_folder(spark)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing to the shared folder, so every later read sees the same rows."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores one partition per core.

    Large inputs already have more splits than cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# A join side of at most this many short keys may be broadcast.
BROADCAST_KEYS = 20_000


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; stops reading once that is known."""
    return len(df.select(F.lit(1)).take(rows + 1)) <= rows


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast when it has at most ``rows`` rows, unchanged otherwise.

    The check costs one run of ``df``: use it where that is cheaper than shuffling the other side.
    """
    return F.broadcast(df) if is_small(df, rows) else df


def bounded_local(df: DataFrame, max_rows: int, max_bytes: int) -> DataFrame | None:
    """A driver-held copy of ``df``, or None when its measured size exceeds the bounds.

    Sizes are measured by an aggregate before anything is fetched.
    """

    def width(field: T.StructField):
        if isinstance(field.dataType, T.StringType):
            return F.coalesce(F.octet_length(field.name), F.lit(0))
        if isinstance(field.dataType, T.ArrayType):
            return 8 * F.greatest(F.size(field.name), F.lit(0))
        return F.lit(8)

    row = sum((width(f) for f in df.schema.fields), F.lit(0)).cast("bigint")
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row), F.lit(0)).alias("bytes")).first()
    if size["rows"] > max_rows or size["bytes"] > max_bytes:
        return None
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)
