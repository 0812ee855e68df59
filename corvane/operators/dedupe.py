"""De-duplication, incremental anti-join, ordered ids and constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.curate import COUNTS
from corvane.session import BROADCAST_KEYS, materialise, small_side
from corvane.sources.schemas import MAX_LENGTHS, REQUIRED

# A sorted limit sends up to this many rows per task to one task; larger cuts go by rank.
SORTED_LIMIT = 1_000


def dedupe_first(df: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """First row per key in input order.

    The row_number filter lets each map task drop all but its first row per key before the
    shuffle, so a key that fills a third of the input still reaches one task as a few rows.
    """
    first = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def only_new(df: DataFrame, existing: DataFrame, key: str, small: bool = False) -> DataFrame:
    """Rows whose key is not stored yet; stored rows are never changed.

    With ``small`` (the caller has checked the batch against ``BROADCAST_KEYS``) the batch's keys are
    broadcast, so the stored table is only scanned. Otherwise both sides meet in a shuffled join;
    dedupe first, so that no key is frequent in it.
    """
    # Distinct costs no shuffle of its own and keeps a repeated stored key from growing one task.
    stored = existing.select(key).distinct()
    if small:
        stored = stored.join(F.broadcast(df.select(key)), key, "left_semi")
    return df.join(stored, key, "left_anti")


def assign_ids(df: DataFrame, order: str | list[str], start: int = 1, name: str = "id") -> DataFrame:
    """Dense ids in the given order without a single-task sort.

    Rows are range-partitioned and sorted, written once to the shared folder (range bounds are
    sampled, so a second evaluation could place rows differently), then shifted by the row
    counts of the partitions before theirs.
    """
    keys = [order] if isinstance(order, str) else order
    low = F.monotonically_increasing_id()
    placed = materialise(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("*", F.shiftright(low, 33).cast("int").alias("_part"), low.bitwiseAND((1 << 33) - 1).alias("_pos")),
        "ids",
    )
    # One row per shuffle partition: bounded by spark.sql.shuffle.partitions, not by the data.
    sizes = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offsets, seen = [], 0
    for part, n in sizes:
        offsets.append((part, seen))
        seen += n
    shift = df.sparkSession.createDataFrame(offsets, "_part int, _before bigint")
    return (
        placed.join(F.broadcast(shift), "_part")
        .withColumn(name, F.col("_before") + F.col("_pos") + F.lit(start))
        .drop("_part", "_pos", "_before")
    )


def take_first_new(df: DataFrame, n: int | None, order: str = "seq", sorted_limit: int = SORTED_LIMIT) -> DataFrame:
    """First ``n`` rows in input order (``order`` is unique); None or a number below 1 keeps all.

    A large cut ranks the order column alone, then keeps the rows up to the n-th value of it.
    """
    if not n or n < 1:
        return df
    if n <= sorted_limit:
        return df.orderBy(order).limit(n)
    ranked = assign_ids(df.select(order), order, name="_rank")
    last = ranked.where(F.col("_rank") <= n).agg(F.max(order)).scalar()
    return df.where(F.col(order) <= last)


def violations() -> list[Column]:
    """One entry per constraint on single rows: its name where a row breaks it, NULL where not."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"required:{c}")) for c in REQUIRED]
    checks += [F.when(F.length(c) > n, F.lit(f"length:{c}")) for c, n in MAX_LENGTHS.items()]
    return checks


def unreadable() -> Column:
    """Of a raw record: one entry per count whose text is no number, with the text; such a count would become 0."""
    checks = []
    for raw, name in COUNTS.items():
        text = F.trim(F.col(raw))
        bad = text.isNotNull() & (text != "") & text.try_cast("decimal(38,6)").isNull()
        checks.append(F.when(bad, F.concat(F.lit(f"unreadable:{name}="), text)))
    return F.array_compact(F.array(*checks))


def validate(df: DataFrame, key: str = "name_with_owner") -> tuple[DataFrame, DataFrame]:
    """Split rows into those that meet the table's constraints and those that do not.

    Rejected rows carry ``violations``. Repeated keys come from a partial aggregate over the key
    column alone; when they are few, the wide rows are not shuffled to be marked.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    repeated = small_side(counts.select(key, F.lit(f"unique:{key}").alias("_dup")), BROADCAST_KEYS)
    checked = (
        df.join(repeated, key, "left")
        .withColumn("violations", F.array_compact(F.array(*violations(), F.col("_dup"))))
        .drop("_dup")
    )
    good = checked.where(F.size("violations") == 0).drop("violations")
    return good, checked.where(F.size("violations") > 0)
