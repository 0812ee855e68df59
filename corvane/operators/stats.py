"""Filters, look-ups and summary statistics over the curated table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hit_filter(language: str | None = None, min_stars: int = 0) -> Column | None:
    """Condition for stars and language, or None when neither restricts.

    The language must match exactly; '', None and 'all' in any case switch it off. NULL stars
    only pass while no minimum is set.
    """
    if min_stars < 0:
        raise ValueError("min_stars must not be negative")
    parts = []
    if min_stars > 0:
        parts.append(F.col("stars") >= min_stars)
    if language and language.lower() != "all":
        parts.append(F.col("primary_language") == language)
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0] & parts[1]


def filter_hits(df: DataFrame, language: str | None = None, min_stars: int = 0) -> DataFrame:
    condition = hit_filter(language, min_stars)
    return df if condition is None else df.where(condition)


def known_language(df: DataFrame) -> DataFrame:
    return df.where(F.col("primary_language").isNotNull() & (F.col("primary_language") != "Unknown"))


def lookup(df: DataFrame, owner: str, name: str) -> DataFrame:
    """The record called owner/name: one row or none."""
    return df.where(F.col("name_with_owner") == f"{owner}/{name}").limit(1)


def table_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total_repositories"),
        F.round(F.coalesce(F.avg("stars"), F.lit(0.0)), 2).alias("avg_stars"),
        F.round(F.coalesce(F.avg("activity_score"), F.lit(0.0)), 4).alias("avg_activity_score"),
    )


def top_languages(df: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent known languages; equal counts are ordered by name."""
    return (
        known_language(df)
        .groupBy(F.col("primary_language").alias("language"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "language")
        .limit(n)
    )


def languages(df: DataFrame) -> DataFrame:
    """Distinct known, non-empty languages in ascending order."""
    return (
        known_language(df)
        .where("primary_language != ''")
        .select(F.col("primary_language").alias("language"))
        .distinct()
        .orderBy("language")
    )


def stats_record(df: DataFrame, index: DataFrame, n: int = 10) -> DataFrame:
    """One row: table statistics, indexed rows and the top languages as an array of ``n`` structs."""
    ranked = _listed(top_languages(df, n))
    return table_stats(df).select(
        "*",
        index.agg(F.count("*")).scalar().alias("indexed_in_search"),
        ranked.scalar().alias("top_languages"),
    )


def index_freshness(index: DataFrame, table: DataFrame) -> DataFrame:
    """Row counts, whether the index must be rebuilt, and readiness."""
    counts = index.agg(F.count("*").alias("indexed")).select("*", table.agg(F.count("*")).scalar().alias("stored"))
    tolerance = F.greatest(F.lit(10).cast("bigint"), F.floor(F.col("stored") * 0.01))
    fresh = (F.col("indexed") > 0) & (F.abs(F.col("indexed") - F.col("stored")) <= tolerance)
    return counts.select(
        "indexed",
        "stored",
        (~fresh).alias("stale"),
        F.when(F.col("indexed") > 0, F.lit("ready")).otherwise("warming_up").alias("status"),
    )


def load_states(df: DataFrame) -> DataFrame:
    """What the statistics of a load need, by language: sums and counts that add up over loads."""
    return df.groupBy("primary_language").agg(
        F.count("*").alias("n"),
        F.sum("stars").alias("stars"),
        F.count("stars").alias("n_stars"),
        F.sum("activity_score").alias("activity"),
        F.count("activity_score").alias("n_activity"),
    )


def stats_from_states(states: DataFrame, index: DataFrame, n: int = 10) -> DataFrame:
    """``stats_record`` from the states of all loads: one row per load and language is read, no record."""
    merged = states.groupBy("primary_language").agg(*(F.sum(c).alias(c) for c in ("n", "stars", "n_stars", "activity", "n_activity")))

    def mean(total: str, count: str, digits: int) -> Column:
        return F.round(F.coalesce(F.try_divide(F.sum(total), F.sum(count)), F.lit(0.0)), digits)

    totals = merged.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("total_repositories"),
        mean("stars", "n_stars", 2).alias("avg_stars"),
        mean("activity", "n_activity", 4).alias("avg_activity_score"),
    )
    top = known_language(merged).select(F.col("primary_language").alias("language"), F.col("n").alias("count"))
    top = top.orderBy(F.desc("count"), "language").limit(n)
    return totals.select("*", index.agg(F.count("*")).scalar().alias("indexed_in_search"), _listed(top).scalar().alias("top_languages"))


def _listed(ranked: DataFrame) -> DataFrame:
    """(language, count) rows as one array, the most frequent first."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("less"), "language")))
    return ranked.agg(F.transform(ordered, lambda x: F.struct(x["language"].alias("language"), (-x["less"]).alias("count"))))
