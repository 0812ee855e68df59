"""Record cleaning and feature projections: no shuffle, no Python in the workers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import scores
from corvane.functions.text import (
    clean_text,
    compact_document,
    names_of,
    or_default,
    parse_iso,
    search_document,
    to_count,
    to_flag,
)
from corvane.sources.schemas import CURATED_SCHEMA

# Raw count columns and their curated names.
COUNTS = {
    "stars": "stars",
    "forks": "forks",
    "watchers": "watchers",
    "pullRequests": "pull_requests",
    "issues": "issues",
    "defaultBranchCommitCount": "commits",
    "diskUsageKb": "disk_usage_kb",
}


def with_identity(df: DataFrame) -> DataFrame:
    """Set ``nameWithOwner``, falling back to owner/name; drop rows that have neither."""
    fallback = F.concat(clean_text(F.col("owner")), F.lit("/"), clean_text(F.col("name")))
    return df.withColumn("nameWithOwner", or_default(F.col("nameWithOwner"), fallback)).where(
        F.col("nameWithOwner") != "/"
    )


def fill_defaults(df: DataFrame) -> DataFrame:
    """Typed columns with defaults: language Unknown, counts 0, flags false, licence NULL."""
    return df.withColumns(
        {
            "primaryLanguage": or_default(clean_text(F.col("primaryLanguage")), F.lit("Unknown")),
            "license": F.nullif(clean_text(F.col("license")), F.lit("")),
            "isFork": to_flag(F.col("isFork")),
            "isArchived": to_flag(F.col("isArchived")),
            **{raw: to_count(F.col(raw)) for raw in COUNTS},
        }
    )


def curate(
    df: DataFrame,
    reference: str = scores.REFERENCE_TIME,
    whole_days: bool = False,
    style: str = "full",
) -> DataFrame:
    """Raw records to curated records; columns outside the raw layout (``seq``) pass through."""
    if style not in ("full", "compact"):
        raise ValueError(f"style must be 'full' or 'compact', not {style!r}")
    curated = set(CURATED_SCHEMA.fieldNames())
    raw_only = {
        "nameWithOwner", "primaryLanguage", "isFork", "isArchived", "createdAt", "pushedAt", *COUNTS,
    }
    extras = [c for c in df.columns if c not in curated | raw_only]
    typed = fill_defaults(with_identity(df)).select(
        F.col("nameWithOwner").alias("name_with_owner"),
        clean_text(F.col("owner")).alias("owner"),
        clean_text(F.col("name")).alias("name"),
        clean_text(F.col("description")).alias("description"),
        F.col("primaryLanguage").alias("primary_language"),
        names_of(F.col("languages")).alias("languages"),
        names_of(F.col("topics"), lower=True).alias("topics"),
        *[F.col(raw).alias(name) for raw, name in COUNTS.items()],
        F.col("isFork").alias("is_fork"),
        F.col("isArchived").alias("is_archived"),
        F.col("createdAt").alias("created_at"),
        F.col("pushedAt").alias("pushed_at"),
        "license",
        *extras,
    )
    if whole_days:
        days = scores.calendar_days_since(F.col("pushed_at"), reference)
    else:
        days = scores.days_since(parse_iso(F.col("pushed_at")), reference)
    scored = typed.withColumns(
        {
            "activity_score": scores.activity_score(
                F.col("commits"), F.col("pull_requests"), F.col("issues"), days
            ),
            "popularity_score": scores.popularity_score(F.col("stars"), F.col("forks")),
        }
    )
    return scored.withColumn("synthesized_text", document(style)).select(
        *CURATED_SCHEMA.fieldNames(), *extras
    )


def document(style: str = "full"):
    """The search text of a curated record, as a column over its curated columns."""
    c = F.col
    if style == "compact":
        return compact_document(
            c("name_with_owner"), c("description"), c("primary_language"), c("topics"), c("stars"), c("activity_score")
        )
    return search_document(
        c("name_with_owner"), c("description"), c("primary_language"), c("languages"), c("topics"), c("activity_score")
    )


def payload(df: DataFrame) -> DataFrame:
    """What a hit carries: everything but the long search text, lists never NULL."""
    empty = F.array().cast("array<string>")
    lists = {c: F.coalesce(F.col(c), empty) for c in ("languages", "topics") if c in df.columns}
    return df.drop("synthesized_text").withColumns(lists)


def result_card(df: DataFrame, url_prefix: str = "https://github.com/") -> DataFrame:
    """Display columns of a hit or record, with display defaults."""
    return df.select(
        F.col("name_with_owner"),
        F.concat(F.lit(url_prefix), F.col("name_with_owner")).alias("url"),
        or_default(F.col("description"), F.lit("No description provided.")).alias("description"),
        or_default(F.col("primary_language"), F.lit("Unknown")).alias("language"),
        F.coalesce("stars", F.lit(0)).alias("stars"),
        F.coalesce("forks", F.lit(0)).alias("forks"),
        or_default(F.col("license"), F.lit("No license")).alias("license"),
        F.coalesce("activity_score", F.lit(0.0)).alias("activity_score"),
        F.slice(F.coalesce("topics", F.array().cast("array<string>")), 1, 10).alias("topics"),
    )
