"""Feature and ranking formulas as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring model.
REFERENCE_TIME = "2026-09-01T00:00:00Z"
RECENCY_LAMBDA = 0.0019
MISSING_DAYS = 1500.0
RETRIEVAL_WEIGHT = 0.85
METADATA_WEIGHT = 0.15
LANGUAGE_BONUS = 0.25


def _log_share(count: Column, decades: float) -> Column:
    """log10(count + 1) as a share of ``decades``, at most 1; negative and unknown counts are 0.

    Without the floor the logarithm would be NULL, which ``least`` turns into the full share.
    """
    return F.least(F.lit(1.0), F.log10(F.greatest(count, F.lit(0)) + 1) / decades)


def _not_negative(days: Column) -> Column:
    """At least 0, or 1500 where unknown; ``greatest`` alone would turn NULL into 0."""
    return F.when(days.isNull(), F.lit(MISSING_DAYS)).otherwise(F.greatest(F.lit(0.0), days))


def days_since(ts: Column, reference: str = REFERENCE_TIME) -> Column:
    """Fractional days from ``ts`` to the reference, not below 0; unknown is 1500."""
    ref = F.unix_micros(F.lit(reference).cast("timestamp"))
    return _not_negative((ref - F.unix_micros(ts)) / 1_000_000 / 86400.0)


def calendar_days_since(raw: Column, reference: str = REFERENCE_TIME) -> Column:
    """Whole calendar days between the dates written in the text and in the reference."""
    day = F.substring(raw, 1, 10).try_cast("date")
    return _not_negative(F.datediff(F.lit(reference[:10]).cast("date"), day).cast("double"))


def recency(days: Column) -> Column:
    return F.exp(F.lit(-RECENCY_LAMBDA) * days)


def activity_score(commits: Column, pull_requests: Column, issues: Column, days: Column) -> Column:
    return F.round(
        0.35 * _log_share(commits, 4.0)
        + 0.25 * _log_share(pull_requests + issues, 4.0)
        + 0.40 * recency(days),
        4,
    )


def popularity_score(stars: Column, forks: Column) -> Column:
    return F.round(0.75 * _log_share(stars, 5.5) + 0.25 * _log_share(forks, 4.5), 4)


def metadata_score(
    stars: Column, activity: Column, language: Column, target_language: str | None = None
) -> Column:
    """Quality boost in [0, 1]; the language bonus ignores case, unlike the language filter."""
    base = 0.5 * _log_share(F.coalesce(stars, F.lit(0)), 5.0) + 0.5 * F.greatest(
        F.lit(0.0), F.least(F.lit(1.0), F.coalesce(activity, F.lit(0.0)))
    )
    if target_language:
        same = (F.lower(language) == target_language.lower()) & (language != "")
        base = base + F.when(same, F.lit(LANGUAGE_BONUS)).otherwise(0.0)
    return F.least(F.lit(1.0), base)


def blended_score(norm: Column, metadata: Column) -> Column:
    return F.round(RETRIEVAL_WEIGHT * norm + METADATA_WEIGHT * metadata, 4)
