"""Text cleaning, nested names, tokenising and search-document columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag pattern, and every character the cleaning rule counts as white space.
TAG = r"<[^>]+>"
WHITE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Runs that are not already one plain space: most text has few, so little of it is rewritten.
WHITE_RUN = f"[[{WHITE}]&&[^ ]][{WHITE}]*| [{WHITE}]+"
NOT_WORD = r"[^\p{L}\p{N}]+"

MAX_LANGUAGES = 5
MAX_TOPICS = 12
ACTIVE_ABOVE = 0.7
DORMANT_BELOW = 0.3


def clean_text(col: Column) -> Column:
    """NUL out, tags to spaces, white space collapsed and stripped; NULL becomes ''."""
    no_nul = F.translate(F.coalesce(col, F.lit("")), "\x00", "")
    return F.trim(F.regexp_replace(F.regexp_replace(no_nul, TAG, " "), WHITE_RUN, " "))


def or_default(col: Column, default: Column) -> Column:
    """``default`` where a string is NULL or empty."""
    return F.coalesce(F.nullif(col, F.lit("")), default)


def to_count(col: Column) -> Column:
    """Whole number from text, truncated toward zero; anything else is 0."""
    return F.coalesce(col.try_cast("decimal(38,6)").try_cast("bigint"), F.lit(0).cast("bigint"))


def to_flag(col: Column) -> Column:
    return F.coalesce(col.try_cast("boolean"), F.lit(False))


def names_of(col: Column, lower: bool = False) -> Column:
    """Cleaned names from an array whose items are JSON objects with a name, or plain text.

    An item is kept when its raw name is non-empty, even if cleaning leaves ''. Text that begins like an
    object but is none is plain text.
    """
    raw = F.transform(
        F.coalesce(col, F.array().cast("array<string>")),
        lambda x: F.when(F.ltrim(x).startswith("{") & F.try_parse_json(x).isNotNull(), F.get_json_object(x, "$.name")).otherwise(x),
    )
    kept = F.filter(raw, lambda x: x.isNotNull() & (x != ""))
    return F.transform(kept, lambda x: F.lower(clean_text(x)) if lower else clean_text(x))


def parse_iso(col: Column) -> Column:
    """ISO text to timestamp; no zone means UTC, invalid or empty text means NULL.

    Missing parts are filled in one after the other, so the text is read once per part.
    """
    minute, zone = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}", r"(?:Z|[+-]\d{2}:\d{2})"
    second = minute + r":\d{2}(?:\.\d+)?"
    timed = F.regexp_replace(col, r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00")
    exact = F.regexp_replace(timed, f"^({minute})({zone}?)$", "$1:00$2")
    zoned = F.regexp_replace(exact, f"^({second})$", "$1Z")
    return F.try_to_timestamp(F.regexp_extract(zoned, f"^{second}{zone}$", 0))


def tokenize(col: Column) -> Column:
    """Lower-cased runs of letters and digits, in text order, repeats kept."""
    words = F.split(F.lower(F.coalesce(col, F.lit(""))), NOT_WORD)
    # Only the first and last pieces of a split can be empty.
    return F.array_remove(words, "")


def _sections(*parts: tuple[str, Column]) -> Column:
    """Labelled sections in order; a section whose value is NULL is left out."""
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{label}: "), value) for label, value in parts])


def search_document(
    name_with_owner: Column,
    description: Column,
    primary_language: Column,
    languages: Column,
    topics: Column,
    activity: Column,
) -> Column:
    """One search text per record; sections without content are left out."""

    others = F.filter(languages, lambda x: x != primary_language)
    status = F.when(activity > ACTIVE_ABOVE, "Highly active and maintained").when(
        activity < DORMANT_BELOW, "Inactive or legacy"
    )
    return _sections(
        ("Repository", name_with_owner),
        ("Primary Language", F.when(~primary_language.isin("", "Unknown"), primary_language)),
        ("Languages", F.when(F.size(others) > 0, F.array_join(F.slice(others, 1, MAX_LANGUAGES), ", "))),
        ("Topics and tags", F.when(F.size(topics) > 0, F.array_join(F.slice(topics, 1, MAX_TOPICS), ", "))),
        ("Description", F.nullif(description, F.lit(""))),
        ("Status", status),
    )


def compact_document(
    name_with_owner: Column,
    description: Column,
    primary_language: Column,
    topics: Column,
    stars: Column,
    activity: Column,
) -> Column:
    """The unconditional variant: every section is always present, numbers included."""
    return _sections(
        ("Repository", name_with_owner),
        ("Primary Language", primary_language),
        ("Topics", F.array_join(topics, ", ")),
        ("Description", description),
        ("Stars", stars.cast("string")),
        ("Activity", activity.cast("string")),
    )
