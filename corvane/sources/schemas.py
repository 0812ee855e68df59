"""Column layouts of raw and curated records."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT_FIELDS = ["owner", "name", "nameWithOwner", "description", "primaryLanguage"]
COUNT_FIELDS = [
    "stars",
    "forks",
    "watchers",
    "pullRequests",
    "issues",
    "diskUsageKb",
    "defaultBranchCommitCount",
]

# Counts and flags are read as text: a quoted or over-long number must not become NULL at the
# scan. Lists are read as text items, which keeps both object items and plain strings.
RAW_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in TEXT_FIELDS]
    + [T.StructField(name, T.ArrayType(T.StringType())) for name in ("languages", "topics")]
    + [T.StructField(name, T.StringType()) for name in COUNT_FIELDS]
    + [T.StructField(name, T.StringType()) for name in ("isFork", "isArchived", "createdAt", "pushedAt", "license")]
)

LIST_FIELDS = ["languages", "topics"]
# As the files are read: a list comes as its JSON text, which still tells strings from other items.
TEXT_SCHEMA = T.StructType([T.StructField(f.name, T.StringType()) for f in RAW_SCHEMA.fields])

CURATED_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("name_with_owner", "owner", "name", "description", "primary_language")]
    + [T.StructField(name, T.ArrayType(T.StringType())) for name in ("languages", "topics")]
    + [
        T.StructField(name, T.LongType())
        for name in ("stars", "forks", "watchers", "pull_requests", "issues", "commits", "disk_usage_kb")
    ]
    + [T.StructField(name, T.BooleanType()) for name in ("is_fork", "is_archived")]
    + [T.StructField(name, T.StringType()) for name in ("created_at", "pushed_at", "license")]
    + [T.StructField(name, T.DoubleType()) for name in ("activity_score", "popularity_score")]
    + [T.StructField("synthesized_text", T.StringType())]
)

# The curated table as stored: surrogate ids, and the load that wrote each row.
STORED_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), *CURATED_SCHEMA.fields, T.StructField("load_id", T.StringType())]
)

# Longest text each curated column may hold, and the columns that must be set.
MAX_LENGTHS = {
    "name_with_owner": 255,
    "owner": 128,
    "name": 128,
    "primary_language": 64,
    "created_at": 64,
    "pushed_at": 64,
    "license": 128,
}
REQUIRED = ["name_with_owner", "owner", "name", "synthesized_text"]
