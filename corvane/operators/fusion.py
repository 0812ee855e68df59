"""Rank fusion, score blending, ordering and paging for a table of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import scores

# Fixed values.
RRF_K = 60
EXTRA_CANDIDATES = 200
MAX_CANDIDATES = 2000
RRF_DIGITS = 10

SORTS = ("relevance", "stars", "activity", "recency")


def candidate_limit(offset: int, limit: int) -> int:
    """How many candidates a query retrieves before blending, sorting and paging."""
    return min(offset + limit + EXTRA_CANDIDATES, MAX_CANDIDATES)


def rank_hits(hits: DataFrame, score: str = "score") -> DataFrame:
    """1-based ``rank`` per query by score, ties by id."""
    by_score = Window.partitionBy("query_id").orderBy(F.desc(score), "id")
    return hits.withColumn("rank", F.row_number().over(by_score))


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, id, rank) lists; a list without the id adds nothing.

    One explicit shuffle of the union. Without it Spark 4.1 takes the union of lists that are each
    partitioned by query as partitioned by query, and when adaptive execution coalesces the lists
    differently the same (query, id) is summed in two places.
    """
    ranks = reduce(DataFrame.unionByName, [x.select("query_id", "id", "rank") for x in lists])
    return (
        ranks.repartition("query_id", "id")
        .groupBy("query_id", "id")
        .agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), RRF_DIGITS).alias("score"))
    )


def minmax_normalise(hits: DataFrame, score: str = "score", name: str = "norm") -> DataFrame:
    """Scale each query's scores to [0, 1]; all-equal scores become 0.

    ``total``, the number of the query's rows, comes from the same window.
    """
    per_query = Window.partitionBy("query_id")
    low, high = F.min(score).over(per_query), F.max(score).over(per_query)
    width = F.when(high != low, high - low).otherwise(F.lit(1.0))
    return hits.withColumns({name: (F.col(score) - low) / width, "total": F.count(F.lit(1)).over(per_query)})


def blend(hits: DataFrame, mode: str, language: str | None = None) -> DataFrame:
    """Final score and its breakdown from ``norm`` and the record's metadata.

    ``dense_score`` shows the normalised score in every mode, ``lexical_score`` in lexical mode.
    """
    norm = F.col("norm")
    metadata = scores.metadata_score(F.col("stars"), F.col("activity_score"), F.col("primary_language"), language)
    return hits.withColumns(
        {
            "score": scores.blended_score(norm, metadata),
            "dense_score": F.round(norm, 4),
            "lexical_score": F.round(norm, 4) if mode == "lexical" else F.lit(0.0),
            "metadata_score": F.round(metadata, 4),
        }
    ).drop("norm")


def sort_key(by: str) -> Column:
    if by not in SORTS:
        raise ValueError(f"sort_by must be one of {SORTS}, not {by!r}")
    return {
        "relevance": F.col("score"),
        "stars": F.coalesce("stars", F.lit(0)),
        "activity": F.coalesce("activity_score", F.lit(0.0)),
        "recency": F.coalesce("pushed_at", F.lit("")),
    }[by]


def order_hits(hits: DataFrame, by: str = "relevance") -> DataFrame:
    """1-based ``position`` per query, descending; ties keep retrieval order."""
    order = Window.partitionBy("query_id").orderBy(sort_key(by).desc(), F.col("rank"), F.col("id"))
    return hits.withColumn("position", F.row_number().over(order))


def page(hits: DataFrame, offset: int, limit: int) -> DataFrame:
    """The slice of positions after ``offset``."""
    return hits.where((F.col("position") > offset) & (F.col("position") <= offset + limit))


def page_summary(df: DataFrame, total: str, page_number: int, size: int) -> DataFrame:
    """Number of pages and the first and last row shown on a page, for a column of totals."""
    offset = (page_number - 1) * size
    n = F.col(total)
    return df.withColumns(
        {
            "total_pages": F.greatest(F.lit(1).cast("bigint"), F.ceil(n / size)),
            "start_row": F.least(F.lit(offset + 1).cast("bigint"), n),
            "end_row": F.least(F.lit(offset + size).cast("bigint"), n),
        }
    )
