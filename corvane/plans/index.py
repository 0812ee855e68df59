"""Build the tables of a search index from curated records; ``store`` writes and refreshes them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.vectors import embed_hashed
from corvane.operators.curate import payload
from corvane.operators.lexical import count_terms, doc_tokens, term_stats
from corvane.plans.search import Index
from corvane.session import materialise

# Columns the index tables carry beside their own, so that filters reach their scans.
FILTERS = ["primary_language", "stars"]


def build_index(curated: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None) -> Index:
    """Index tables of curated records keyed by ``id``: vectors, term rows and payload.

    ``embed`` adds ``embedding`` from ``text``; the default is the hashing encoder.
    """
    texts = curated.select("id", *FILTERS, F.col("synthesized_text").alias("text"))
    vectors = (embed or embed_hashed)(texts).select("id", "embedding", *FILTERS)
    terms = count_terms(doc_tokens(texts)).select("id", "doc_len", "terms", "tfs", *FILTERS)
    return Index(payload(curated), vectors, terms, digests=with_digest(curated).select("id", "digest"))


def with_digest(curated: DataFrame) -> DataFrame:
    """``curated`` plus ``digest``, a hash of all its columns, by which a refresh tells what has changed."""
    return curated.withColumn("digest", F.xxhash64(*sorted(c for c in curated.columns if c != "digest")))


def settled(index: Index) -> Index:
    """``index`` with its vectors, counted terms and statistics written to the shared folder once, for many searches."""
    terms = index.doc_terms if "tfs" in index.doc_terms.columns else count_terms(index.doc_terms)
    terms = materialise(terms, "doc-terms")
    stats = materialise(term_stats(terms) if index.term_stats is None else index.term_stats, "term-stats")
    return replace(index, vectors=materialise(index.vectors, "vectors"), doc_terms=terms, term_stats=stats)


def index_rows(index: Index) -> DataFrame:
    """Per id: vector width, distinct terms and text length, joined on id."""
    return (
        index.repositories.select("id")
        .join(index.vectors.select("id", F.size("embedding").alias("dim")), "id", "left")
        .join(index.doc_terms.select("id", "doc_len", F.size("terms").alias("n_terms")), "id", "left")
    )
