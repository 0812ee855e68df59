"""The search itself: retrieve, fuse, blend, sort and page, for a whole table of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import fusion
from corvane.operators.blockscore import MAX_QUERIES, MAX_QUERY_BYTES
from corvane.operators.dense import ann_topk, dense_topk, threshold_topk
from corvane.operators.lexical import bm25_topk
from corvane.operators.postings import blocks_topk
from corvane.operators.stats import filter_hits
from corvane.session import bounded_local

MODES = ("hybrid", "semantic", "lexical")
MAX_LIMIT = 100
# Candidate sets up to this many rows (24 bytes each) are broadcast to the record table.
BROADCAST_HITS = 500_000


@dataclass(frozen=True)
class Index:
    """What a search reads.

    ``repositories``: one record per id, without the long text. ``vectors(id, embedding)`` and
    ``doc_terms(id, doc_len, terms[, tfs])`` also carry ``primary_language`` and ``stars``, so a
    filter is applied in their own scans. ``term_stats`` is optional and saves a corpus pass. A stored index
    (``store.read_index``) also has ``blocks``, postings of which a search reads its own terms, with the
    documents that do not count any more (``dead``); the number of stored vectors (``rows``); ``centres`` if
    its vectors lie in cells; and ``digests(id, digest)`` of the records.
    """

    repositories: DataFrame
    vectors: DataFrame
    doc_terms: DataFrame
    term_stats: DataFrame | None = None
    blocks: DataFrame | None = None
    dead: DataFrame | None = None
    digests: DataFrame | None = None
    centres: object | None = None
    rows: int | None = None


@dataclass(frozen=True)
class SearchResult:
    """``hits``: the page of every query. ``summary``: one row per query with its totals."""

    hits: DataFrame
    summary: DataFrame


def _check(index: Index, mode: str, sort_by: str, limit: int, offset: int, probes: int | None) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    fusion.sort_key(sort_by)
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}, not {limit}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    if probes is not None and (probes < 1 or index.centres is None):
        raise ValueError("probes needs an index whose vectors are stored in cells, and must be positive")


def retrieve(
    queries: DataFrame,
    index: Index,
    mode: str,
    n: int,
    language: str | None = None,
    min_stars: int = 0,
    idf: bool = True,
    measured: bool = False,
    probes: int | None = None,
) -> DataFrame:
    """Candidates of every query: (query_id, id, score, rank), at most ``n`` each."""
    if mode != "lexical":
        vectors = filter_hits(index.vectors, language, min_stars)
        if probes:
            dense = ann_topk(queries, vectors, index.centres, n, probes, measured=measured)
        elif index.rows is not None:
            dense = threshold_topk(queries, vectors, n, index.rows, measured=measured)
        else:
            dense = dense_topk(queries, vectors, n, measured=measured)
    if mode != "semantic" and index.blocks is not None and measured:
        lexical = blocks_topk(queries, index.blocks, index.term_stats, n, idf, language, min_stars, index.dead, measured=True)
    elif mode != "semantic":
        lexical = bm25_topk(
            queries,
            index.doc_terms,
            n,
            idf=idf,
            stats=index.term_stats,
            candidates=filter_hits(index.doc_terms, language, min_stars),
            measured=measured,
        )
    if mode == "semantic":
        return dense
    if mode == "lexical":
        return lexical
    fused = fusion.rank_hits(fusion.rrf([dense, lexical]))
    return fused.where(F.col("rank") <= n)


def score_candidates(
    queries: DataFrame,
    index: Index,
    mode: str = "hybrid",
    language: str | None = None,
    min_stars: int = 0,
    sort_by: str = "relevance",
    limit: int = 20,
    offset: int = 0,
    idf: bool = True,
    probes: int | None = None,
) -> DataFrame:
    """The whole candidate window of every query, blended and in final order (``position``)."""
    _check(index, mode, sort_by, limit, offset, probes)
    n = fusion.candidate_limit(offset, limit)
    local = bounded_local(queries, MAX_QUERIES, MAX_QUERY_BYTES)
    queries = queries if local is None else local
    found = retrieve(queries, index, mode, n, language, min_stars, idf, measured=local is not None, probes=probes)
    found = fusion.minmax_normalise(found)
    found = found.select("query_id", "id", "rank", "norm", "total")
    if local is not None and local.count() * n <= BROADCAST_HITS:
        found = F.broadcast(found)
    hits = index.repositories.join(found, "id")
    return fusion.order_hits(fusion.blend(hits, mode, language), sort_by)


def search(
    queries: DataFrame,
    index: Index,
    mode: str = "hybrid",
    language: str | None = None,
    min_stars: int = 0,
    sort_by: str = "relevance",
    limit: int = 20,
    offset: int = 0,
    idf: bool = True,
    probes: int | None = None,
) -> SearchResult:
    """Answer every row of ``queries(query_id, text, embedding)``.

    ``probes`` is the number of vector cells to look into, for an index that has them; without it every
    vector is compared.

    Filters apply before ranking. ``total`` is the size of the candidate window, and sorting by
    anything but relevance orders that window, not the corpus.
    """
    scored = score_candidates(queries, index, mode, language, min_stars, sort_by, limit, offset, idf, probes)
    totals = scored.where("position = 1").select("query_id", "total")
    total = F.coalesce("total", F.lit(0).cast("bigint"))
    shown = F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(limit).cast("bigint"), total - offset))
    summary = queries.join(totals, "query_id", "left").select(
        "query_id",
        F.col("text").alias("query"),
        F.lit(mode).alias("mode"),
        total.alias("total"),
        shown.alias("count"),
        F.lit(offset).alias("offset"),
        F.lit(limit).alias("limit"),
    )
    return SearchResult(hits=fusion.page(scored, offset, limit), summary=summary)


def page_after(
    queries: DataFrame,
    index: Index,
    after: DataFrame | None = None,
    mode: str = "semantic",
    limit: int = 20,
    language: str | None = None,
    min_stars: int = 0,
    idf: bool = True,
) -> DataFrame:
    """The next ``limit`` rows of every query's whole ranking: (query_id, id, score, rank in the page).

    ``after(query_id, score, id)`` is the last row of the page before; a query without one starts at the top.
    No window ends the pages: each is found by the place it continues behind, and reads no page before it.
    Fused ranks depend on both whole lists, so ``hybrid`` has no such pages.
    """
    _check(index, mode, "relevance", limit, 0, None)
    if mode == "hybrid":
        raise ValueError("pages continue in 'semantic' or 'lexical' mode")
    local = bounded_local(queries, MAX_QUERIES, MAX_QUERY_BYTES)
    if local is None:
        raise ValueError(f"pages continue for at most {MAX_QUERIES} queries at a time")
    # One row per query of the measured batch.
    places = {} if after is None else {r["query_id"]: (r["score"], r["id"]) for r in after.select("query_id", "score", "id").collect()}
    if mode == "lexical":
        kept = filter_hits(index.doc_terms, language, min_stars)
        return bm25_topk(local, index.doc_terms, limit, idf, index.term_stats, kept, measured=True, after=places)
    rows = [(q, s, i) for q, (s, i) in places.items()]
    held = queries.sparkSession.createDataFrame(rows, "query_id bigint, after_score double, after_id bigint")
    return dense_topk(local.join(held, "query_id", "left"), filter_hits(index.vectors, language, min_stars), limit, measured=True)


def search_report(queries: DataFrame, index: Index, top: int = 3, **options) -> DataFrame:
    """Per query: its total and the name, language, stars and scores of its first hits."""
    hits = search(queries, index, limit=top, **options).hits.select(
        "query_id", "total", "position", "name_with_owner", "primary_language", "stars",
        "score", "dense_score", "lexical_score", "metadata_score",
    )
    return queries.select("query_id").join(hits, "query_id", "left").fillna(0, ["total"])
