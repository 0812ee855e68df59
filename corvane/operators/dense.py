"""Cosine top-k: exact, and approximate through a coarse cell index."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.vectors import l2_normalise
from corvane.operators import blockscore
from corvane.session import bounded_local, materialise

# Scores are rounded before ranking, so equal vectors tie exactly and ids decide.
SCORE_DIGITS = 6
# Columns of a query that bound the scores it takes: what ``n`` rows reach already, and the row a page follows.
PLACES = ("floor", "after_score", "after_id")
# How much larger each part of a search by parts is than those before.
PART_RATIO = 4
# Rows of the sample that places the cell centres.
TRAIN_ROWS = 200_000


def _builder() -> Callable:
    """Worker function: Arrow table (query_id, embedding[, cells]) to a query block."""

    def build(table):
        import numpy as np

        ids = table.column("query_id").to_numpy()
        flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        matrix = flat.astype("float64").reshape(len(ids), -1)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
        block = {
            "query_ids": ids,
            "matrix": matrix.T.copy(),
            "step": max(1, 4_000_000 // max(1, len(ids))),
        }
        for name, missing in (("floor", -np.inf), ("after_score", np.inf), ("after_id", -1)):
            if name in table.column_names:
                block[name] = table.column(name).combine_chunks().fill_null(missing).to_numpy(zero_copy_only=False)
        if "cells" in table.column_names:
            cells = table.column("cells").to_pylist()
            block["wanted"] = np.zeros((1 + max((max(c, default=0) for c in cells), default=0), len(ids)), dtype=bool)
            for q, probed in enumerate(cells):
                block["wanted"][[c for c in probed if c >= 0], q] = True
        return block

    return build


def _scorer(digits: int) -> Callable:
    """Worker function: cosine of a batch (id, embedding[, cell]) with every query of a block."""

    def score(batch, block):
        import numpy as np

        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        matrix = flat.astype("float64").reshape(batch.num_rows, -1)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
        scores = np.round(matrix @ block["matrix"], digits)
        if "wanted" in block:
            cell = batch.column(2).to_numpy(zero_copy_only=False)
            inside = (cell >= 0) & (cell < len(block["wanted"]))
            wanted = block["wanted"][np.where(inside, cell, 0)] & inside[:, None]
            scores = np.where(wanted, scores, -np.inf)
        return scores

    return score


def dense_topk(
    queries: DataFrame,
    vectors: DataFrame,
    n: int,
    max_queries: int = blockscore.MAX_QUERIES,
    block_values: int = blockscore.GRID_VALUES,
    measured: bool = False,
) -> DataFrame:
    """Exact cosine top ``n`` per query: (query_id, id, score, rank).

    ``queries(query_id, embedding)``, ``vectors(id, embedding)``; filter ``vectors`` first.
    ``measured`` says that ``queries`` already comes from ``bounded_local``.
    """
    wanted = [c for c in ("query_id", "embedding", "cells", *PLACES) if c in queries.columns]
    queries = queries.where("embedding IS NOT NULL").select(*wanted)
    rows = vectors.where("embedding IS NOT NULL").select(*[c for c in ("id", "embedding", "cell") if c in vectors.columns])
    local = queries if measured else bounded_local(queries, max_queries, blockscore.MAX_QUERY_BYTES)
    build, score = _builder(), _scorer(SCORE_DIGITS)
    if local is None:
        hits = blockscore.grid_top(rows, queries, build, score, n, "embedding", block_values, max_queries)
    else:
        hits = blockscore.broadcast_top(rows, local.toArrow(), build, score, n)
    return blockscore.top_n_per_key(hits, n)


def part_bounds(n: int, total: int, ratio: int = PART_RATIO) -> list[float]:
    """Shares of the rows at which the parts of a search end: first ``4 n`` rows, then ``ratio`` times as many."""
    bounds, share = [0.0], 4 * n / max(1, total)
    while share < 1:
        bounds.append(share)
        share *= ratio
    return [*bounds, 1.0]


def threshold_topk(queries: DataFrame, vectors: DataFrame, n: int, total: int, measured: bool = False) -> DataFrame:
    """``dense_topk`` by parts: each part's n-th best scores are the floors of the next, larger one.

    Parts are cut by a hash of the id, so they are samples: of every part about ``PART_RATIO * n`` rows a
    query reach the floor, however many tasks score it. Every row is scored once, and scanned once a part. ``total`` need not be exact; it only sizes the parts.
    """
    queries = queries.where("embedding IS NOT NULL").select("query_id", "embedding")
    local = queries if measured else bounded_local(queries, blockscore.MAX_QUERIES, blockscore.MAX_QUERY_BYTES)
    if local is None:
        return dense_topk(queries, vectors, n)
    rows = vectors.where("embedding IS NOT NULL").select("id", "embedding")
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    bounds = part_bounds(n, total)
    parts = [rows.where((share >= low) & (share < high)) for low, high in zip(bounds, bounds[1:])]
    return floored_parts(local.toArrow(), parts, n)


def floored_parts(table, parts: list, n: int) -> DataFrame:
    """Top ``n`` of queries (Arrow) over ``parts``, rows or (rows, queries) each; floors pass from one part to the next."""
    build, score, found, floors = _builder(), _scorer(SCORE_DIGITS), None, {}
    for k, part in enumerate(parts):
        rows, own = part if isinstance(part, tuple) else (part, table)
        asked = own.append_column("floor", pa.array([floors.get(q) for q in own.column("query_id").to_pylist()], pa.float64()))
        hits = blockscore.broadcast_top(rows, asked, build, score, n)
        top = blockscore.top_n_per_key(hits if found is None else hits.unionByName(found), n)
        if k < len(parts) - 1:
            found = materialise(top, "part")
            # One row per query of the measured batch.
            floors = {r["query_id"]: r["score"] for r in found.where(F.col("rank") == n).select("query_id", "score").collect()}
            found = found.drop("rank")
    return top


def train_cells(vectors: DataFrame, cells: int, seed: int = 42, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Cell centres for the approximate index, from a bounded sample of the vectors.

    The sample is written out once: every training round reads it, not the table.
    """
    total = vectors.count()
    sample = vectors if total <= train_rows else vectors.sample(fraction=train_rows / total, seed=seed)
    kept = materialise(sample.where("embedding IS NOT NULL").select("embedding"), "train")
    points = kept.select(array_to_vector(l2_normalise(F.col("embedding"))).alias("features"))
    return np.array(KMeans(k=cells, seed=seed, maxIter=10, initMode="random").fit(points).clusterCenters())


def assign_cells(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """Add each vector's ``cell`` (-1 without one); write the result partitioned by it to scan only probed cells."""
    return df.withColumn("cell", F.coalesce(F.get(nearest_cells(centres, 1)("embedding"), F.lit(0)), F.lit(-1)))


def ann_topk(queries: DataFrame, vectors: DataFrame, centres: np.ndarray, n: int, probes: int, measured: bool = False) -> DataFrame:
    """Approximate cosine top ``n``: only vectors in the ``probes`` cells nearest to the query.

    Scores are exact cosines, and with every cell probed the result equals ``dense_topk``. ``vectors`` carries
    ``cell`` (``assign_cells``): the probed cells are a join, so of a table partitioned by cell only their
    folders are read. Every query's nearest cell comes first and gives the floors for its others.
    """
    queries = queries.where("embedding IS NOT NULL").select("query_id", "embedding")
    probed = queries.withColumn("cells", nearest_cells(centres, probes)("embedding"))
    local = bounded_local(queries, blockscore.MAX_QUERIES, blockscore.MAX_QUERY_BYTES) if not measured else queries
    if local is None:
        kept = materialise(probed, "probed")
        return dense_topk(kept, in_cells(vectors, kept.select(F.explode("cells").alias("cell"))), n)
    table = local.withColumn("cells", nearest_cells(centres, probes)("embedding")).toArrow()
    chosen = table.column("cells").to_pylist()
    parts = []
    for own in ([c[:1] for c in chosen], [c[1:] for c in chosen]):
        cells = sorted({c for x in own for c in x})
        if cells:
            listed = queries.sparkSession.createDataFrame([(c,) for c in cells], "cell int")
            asked = table.set_column(table.column_names.index("cells"), "cells", pa.chunked_array([pa.array(own, pa.list_(pa.int32()))]))
            parts.append((in_cells(vectors, listed), asked))
    rows = [(v.where("embedding IS NOT NULL").select("id", "embedding", "cell"), t) for v, t in parts]
    return floored_parts(table, rows, n) if rows else dense_topk(queries, vectors.where("false"), n)


def in_cells(vectors: DataFrame, cells: DataFrame) -> DataFrame:
    """The vectors of some cells; there is at most one row for each cell of the index, a build parameter."""
    listed = materialise(cells.distinct(), "cells")
    return vectors.join(F.broadcast(listed.where("cell >= -1")), "cell", "left_semi")


def nearest_cells(centres: np.ndarray, probes: int) -> Callable:
    """Arrow UDF: the numbers of the cells whose centres lie nearest to a unit-scaled vector."""
    centres = np.asarray(centres, dtype="float64")

    @F.pandas_udf("array<int>")
    def nearest(embedding: pd.Series) -> pd.Series:
        known = embedding.notna().to_numpy()
        out = [None] * len(embedding)
        if known.any():
            points = np.stack([np.asarray(v, dtype="float64") for v in embedding[known]])
            points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
            distance = (centres**2).sum(axis=1) - 2 * points @ centres.T
            for at, cells in zip(np.flatnonzero(known), np.argsort(distance, axis=1, kind="stable")[:, :probes]):
                out[at] = cells.tolist()
        return pd.Series(out, dtype=object)

    return nearest
