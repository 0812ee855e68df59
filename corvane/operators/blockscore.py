"""Score row blocks against a block of queries and keep each query's best rows.

Each task streams Arrow batches, scores a batch against all queries of a block with one matrix
product and keeps the running best ``n`` per query. Only those leave the task: the rows x queries
scores are never written as rows or shuffled.

Two ways to bring rows and queries together, both exact:

* ``broadcast``: the query block has been measured and is small; the corpus is scanned in place.
* ``grid``: any number of queries. Rows and queries are hashed into blocks of bounded size, each
  side is copied once per block of the other, and every (row block, query block) cell is one group.

The functions that run in the workers are nested and import what they need, so they are shipped by
value and executors do not need this package installed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HITS = "query_id bigint, id bigint, score double"

# A query batch is held locally and broadcast up to these sizes.
MAX_QUERIES = 1024
MAX_QUERY_BYTES = 16_000_000
# Grid cells: array values (vector entries or terms) per block of rows.
GRID_VALUES = 8_000_000


def best_rows(score_batch: Callable, n: int) -> Callable:
    """Worker function: batches and a query block in, one batch with the best rows out.

    A block may name each query's ``floor``, a score that ``n`` rows elsewhere reach: lower rows do not leave
    the task; and the place ``after`` which a page continues (``after_score``, ``after_id``).
    """

    def run(batches, block):
        import numpy as np
        import pyarrow as pa

        queries = np.asarray(block["query_ids"], dtype="int64")
        floor = np.array(block["floor"], dtype="float64") if "floor" in block else np.full(len(queries), -np.inf)
        held = [(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))]
        room = max(1 << 18, 4 * n * len(queries))

        def best():
            q, i, s = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((i, -s, q))
            q, i, s = q[order], i[order], s[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            last = place == n - 1
            floor[q[last]] = np.maximum(floor[q[last]], s[last])
            keep = place < n
            return q[keep], i[keep], s[keep]

        for batch in batches:
            for low in range(0, batch.num_rows, block["step"]):
                part = batch.slice(low, block["step"])
                ids = part.column(0).to_numpy(zero_copy_only=False)
                scores = score_batch(part, block)
                if "after_score" in block:
                    later = (scores < block["after_score"]) | ((scores == block["after_score"]) & (ids[:, None] > block["after_id"]))
                    scores = np.where(later, scores, -np.inf)
                if len(ids) > n:
                    # The n-th best of these rows alone is a floor, too. Rows equal to it stay: ids decide.
                    floor = np.maximum(floor, np.partition(scores, len(ids) - n, axis=0)[len(ids) - n])
                r, q = np.nonzero((scores >= floor) & (scores > -np.inf))
                held.append((q, ids[r], scores[r, q]))
                if sum(len(x[0]) for x in held) > room:
                    held[:] = [best()]
        q, i, s = best()
        yield pa.RecordBatch.from_arrays([pa.array(queries[q]), pa.array(i.astype("int64")), pa.array(s)], names=["query_id", "id", "score"])

    return run


def top_n_per_key(hits: DataFrame, n: int, spread: int | None = None) -> DataFrame:
    """Best ``n`` rows per query by score, ties by id, with their ``rank`` from 1.

    Every task sends up to ``n`` rows per query, so with many tasks one query can receive far
    more than ``n``: a first cut per (query, salt) bounds what the final per-query cut sees.
    """
    if spread is None:
        spread = max(1, int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16)
    order = [F.desc("score"), F.asc("id")]
    if spread > 1:
        salted = Window.partitionBy("query_id", "_salt").orderBy(*order)
        hits = (
            hits.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(spread)))
            .withColumn("_n", F.row_number().over(salted))
            .where(F.col("_n") <= n)
            .drop("_n", "_salt")
        )
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def broadcast_top(rows: DataFrame, queries, build_block: Callable, score_batch: Callable, n: int) -> DataFrame:
    """Per-task best rows against one measured query table (Arrow)."""
    spark = rows.sparkSession
    if queries.num_rows == 0:
        return spark.createDataFrame([], HITS)
    shared = spark.sparkContext.broadcast(build_block(queries))
    run = best_rows(score_batch, n)

    def task(batches):
        yield from run(batches, shared.value)

    return rows.mapInArrow(task, HITS)


def grid_top(
    rows: DataFrame,
    queries: DataFrame,
    build_block: Callable,
    score_batch: Callable,
    n: int,
    values: str,
    block_values: int = GRID_VALUES,
    block_queries: int = MAX_QUERIES,
) -> DataFrame:
    """Per-cell best rows for any number of queries; ``values`` names the rows' array column.

    Blocks are sized by the total length of that array and filled by a hash of the unique id.
    """
    total = rows.agg(F.sum(F.size(values)).alias("n")).first()["n"] or 0
    row_blocks = max(1, math.ceil(total / block_values))
    query_blocks = max(1, math.ceil(queries.select("query_id").distinct().count() / block_queries))

    def block_of(key: str, n_blocks: int, name: str):
        return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int").alias(name)

    def every_block(n_blocks: int, name: str):
        return F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias(name)

    left = rows.select("*", block_of("id", row_blocks, "_rb"), every_block(query_blocks, "_qb"))
    right = queries.select("*", block_of("query_id", query_blocks, "_qb"), every_block(row_blocks, "_rb"))
    run = best_rows(score_batch, n)

    def cell(row_table, query_table):
        import pyarrow as pa

        if row_table.num_rows == 0 or query_table.num_rows == 0:
            return pa.table({"query_id": pa.array([], "int64"), "id": pa.array([], "int64"), "score": pa.array([], "float64")})
        block = build_block(query_table.drop_columns(["_qb", "_rb"]))
        return pa.Table.from_batches(run(row_table.drop_columns(["_rb", "_qb"]).to_batches(), block))

    return left.groupBy("_rb", "_qb").cogroup(right.groupBy("_rb", "_qb")).applyInArrow(cell, HITS)
