"""Stored inverted lists in blocks, and their search with block-max thresholds.

A list is one term's documents, dealt to shards of documents by a hash of the id and cut into blocks of
``BLOCK_DOCS``, the most frequent and shortest documents first. A block carries the largest count and the
least length in it, which bound its BM25 gain whatever the average length has become since.

A search reads the lists of its own terms only, in two passes:

1. the first block of every list gives each query a floor: the n-th best score found there. Sums over
   some blocks never exceed the true ones, so the n-th best of all is not lower;
2. of a query's term, only blocks matter whose bound, with the best of all the other terms, reaches the
   floor. A document at or above the floor lies in no other block, so its score is complete; the rest is
   skipped before it is shuffled.

Blocks meet by shard, so a document's terms come together without a row for every query. As in the other
scorers, worker functions are nested and import what they need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import blockscore
from corvane.operators.lexical import K1, B, SCORE_DIGITS, TOTALS, query_block, query_terms, weigh_queries
from corvane.session import bounded_local

BLOCK_DOCS = 128
SHARD_DOCS = 8192
#: Postings of a shard, about: longer documents make smaller shards, as one task holds a shard.
SHARD_ENTRIES = 1 << 20
#: Postings of a written file, about, and of the sample that finds where files begin.
FILE_ENTRIES = 1 << 21
SAMPLED_ENTRIES = 200_000
#: Terms that are pushed to the scan as a list; more are given by their range and a broadcast join.
LISTED_TERMS = 2000
#: Scores are rounded: a bound must miss a floor by more than that.
MARGIN = 1e-6

BLOCKS = (
    "term string, shard int, block int, max_tf int, min_len int, max_stars bigint, "
    "ids array<bigint>, tfs array<int>, lens array<int>, languages array<string>, stars array<bigint>"
)


def shard_count(n_docs: int, n_entries: int = 0) -> int:
    """Shards of so many documents with so many postings."""
    return max(1, -(-n_docs // SHARD_DOCS), -(-n_entries // SHARD_ENTRIES))


def build_blocks(doc_terms: DataFrame, n_docs: int, n_entries: int = 0, bounds: list[tuple[str, int]] | None = None) -> DataFrame:
    """``BLOCKS`` of counted documents (id, doc_len, terms, tfs, primary_language, stars); one shuffle of these rows.

    With ``bounds``, sorted (term, shard), also ``part``: how many of them a block follows or equals.
    """
    shards = shard_count(n_docs, n_entries)
    size = BLOCK_DOCS

    def cut(table):
        from bisect import bisect_right

        import numpy as np
        import pyarrow as pa

        def flat(name):
            column = table.column(name)
            return (column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()).flatten()

        terms = table.column("terms").combine_chunks()
        row = np.repeat(np.arange(table.num_rows), terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        words = flat("terms").dictionary_encode()
        code, tf = words.indices.to_numpy(), flat("tfs").to_numpy()
        ids, lens = table.column("id").to_numpy(), table.column("doc_len").to_numpy()
        # Documents by length and id: their places order the postings of a term and count.
        by_length = np.empty(table.num_rows, np.int64)
        by_length[np.lexsort((ids, lens))] = np.arange(table.num_rows)
        largest = int(tf.max(initial=0))
        if (len(words.dictionary) + 1) * (largest + 1) * (table.num_rows + 1) < 1 << 62:
            order = np.argsort((code.astype(np.int64) * (largest + 1) + (largest - tf)) * table.num_rows + by_length[row])
        else:
            order = np.lexsort((by_length[row], -tf, code))
        row, code, tf = row[order], code[order], tf[order]
        new = np.flatnonzero(np.diff(code, prepend=-1))
        place = np.arange(len(code)) - np.repeat(new, np.diff(np.append(new, len(code))))
        starts = np.flatnonzero(place % size == 0)
        ends = pa.array(np.append(starts, len(code)).astype("int32"))

        def lists(values):
            return pa.ListArray.from_arrays(ends, values)

        taken = pa.array(row)
        stars = table.column("stars").combine_chunks().take(taken)
        columns = {
            "term": words.dictionary.take(pa.array(code[starts])),
            "shard": pa.array(np.full(len(starts), table.column("shard")[0].as_py() if len(row) else 0, np.int32)),
            "block": pa.array((place[starts] // size).astype(np.int32)),
            "max_tf": pa.array(tf[starts].astype(np.int32)),
            "min_len": pa.array(np.minimum.reduceat(lens[row], starts).astype(np.int32) if len(starts) else np.zeros(0, np.int32)),
            "max_stars": pa.array(
                np.maximum.reduceat(stars.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), starts)
                if len(starts)
                else np.zeros(0, np.int64)
            ),
            "ids": lists(pa.array(ids[row])),
            "tfs": lists(pa.array(tf.astype(np.int32))),
            "lens": lists(pa.array(lens[row].astype(np.int32))),
            "languages": lists(table.column("primary_language").combine_chunks().take(taken)),
            "stars": lists(stars),
        }
        if bounds is not None:
            at = zip(columns["term"].to_pylist(), columns["shard"].to_pylist())
            columns["part"] = pa.array([bisect_right(bounds, x) for x in at], pa.int32())
        return pa.table(columns)

    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")
    rows = doc_terms.select(shard, "id", "doc_len", "terms", "tfs", "primary_language", F.col("stars").cast("bigint").alias("stars"))
    return rows.groupBy("shard").applyInArrow(cut, BLOCKS if bounds is None else f"{BLOCKS}, part int")


def part_bounds(doc_terms: DataFrame, n_docs: int, n_entries: int, parts: int) -> list[tuple[str, int]]:
    """(term, shard) at which about equal parts of the postings begin, from a sample of bounded size.

    They steer the sizes of files only. A common term begins several parts.
    """
    if parts < 2:
        return []
    share = SAMPLED_ENTRIES / max(1, n_entries)
    docs = doc_terms if share >= 1 else doc_terms.sample(fraction=share, seed=42)
    shard = F.pmod(F.xxhash64("id"), F.lit(shard_count(n_docs, n_entries))).cast("int").alias("shard")
    found = docs.select(F.explode("terms").alias("term"), shard).limit(4 * SAMPLED_ENTRIES).toArrow()
    rows = sorted(zip(found.column("term").to_pylist(), found.column("shard").to_pylist()))
    return sorted({rows[k * len(rows) // parts] for k in range(1, parts)}) if rows else []


def block_stats(blocks: DataFrame) -> DataFrame:
    """(term, df, total_len) of the documents in ``blocks``, as ``term_stats`` gives them for each term."""
    length = F.aggregate("lens", F.lit(0).cast("bigint"), lambda total, x: total + x)
    rows = blocks.select("term", F.size("ids").cast("bigint").alias("df"), length.alias("total_len"))
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total_len").alias("total_len"))


def gain(tf: Column, length: Column, avg_len: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_len))


def only_terms(df: DataFrame, words: list[str]) -> DataFrame:
    """The rows of these terms; the condition reaches the scan."""
    if len(words) <= LISTED_TERMS:
        return df.where(F.col("term").isin(words))
    listed = df.sparkSession.createDataFrame([(w,) for w in words], "term string")
    return df.where(F.col("term").between(min(words), max(words))).join(F.broadcast(listed), "term", "left_semi")


def block_thresholds(weights, most: dict[str, float], floors: dict[int, float]) -> dict[str, float]:
    """Per term the least gain of a block that can still matter to a query of ``weights`` (query_id, term, weight)."""
    by_query: dict[int, list[tuple[str, float]]] = {}
    for query_id, term, weight in weights:
        by_query.setdefault(query_id, []).append((term, weight))
    least: dict[str, float] = {}
    for query_id, own in by_query.items():
        whole = sum(w * most.get(t, 0.0) for t, w in own)
        for term, weight in own:
            need = float("-inf")
            if query_id in floors:
                need = (floors[query_id] - MARGIN - (whole - weight * most.get(term, 0.0))) / weight
            least[term] = min(need, least.get(term, float("inf")))
    return least


def _scorer(shared, language: str | None, min_stars: int, avg_len: float, n: int):
    """Worker function: the blocks of a shard in, the best rows of every query out."""
    k1, b, digits = K1, B, SCORE_DIGITS

    def score(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        block = shared.value
        queries, floor = np.asarray(block["query_ids"], dtype="int64"), block["floor"]
        terms = table.column("term").combine_chunks()
        code = pc.index_in(terms, value_set=block["vocabulary"].cast(terms.type)).fill_null(-1).to_numpy(zero_copy_only=False)
        lists = table.column("ids").combine_chunks()
        of = np.repeat(np.arange(len(code)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        known = code[of] >= 0
        keep = known.copy()
        # A row without a term lists ids that later segments have replaced.
        gone = ids[terms.is_null().to_numpy(zero_copy_only=False)[of]]
        if len(gone):
            keep &= ~np.isin(ids, gone)

        def flat(name):
            return table.column(name).combine_chunks().flatten()

        if language is not None:
            keep[known] &= pc.equal(flat("languages"), language).fill_null(False).to_numpy(zero_copy_only=False)
        if min_stars > 0:
            keep[known] &= pc.greater_equal(flat("stars"), min_stars).fill_null(False).to_numpy(zero_copy_only=False)
        tf, length = (flat(c).to_numpy(zero_copy_only=False)[keep[known]].astype("float64") for c in ("tfs", "lens"))
        t, docs = code[of][keep], ids[keep]
        gains = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_len))
        docs, row = np.unique(docs, return_inverse=True)
        order = np.argsort(row, kind="stable")
        row, t, gains = row[order], t[order], gains[order]
        found = []
        width = max(1, 4_000_000 // max(1, len(queries)))
        for low in range(0, len(docs), width):
            at = slice(*np.searchsorted(row, [low, low + width]))
            rows = min(width, len(docs) - low)
            start, fan = block["start"][t[at]], block["start"][t[at] + 1] - block["start"][t[at]]
            entry = np.repeat(start - np.cumsum(fan) + fan, fan) + np.arange(fan.sum())
            cell = np.repeat(row[at] - low, fan) * len(queries) + block["query"][entry]
            raw = np.bincount(cell, weights=np.repeat(gains[at], fan) * block["weight"][entry], minlength=rows * len(queries))
            raw = np.round(raw.reshape(rows, len(queries)), digits)
            d, q = np.nonzero((raw > 0) & (raw >= floor))
            found.append((q, docs[low + d], raw[d, q]))
        q, i, s = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, "int64"), np.zeros(0))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < n
        return pa.table({"query_id": pa.array(queries[q[best]]), "id": pa.array(i[best].astype("int64")), "score": pa.array(s[best])})

    return score


def blocks_topk(
    queries: DataFrame,
    blocks: DataFrame,
    stats: DataFrame,
    n: int,
    idf: bool = True,
    language: str | None = None,
    min_stars: int = 0,
    dead: DataFrame | None = None,
    measured: bool = False,
) -> DataFrame:
    """BM25 top ``n`` per query over stored blocks: (query_id, id, score, rank), equal to ``bm25_topk``.

    ``blocks`` may carry ``segment``; ``dead(segment, shard, id)`` names documents that do not count any more.
    ``stats(term, df, total_len)`` covers all living documents. ``queries`` is a measured batch or one that
    fits the bounds of a batch.
    """
    spark = queries.sparkSession
    local = queries if measured else bounded_local(queries.select("query_id", "text"), blockscore.MAX_QUERIES, blockscore.MAX_QUERY_BYTES)
    if local is None:
        raise ValueError("too many queries for one batch: search the stored term rows instead")
    none = blockscore.top_n_per_key(spark.createDataFrame([], blockscore.HITS), n)
    asked = query_terms(local)
    asked = spark.createDataFrame(asked.toArrow(), asked.schema)
    words = sorted(r["term"] for r in asked.select("term").distinct().collect())
    known = only_terms(stats, [TOTALS, *words])
    known = spark.createDataFrame(known.toArrow(), known.schema)
    totals = known.where(F.col("term") == TOTALS).first()
    if not words or totals is None or not totals["total_len"]:
        return none
    avg_len = totals["total_len"] / totals["df"]
    weighted = weigh_queries(asked, known, totals["df"], avg_len, idf).toArrow()
    if not weighted.num_rows:
        return none
    words = sorted(set(weighted.column("term").to_pylist()))
    bound = gain(F.col("max_tf"), F.col("min_len"), avg_len)
    own = only_terms(blocks, words)
    if min_stars > 0:
        own = own.where(F.col("max_stars") >= min_stars)
    if "segment" not in own.columns:
        own = own.withColumn("segment", F.lit(""))
    language = None if not language or language.lower() == "all" else language
    columns = ["segment", "shard", "term", "ids", "tfs", "lens", *["languages"] * bool(language), *["stars"] * (min_stars > 0)]

    def scored(part: DataFrame, floors: dict[int, float]) -> DataFrame:
        block = query_block(weighted)
        import numpy as np

        block["floor"] = np.array([floors.get(int(q), -np.inf) for q in block["query_ids"]])
        shared = spark.sparkContext.broadcast(block)
        rows = part.select(*columns)
        if dead is not None:
            lists = dead.groupBy("segment", "shard").agg(F.collect_list("id").alias("ids"))
            rows = rows.unionByName(lists, allowMissingColumns=True)
        hits = rows.groupBy("segment", "shard").applyInArrow(_scorer(shared, language, min_stars, avg_len, n), blockscore.HITS)
        return blockscore.top_n_per_key(hits, n)

    floors = {r["query_id"]: r["score"] for r in scored(own.where("block = 0"), {}).where(F.col("rank") == n).collect()}
    if floors:
        # One row per term of the batch.
        most = {r["term"]: r["most"] for r in own.groupBy("term").agg(F.max(bound).alias("most")).collect()}
        rows = zip(*(weighted.column(c).to_pylist() for c in ("query_id", "term", "weight")))
        least = spark.createDataFrame(list(block_thresholds(rows, most, floors).items()), "term string, least double")
        own = own.join(F.broadcast(least), "term").where(bound >= F.col("least"))
    return scored(own, floors)
