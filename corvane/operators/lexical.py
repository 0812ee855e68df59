"""Tokens, postings, corpus statistics and BM25 top-k."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import tokenize
from corvane.operators import blockscore
from corvane.session import bounded_local

# BM25 saturation and length weight.
K1 = 1.2
B = 0.75
SCORE_DIGITS = 6
# Tokens counted at a time, and cells of a scored step: what a worker holds follows them, not the batch.
COUNT_TOKENS = 250_000
SCORE_CELLS = 1_000_000
# ``term_stats`` keeps the corpus totals under the one key that no token can have.
TOTALS = ""


def doc_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents with ``terms`` (every token in order) in place of their text, and ``doc_len``."""
    return docs.withColumn("terms", tokenize(F.col(text_col))).drop(text_col).withColumn("doc_len", F.size("terms"))


def build_postings(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(id, term, tf). A document is one row, so its terms are counted in place: no shuffle."""
    counted = count_terms(doc_tokens(docs.select("id", text_col), text_col))
    return counted.select("id", F.inline(F.arrays_zip("terms", "tfs"))).select(
        "id", F.col("terms").alias("term"), F.col("tfs").cast("bigint").alias("tf")
    )


def term_stats(tokens: DataFrame) -> DataFrame:
    """(term, df, total_len) over tokenised documents.

    The row for the empty term counts documents and sums their lengths, so that one pass over
    the corpus gives document frequencies and totals. Partial aggregation leaves one row per
    term and task before the shuffle, however common the term.
    """
    terms = F.concat(F.array(F.lit(TOTALS)), F.array_distinct("terms"))
    return (
        tokens.select("doc_len", F.explode(terms).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"), F.sum("doc_len").alias("total_len"))
    )


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """Per term: document frequency, with corpus size and average length beside it."""
    totals = tokens.agg(F.struct(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len")))
    return (
        term_stats(tokens)
        .where(F.col("term") != TOTALS)
        .select("term", "df", totals.scalar().alias("totals"))
        .select("term", "df", "totals.n_docs", "totals.avg_len")
    )


def count_terms(tokens: DataFrame) -> DataFrame:
    """Compact index rows: each distinct term of a document once, with its count in ``tfs``."""
    most = COUNT_TOKENS

    def steps(batches):
        import numpy as np

        for batch in batches:
            ends = np.cumsum(batch.column("terms").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("int64"))
            low, done = 0, 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(ends, done + most, "right")))
                yield batch.slice(low, high - low)
                low, done = high, ends[high - 1]

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in steps(batches):
            terms = batch.column("terms")
            row = np.repeat(np.arange(batch.num_rows), terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            words = terms.flatten().dictionary_encode()
            width = max(1, len(words.dictionary))
            pairs, counts = np.unique(row * width + words.indices.to_numpy(), return_counts=True)
            ends = np.searchsorted(pairs // width, np.arange(batch.num_rows + 1)).astype("int32")
            distinct = words.dictionary.take(pa.array(pairs % width))
            columns = {name: batch.column(name) for name in batch.schema.names}
            columns["terms"] = pa.ListArray.from_arrays(pa.array(ends), distinct)
            columns["tfs"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(counts.astype("int32")))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(count, f"{fields}, tfs array<int>")


def _builder() -> Callable:
    """Worker function: Arrow table (query_id, term, weight) to a query block."""
    cells = SCORE_CELLS

    def build(table):
        import numpy as np

        ids, query = np.unique(table.column("query_id").to_numpy(), return_inverse=True)
        words = table.column("term").combine_chunks().dictionary_encode()
        code = words.indices.to_numpy()
        order = np.lexsort((query, code))
        return {
            "query_ids": ids,
            "vocabulary": words.dictionary,
            "start": np.searchsorted(code[order], np.arange(len(words.dictionary) + 1)),
            "query": query[order],
            "weight": table.column("weight").to_numpy()[order],
            # A row matches each (query, term) at most once: this bounds cells and matches.
            "step": max(1, cells // max(1, len(ids), len(code))),
        }

    return build


def query_block(table) -> dict:
    """The query block of weighted terms (Arrow), made on the driver."""
    return _builder()(table)


def _scorer(avg_len: float, k1: float, b: float, digits: int) -> Callable:
    """Worker function: BM25 of a batch (id, doc_len, terms[, tfs]) with every query of a block."""

    def score(batch, block):
        import numpy as np
        import pyarrow.compute as pc

        terms = batch.column(2)
        row = np.repeat(np.arange(batch.num_rows), terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        words = terms.flatten()
        code = pc.index_in(words, value_set=block["vocabulary"].cast(words.type)).fill_null(-1)
        code = code.to_numpy(zero_copy_only=False)
        known = code >= 0
        width = max(1, len(block["vocabulary"]))
        pairs, inverse = np.unique(row[known] * width + code[known], return_inverse=True)
        times = None
        if batch.num_columns > 3:
            times = batch.column(3).flatten().to_numpy(zero_copy_only=False)[known]
        tf = np.bincount(inverse, weights=times, minlength=len(pairs)).astype("float64")
        r, t = pairs // width, pairs % width
        length = batch.column(1).to_numpy(zero_copy_only=False).astype("float64")[r]
        gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_len))
        # One entry per (row, query) that shares the term, summed within the batch.
        fan = block["start"][t + 1] - block["start"][t]
        first = np.repeat(block["start"][t] - np.cumsum(fan) + fan, fan)
        entry = first + np.arange(fan.sum())
        n_queries = len(block["query_ids"])
        cell = np.repeat(r, fan) * n_queries + block["query"][entry]
        raw = np.bincount(cell, weights=np.repeat(gain, fan) * block["weight"][entry], minlength=batch.num_rows * n_queries)
        raw = raw.reshape(batch.num_rows, n_queries)
        return np.where(raw > 0, np.round(raw, digits), -np.inf)

    return score


def weigh_queries(asked: DataFrame, stats: DataFrame, n_docs: int, avg_len: float, idf: bool = True) -> DataFrame:
    """(query_id, term, weight): IDF of each distinct term, or its saturated count without IDF.

    Terms that no document holds drop out. With IDF off, the query side is weighted the way a
    document is, with the query's own length.
    """
    tf, length = F.col("tf"), F.col("query_len")
    if idf:
        weight = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    else:
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_len))
    return asked.join(stats, "term").select("query_id", "term", weight.alias("weight"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, query_len, term, tf) of ``queries`` (query_id, text)."""
    tokens = queries.select("query_id", tokenize(F.col("text")).alias("t"))
    split = tokens.select("query_id", F.size("t").alias("query_len"), F.explode("t").alias("term"))
    return split.groupBy("query_id", "query_len", "term").agg(F.count("*").alias("tf"))


def bm25_topk(
    queries: DataFrame,
    doc_terms: DataFrame,
    n: int,
    idf: bool = True,
    stats: DataFrame | None = None,
    candidates: DataFrame | None = None,
    max_queries: int = blockscore.MAX_QUERIES,
    block_values: int = blockscore.GRID_VALUES,
    measured: bool = False,
    after: dict[int, tuple[float, int]] | None = None,
) -> DataFrame:
    """BM25 top ``n`` per query: (query_id, id, score, rank); only rows that share a term.

    ``queries(query_id, text)``; ``doc_terms(id, doc_len, terms[, tfs])`` from ``doc_tokens`` or
    ``count_terms``. Statistics cover all of ``doc_terms`` (or come ready-made in ``stats``);
    ``candidates`` is the filtered part to rank, by default all. ``measured`` says that ``queries``
    already comes from ``bounded_local``. ``after`` names the (score, id) that a measured query continues behind.
    """
    spark = queries.sparkSession
    stats = term_stats(doc_terms) if stats is None else stats
    rows = doc_terms if candidates is None else candidates
    rows = rows.select(*[c for c in ("id", "doc_len", "terms", "tfs") if c in rows.columns])
    queries = queries.select("query_id", "text")
    local = queries if measured else bounded_local(queries, max_queries, blockscore.MAX_QUERY_BYTES)
    asked = query_terms(queries if local is None else local)
    if local is not None:
        # The batch is small: fetch only its own words' statistics, and weigh it locally.
        asked = spark.createDataFrame(asked.toArrow(), asked.schema)
        words = asked.select("term").union(spark.createDataFrame([(TOTALS,)], "term string"))
        stats = stats.join(F.broadcast(words.distinct()), "term", "left_semi")
        stats = spark.createDataFrame(stats.toArrow(), stats.schema)
    totals = stats.where(F.col("term") == TOTALS).first()
    if totals is None or not totals["total_len"]:
        return blockscore.top_n_per_key(spark.createDataFrame([], blockscore.HITS), n)
    avg_len = totals["total_len"] / totals["df"]
    weighted = weigh_queries(asked, stats, totals["df"], avg_len, idf)
    build, score = _builder(), _scorer(avg_len, K1, B, SCORE_DIGITS)
    if local is None:
        # Rows are copied once per query block: send counted terms, not every token.
        rows = rows if "tfs" in rows.columns else count_terms(rows)
        hits = blockscore.grid_top(rows, weighted, build, score, n, "terms", block_values, max_queries)
    else:
        hits = blockscore.broadcast_top(rows, weighted.toArrow(), continued(build, after), score, n)
    return blockscore.top_n_per_key(hits, n)


def continued(build: Callable, after: dict[int, tuple[float, int]] | None) -> Callable:
    """``build`` with the places that pages continue behind."""

    def built(table):
        import numpy as np

        block = build(table)
        if after is not None:
            places = [after.get(int(q), (np.inf, -1)) for q in block["query_ids"]]
            block["after_score"], block["after_id"] = (np.array(x) for x in zip(*places))
        return block

    return built
