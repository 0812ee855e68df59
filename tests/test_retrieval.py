"""Tokens, BM25, cosine, approximate cells, fusion, paging: against brute force and golden values."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.functions import vectors
from corvane.operators import blockscore, dense, fusion, lexical

CORPUS = [
    (1, "Harbour gauges report the tide every ten minutes"),
    (2, "A ferry timetable for the northern islands"),
    (3, "Salt marsh birds counted from the dyke at dawn"),
]


def bm25_brute(docs, queries, n, idf=True):
    split = {i: "".join(c if c.isalnum() else " " for c in t.lower()).split() for i, t in docs}
    counts = {i: Counter(w) for i, w in split.items()}
    average = sum(map(len, split.values())) / len(docs)
    frequency = Counter(t for c in counts.values() for t in c)
    found = []
    for q, t in queries:
        words = Counter("".join(c if c.isalnum() else " " for c in t.lower()).split())
        scored = []
        for i, c in counts.items():
            total = 0.0
            for w, times in words.items():
                if c[w]:
                    if idf:
                        weight = math.log(1 + (len(docs) - frequency[w] + 0.5) / (frequency[w] + 0.5))
                    else:
                        weight = times * 2.2 / (times + 1.2 * (0.25 + 0.75 * words.total() / average))
                    total += weight * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(split[i]) / average))
            if total > 0:
                scored.append((-round(total, 6), i))
        found += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scored)[:n])]
    return found


def corpus(seed, n_docs, n_queries):
    rng = random.Random(seed)
    # A third of all words is one common word.
    words = ["common"] * 40 + [f"w{i}" for i in range(80)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(n_docs)]
    docs += [(n_docs, ""), (n_docs + 1, docs[0][1]), (n_docs + 2, None)]
    queries = [(q, ", ".join(rng.choices(words, k=rng.randint(1, 6)))) for q in range(n_queries)]
    return docs, queries + [(n_queries, "unknown"), (n_queries + 1, "")]


def same(rows, want):
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in rows}
    assert got.keys() == {(q, r) for q, _, _, r in want}
    for q, i, s, r in want:
        assert got[q, r][1] == pytest.approx(s, abs=2e-6)
        assert got[q, r][0] == i


@pytest.mark.parametrize("idf", [True, False])
@pytest.mark.parametrize("max_queries, block_values", [(1024, 8_000_000), (7, 1500)])
@pytest.mark.parametrize("counted", [False, True])
def test_bm25_equals_brute_force(spark, idf, max_queries, block_values, counted):
    docs, queries = corpus(3, 250, 20)
    tokens = lexical.doc_tokens(spark.createDataFrame(docs, "id long, text string").repartition(5))
    if counted:
        tokens = lexical.count_terms(tokens)
    got = lexical.bm25_topk(
        spark.createDataFrame(queries, "query_id long, text string"), tokens, 15, idf=idf, max_queries=max_queries, block_values=block_values
    )
    plain = [(i, t or "") for i, t in docs]
    same(got.collect(), bm25_brute(plain, queries, 15, idf))


def test_bm25_golden(spark):
    docs = lexical.doc_tokens(spark.createDataFrame(CORPUS, "id long, text string"))
    queries = spark.createDataFrame([(0, "tide gauges, harbour"), (1, "ferry islands")], "query_id long, text string")
    top = {r["query_id"]: r["id"] for r in lexical.bm25_topk(queries, docs, 1).collect()}
    assert top == {0: 1, 1: 2}


def test_bm25_of_an_empty_corpus(spark):
    docs = lexical.doc_tokens(spark.createDataFrame([], "id long, text string"))
    queries = spark.createDataFrame([(0, "a")], "query_id long, text string")
    assert lexical.bm25_topk(queries, docs, 5).count() == 0


def test_filtered_candidates_keep_corpus_statistics(spark):
    docs, queries = corpus(5, 120, 8)
    tokens = lexical.doc_tokens(spark.createDataFrame(docs, "id long, text string"))
    frame = spark.createDataFrame(queries, "query_id long, text string")
    whole = lexical.bm25_topk(frame, tokens, 1000).collect()
    part = lexical.bm25_topk(frame, tokens, 1000, candidates=tokens.where("id < 40")).collect()
    want = {(r["query_id"], r["id"]): r["score"] for r in whole if r["id"] < 40}
    assert {(r["query_id"], r["id"]): r["score"] for r in part} == want


def test_tokens(spark):
    df = spark.createDataFrame([(0, "Über C++, naïve_café 42!"), (1, "..."), (2, None)], "id long, text string")
    got = {r["id"]: (r["terms"], r["doc_len"]) for r in lexical.doc_tokens(df).collect()}
    assert got == {0: (["über", "c", "naïve", "café", "42"], 5), 1: ([], 0), 2: ([], 0)}


def test_postings_need_no_shuffle(spark):
    docs, _ = corpus(9, 90, 1)
    postings = lexical.build_postings(spark.createDataFrame(docs, "id long, text string"))
    got = {(r["id"], r["term"]): r["tf"] for r in postings.collect()}
    assert got == {(i, w): n for i, t in docs for w, n in Counter((t or "").split()).items()}
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()


def test_count_terms(spark):
    docs, _ = corpus(9, 90, 1)
    tokens = lexical.doc_tokens(spark.createDataFrame(docs, "id long, text string"))
    rows = lexical.count_terms(tokens).collect()
    assert len(rows) == len(docs)
    for row in rows:
        assert dict(zip(row["terms"], row["tfs"], strict=True)) == Counter((dict(docs)[row["id"]] or "").split())


def unit(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    matrix = rng.normal(size=(n, dim)).astype("float32")
    matrix[n // 2] = matrix[0]
    return [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]


def cosine_brute(queries, rows, n):
    q = np.array([v for _, v in queries], dtype="float64")
    m = np.array([v for _, v in rows], dtype="float64")
    scores = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T, 6)
    found = []
    for j, (query, _) in enumerate(queries):
        best = sorted((-s, rows[i][0]) for i, s in enumerate(scores[j]))[:n]
        found += [(query, i, -s, r + 1) for r, (s, i) in enumerate(best)]
    return found


@pytest.mark.parametrize("max_queries, block_values", [(1024, 8_000_000), (4, 1100)])
def test_cosine_equals_brute_force(spark, max_queries, block_values):
    rows, queries = unit(1, 300), unit(2, 12)
    frame = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(6)
    batch = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    got = dense.dense_topk(batch, frame, 9, max_queries=max_queries, block_values=block_values)
    same(got.collect(), cosine_brute(queries, rows, 9))


def test_grid_cells_without_queries_or_rows(spark):
    rows, queries = unit(1, 5), unit(2, 3)
    frame = spark.createDataFrame(rows, "id long, embedding array<float>")
    batch = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    got = dense.dense_topk(batch, frame, 4, max_queries=1, block_values=16)
    same(got.collect(), cosine_brute(queries, rows, 4))


def test_cosine_of_missing_and_zero_vectors(spark):
    frame = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0])], "id long, embedding array<float>")
    batch = spark.createDataFrame([(0, [2.0, 0.0])], "query_id long, embedding array<float>")
    got = [(r["id"], r["score"]) for r in dense.dense_topk(batch, frame, 5).orderBy("rank").collect()]
    assert got == [(3, 1.0), (1, 0.0)]
    assert dense.dense_topk(batch.where("query_id > 5"), frame, 5).count() == 0


def test_cells_find_most_neighbours_and_all_cells_are_exact(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 16)) * 3
    points = [(i, [float(x) for x in centres[i % 8] + rng.normal(size=16)]) for i in range(800)]
    queries = [(q, points[q][1]) for q in range(20)]
    frame = spark.createDataFrame(points, "id long, embedding array<float>")
    batch = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    model = dense.train_cells(frame, 8)
    placed = dense.assign_cells(frame, model)
    exact = {(q, i) for q, i, _, _ in cosine_brute(queries, points, 10)}
    near = {(r["query_id"], r["id"]) for r in dense.ann_topk(batch, placed, model, 10, probes=3).collect()}
    assert len(near & exact) / len(exact) > 0.8
    same(dense.ann_topk(batch, placed, model, 10, probes=8).collect(), cosine_brute(queries, points, 10))


def test_only_probed_cells_are_read(spark, tmp_path):
    frame = spark.createDataFrame(unit(1, 200), "id long, embedding array<float>")
    model = dense.train_cells(frame, 6, train_rows=150)
    dense.assign_cells(frame, model).write.partitionBy("cell").parquet(str(tmp_path / "v"))
    batch = spark.createDataFrame(unit(2, 1), "query_id long, embedding array<float>")
    found = dense.ann_topk(batch, spark.read.parquet(str(tmp_path / "v")), model, 5, probes=2)
    # The probed cells are a join that prunes folders.
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()
    assert found.count() == 5


def test_a_hot_query_is_cut_in_two_steps(spark):
    hits = spark.range(5000).select(F.lit(1).cast("long").alias("query_id"), "id", (F.col("id") % 97).cast("double").alias("score"))
    for spread in (1, 4):
        got = blockscore.top_n_per_key(hits, 120, spread=spread).orderBy("rank").collect()
        want = sorted(((-(i % 97), i) for i in range(5000)))[:120]
        assert [(r["id"], r["rank"]) for r in got] == [(i, n + 1) for n, (_, i) in enumerate(want)]


def test_rank_fusion_golden(spark):
    first = spark.createDataFrame([(0, 101, 1), (0, 102, 2), (0, 103, 3)], "query_id long, id long, rank int")
    second = spark.createDataFrame([(0, 102, 1), (0, 101, 2), (0, 104, 3)], "query_id long, id long, rank int")
    for lists in ([first, second], [second, first]):
        got = {r["id"]: (r["score"], r["rank"]) for r in fusion.rank_hits(fusion.rrf(lists)).collect()}
        assert got[101][0] == got[102][0] == pytest.approx(0.0325224749, abs=1e-9)
        assert got[103][0] == got[104][0] == pytest.approx(0.0158730159, abs=1e-9)
        assert [got[i][1] for i in (101, 102, 103, 104)] == [1, 2, 3, 4]


def test_rank_fusion_of_equally_partitioned_lists(spark):
    base = spark.range(4000).select((F.col("id") % 10).alias("query_id"), (F.col("id") / 10).cast("long").alias("id"))
    first = blockscore.top_n_per_key(base.withColumn("score", F.rand(1)), 300)
    second = blockscore.top_n_per_key(base.where("id < 350").withColumn("score", F.rand(2)), 300)
    fused = fusion.rrf([first, second])
    assert fused.count() == fused.select("query_id", "id").distinct().count()


def test_minmax(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (0, 2, 4.0), (0, 3, 3.0), (1, 1, 5.0), (1, 2, 5.0)], "query_id long, id long, score double")
    got = {(r["query_id"], r["id"]): r["norm"] for r in fusion.minmax_normalise(df).collect()}
    assert got == {(0, 1): 0.0, (0, 2): 1.0, (0, 3): 0.5, (1, 1): 0.0, (1, 2): 0.0}


def test_candidate_limit():
    assert [fusion.candidate_limit(0, 20), fusion.candidate_limit(40, 20), fusion.candidate_limit(5000, 100)] == [220, 260, 2000]


def test_page_summary(spark):
    df = spark.createDataFrame([(0,), (5,), (31,), (200,)], "total long")
    got = fusion.page_summary(df, "total", page_number=3, size=15).orderBy("total").collect()
    assert [(r["total_pages"], r["start_row"], r["end_row"]) for r in got] == [(1, 0, 0), (1, 5, 5), (3, 31, 31), (14, 31, 45)]


def test_hashing_encoder(spark):
    texts = [(0, "Lightweight async web server in Python"), (1, "Deep learning computer vision object detection"), (2, "")]
    df = vectors.embed_hashed(spark.createDataFrame(texts, "id long, text string"))
    got = [np.array(r["embedding"]) for r in df.orderBy("id").collect()]
    assert all(v.shape == (384,) for v in got)
    assert [float(np.linalg.norm(v)) for v in got] == pytest.approx([1.0, 1.0, 0.0], abs=1e-3)
    assert vectors.embed_hashed(df.drop("embedding").where("id > 9")).count() == 0


def test_plugged_in_encoder(spark):
    def load():
        return lambda texts: [[float(len(t)), 3.0] for t in texts]

    df = spark.createDataFrame([(0, "abcd"), (1, "")], "id long, text string")
    got = {r["id"]: r["embedding"] for r in vectors.embed_with(df, load).collect()}
    assert got[0] == pytest.approx([0.8, 0.6]) and got[1] == pytest.approx([0.0, 1.0])


def test_query_text(spark):
    df = spark.createDataFrame([("  two words\n",)], "t string")
    got = df.select(vectors.query_text(F.col("t")).alias("x")).first()["x"]
    assert got == "Represent this sentence for searching relevant passages: two words"


def test_terms_are_counted_in_bounded_steps(spark, monkeypatch):
    """What a worker turns into numbers at a time follows a bound, not the session's batch."""
    monkeypatch.setattr(lexical, "COUNT_TOKENS", 7)
    docs, _ = corpus(9, 90, 1)
    docs = [*docs, (900, "long " * 50), (901, None), (902, "")]
    tokens = lexical.doc_tokens(spark.createDataFrame(docs, "id long, text string").coalesce(1))
    rows = lexical.count_terms(tokens).collect()
    assert [r["id"] for r in rows] == [i for i, _ in docs]
    for row in rows:
        assert dict(zip(row["terms"], row["tfs"], strict=True)) == Counter((dict(docs)[row["id"]] or "").split())


def test_a_scored_step_is_bounded():
    table = pa.table({"query_id": pa.array(range(1000), pa.int64()), "term": [f"t{i}" for i in range(1000)], "weight": [1.0] * 1000})
    assert lexical.query_block(table)["step"] * 1000 <= 1_000_000
