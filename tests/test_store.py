"""The stored index: postings against brute force, floors, cells, segments with delete marks, versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import blockscore, dense, lexical, postings
from corvane.plans import search as plans
from corvane.plans import store
from corvane.plans.index import build_index
from corvane.sources.schemas import CURATED_SCHEMA


def records(spark, rows):
    """Curated records of (id, language, stars, text)."""
    df = spark.createDataFrame(rows, "id long, primary_language string, stars long, synthesized_text string")
    rest = {f.name: f.dataType for f in CURATED_SCHEMA.fields if f.name not in df.columns}
    named = F.concat(F.lit("own/r"), F.col("id").cast("string"))
    extra = {n: (named if n == "name_with_owner" else F.lit(None)).cast(t) for n, t in rest.items()}
    return df.withColumns(extra).select("id", *CURATED_SCHEMA.fieldNames())


def made(seed, n):
    rng = random.Random(seed)
    words = ["usual"] * 30 + [f"t{i}" for i in range(70)]
    rows = [(i, rng.choice(["Go", "C", None]), rng.choice([None, 5, 50]), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(n)]
    return rows


QUERIES = ["t1 t2 usual", "usual", "t3 t3 t4 t5 t6 t7", "nothing known", "", "t9 t10 usual t11"]


def batch(spark):
    from corvane.functions.vectors import embed_hashed

    return embed_hashed(spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, text string"))


def found(df):
    return sorted(map(tuple, df.select("query_id", "rank", "id", "score").collect()))


def hits(spark, index, **options):
    return sorted(map(tuple, plans.search(batch(spark), index, **options).hits.select("query_id", "position", "id", "score").collect()))


@pytest.fixture(scope="module")
def built(spark):
    return build_index(records(spark, made(1, 900)))


@pytest.mark.parametrize("options", [{}, {"idf": False}, {"language": "Go"}, {"min_stars": 10}, {"language": "C", "min_stars": 50}])
@pytest.mark.parametrize("block, shard, n", [(128, 8192, 15), (4, 100, 15), (2, 50, 400)])
def test_postings_equal_the_scan_of_all_documents(spark, built, monkeypatch, options, block, shard, n):
    monkeypatch.setattr(postings, "BLOCK_DOCS", block)
    monkeypatch.setattr(postings, "SHARD_DOCS", shard)
    blocks = postings.build_blocks(built.doc_terms, 900)
    stats = lexical.term_stats(built.doc_terms)
    got = postings.blocks_topk(batch(spark), blocks, stats, n, **options)
    filters = {k: v for k, v in options.items() if k != "idf"}
    kept = plans.filter_hits(built.doc_terms, **filters)
    want = lexical.bm25_topk(batch(spark), built.doc_terms, n, idf=options.get("idf", True), candidates=kept)
    assert found(got) == found(want) and found(got)


def test_blocks_hold_every_posting_and_bound_it(spark, built, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_DOCS", 8)
    blocks = postings.build_blocks(built.doc_terms, 900).cache()
    listed = blocks.select("term", "max_tf", "min_len", F.inline(F.arrays_zip("ids", "tfs", "lens")))
    assert listed.where("tfs > max_tf or lens < min_len").isEmpty()
    flat = built.doc_terms.select("id", "doc_len", F.inline(F.arrays_zip("terms", "tfs")))
    assert sorted(map(tuple, listed.select("ids", "lens", "term", "tfs").collect())) == sorted(map(tuple, flat.collect()))
    assert blocks.agg(F.max(F.size("ids"))).first()[0] == 8


def test_a_search_reads_its_terms_and_skips_blocks(spark, built, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_DOCS", 4)
    store.write_index(built, str(tmp_path / "i"))
    index = store.read_index(spark, str(tmp_path / "i"))
    own = postings.only_terms(index.blocks, ["t1", "usual"])
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "term" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert own.count() < index.blocks.count() / 5
    # With a floor, a frequent word's blocks are mostly below what can matter beside a rare word.
    least = postings.block_thresholds([(0, "t1", 5.0), (0, "usual", 0.2)], {"t1": 2.0, "usual": 2.0}, {0: 9.0})
    assert least["usual"] < 0 < least["t1"] and least["t1"] == pytest.approx((9.0 - postings.MARGIN - 0.4) / 5.0)
    assert postings.block_thresholds([(0, "t1", 5.0)], {"t1": 2.0}, {})["t1"] == float("-inf")


@pytest.mark.parametrize("n", [20, 100])
def test_floors_change_nothing_and_bound_what_leaves_the_tasks(spark, monkeypatch, n):
    rng = np.random.default_rng(n)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 8)).round(1))]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>").cache()
    queries = spark.createDataFrame([(q, rows[q * 7][1]) for q in range(5)], "query_id long, embedding array<double>")
    want = found(dense.dense_topk(queries, vectors, n))
    sent, original = {}, blockscore.broadcast_top
    for tasks in (2, 64):
        count = []

        def counted(rows, *rest, into=count):
            out = original(rows, *rest).cache()
            into.append(out.count())
            return out

        monkeypatch.setattr(blockscore, "broadcast_top", counted)
        assert found(dense.threshold_topk(queries, vectors.repartition(tasks, "id"), n, 3000)) == want
        sent[tasks] = sum(count)
    assert sent[64] < 2 * sent[2]


def test_many_parts(spark):
    assert dense.part_bounds(10, 40) == [0.0, 1.0]
    bounds = dense.part_bounds(200, 10**8)
    assert bounds[0] == 0 and bounds[-1] == 1 and len(bounds) == 11 and sorted(bounds) == bounds


def test_cells_are_pruned_and_recall_holds(spark, tmp_path):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(20, 16))
    points = [(centre[i % 20] + 0.25 * rng.normal(size=16)).tolist() for i in range(2000)]
    rows = spark.createDataFrame([(i, p, "Go", 1) for i, p in enumerate(points)], "id long, embedding array<double>, primary_language string, stars long")
    base = build_index(records(spark, [(i, "Go", 1, f"t{i}") for i in range(2000)]))
    path = str(tmp_path / "i")
    store.write_index(plans.Index(base.repositories, rows, base.doc_terms), path, cells=24)
    index = store.read_index(spark, path)
    queries = spark.createDataFrame([(q, "t1", points[q * 31]) for q in range(40)], "query_id long, text string, embedding array<double>")
    exact = {(q, i) for q, _, i, _ in found(dense.dense_topk(queries, rows, 10))}
    few = dense.ann_topk(queries, index.vectors, index.centres, 10, 4)
    assert len(exact & {(q, i) for q, _, i, _ in found(few)}) / len(exact) >= 0.9
    assert found(dense.ann_topk(queries, index.vectors, index.centres, 10, 24)) == found(dense.dense_topk(queries, rows, 10))
    cells = spark.createDataFrame([(3,), (5,)], "cell int")
    chosen = dense.in_cells(index.vectors, cells)
    assert "dynamicpruning" in chosen._jdf.queryExecution().executedPlan().toString().lower()
    assert {r["cell"] for r in chosen.select("cell").distinct().collect()} <= {3, 5}
    got = plans.search(queries, index, mode="semantic", probes=24).hits
    assert got.count() == 40 * 20
    with pytest.raises(ValueError, match="cells"):
        plans.search(queries, base, probes=2)


def changed(rows):
    """A later state: some records replaced, some gone, some new."""
    out = [(i, "Rust", s, f"{t} fresh usual") if i % 4 == 0 else (i, g, s, t) for i, g, s, t in rows if i % 9]
    return out + [(5000 + i, "C", 50, f"t{i} usual fresh") for i in range(30)]


SEARCHES = ({}, {"mode": "lexical", "language": "Rust"}, {"mode": "semantic"}, {"idf": False, "min_stars": 10})


def answers(spark, index):
    """The statistics of an index and what it finds."""
    stats = sorted(map(tuple, index.term_stats.select("term", "df", "total_len").collect()))
    return stats, [hits(spark, index, **options) for options in SEARCHES]


def test_changes_give_the_index_built_from_scratch(spark, tmp_path):
    before, path = made(2, 300), str(tmp_path / "i")
    store.sync_index(spark, path, records(spark, before), build_index)
    now = records(spark, changed(before))
    assert store.sync_index(spark, path, now, build_index) == 2
    store.write_index(build_index(now), str(tmp_path / "scratch"))
    want = answers(spark, store.read_index(spark, str(tmp_path / "scratch")))
    assert all(want[1]) and answers(spark, store.read_index(spark, path)) == want
    assert store.sync_index(spark, path, now, build_index) == 2
    # Back again, then one segment: still the same, and nothing is left of the changes.
    store.sync_index(spark, path, records(spark, before), build_index)
    store.sync_index(spark, path, now, build_index)
    assert answers(spark, store.read_index(spark, path)) == want
    version = store.compact_index(spark, path)
    assert len(store.manifest(spark, path)["segments"]) == 1 and version == 5
    assert answers(spark, store.read_index(spark, path)) == want
    store.refresh_index(spark, path, deleted=now.select("id").where("id < 100"))
    left = store.read_index(spark, path)
    assert left.repositories.where("id < 100").isEmpty() and left.term_stats.where("term = ''").first()["df"] == now.where("id >= 100").count()


def test_a_change_is_made_once(spark, tmp_path):
    path = str(tmp_path / "i")
    store.write_index(build_index(records(spark, made(3, 50))), path)
    fresh = build_index(records(spark, [(1, "Go", 1, "t1 fresh"), (900, "Go", 1, "fresh")]))
    assert store.refresh_index(spark, path, fresh, name="batch-7") == 2
    assert store.refresh_index(spark, path, fresh, name="batch-7") == 2
    assert store.read_index(spark, path).repositories.count() == 51


def test_readers_keep_their_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    store.write_index(build_index(records(spark, made(4, 80))), path)
    old = store.read_index(spark, path)
    want = hits(spark, old)
    fresh = build_index(records(spark, [(i, "Go", 1, "usual usual fresh") for i in range(40)]))

    def dies(*args):
        raise OSError("the writer dies here")

    with monkeypatch.context() as m:
        # The segment's tables are written, the marks and the manifest are not.
        m.setattr(store, "_mark_deleted", dies)
        with pytest.raises(OSError):
            store.refresh_index(spark, path, fresh, name="half")
    assert hits(spark, store.read_index(spark, path)) == want and set(store.index_versions(spark, path)) == {1}
    store.refresh_index(spark, path, fresh, name="half")
    assert hits(spark, old) == want and hits(spark, store.read_index(spark, path, 1)) == want
    assert hits(spark, store.read_index(spark, path)) != want
    stale = {**store.manifest(spark, path, 1), "version": 2}
    with pytest.raises(RuntimeError, match="another change"):
        store._commit(spark, path, stale)
    with pytest.raises(ValueError, match="no version 9"):
        store.read_index(spark, path, 9)
    with pytest.raises(ValueError, match="no index"):
        store.read_index(spark, str(tmp_path / "none"))


def test_shards_of_long_documents_are_smaller(spark, built, monkeypatch):
    """A task holds a shard: its size follows the postings, not only the documents."""
    monkeypatch.setattr(postings, "SHARD_ENTRIES", 500)
    entries = built.doc_terms.agg(F.sum(F.size("terms"))).first()[0]
    blocks = postings.build_blocks(built.doc_terms, 900, entries)
    largest = blocks.groupBy("shard").agg(F.sum(F.size("ids")).alias("n")).agg(F.max("n")).first()[0]
    assert postings.shard_count(900, entries) > 1 and largest < 1000
    got = postings.blocks_topk(batch(spark), blocks, lexical.term_stats(built.doc_terms), 15)
    assert found(got) == found(lexical.bm25_topk(batch(spark), built.doc_terms, 15))


def test_writing_counts_texts_and_cuts_blocks_once(spark, tmp_path, monkeypatch):
    """Files by ranges of terms come from a sample; statistics come from the postings and equal those of the documents."""
    monkeypatch.setattr(postings, "FILE_ENTRIES", 900)
    monkeypatch.setattr(store, "FILE_ENTRIES", 900)
    counted, cut = spark.sparkContext.accumulator(0), postings.build_blocks
    seen = []
    monkeypatch.setattr(store, "build_blocks", lambda *a: seen.append(a[3]) or cut(*a))

    def count(batches):
        for b in batches:
            counted.add(b.num_rows)
            yield b

    index = build_index(records(spark, made(4, 500)))
    terms = index.doc_terms.mapInArrow(count, index.doc_terms.schema)
    store.write_index(plans.Index(index.repositories, index.vectors, terms, digests=index.digests), str(tmp_path / "i"))
    assert counted.value == 500 and len(seen[0]) > 2
    read = store.read_index(spark, str(tmp_path / "i"))
    stats = [sorted(map(tuple, s.select("term", "df", "total_len").collect())) for s in (read.term_stats, lexical.term_stats(index.doc_terms))]
    assert stats[0] == stats[1]
    files = read.blocks.groupBy(F.input_file_name()).agg(F.min("term").alias("low"), F.max("term").alias("high")).orderBy("low").collect()
    assert len(files) > 2 and all(a["high"] <= b["low"] for a, b in zip(files, files[1:]))


def test_pages_read_tables_that_are_written_once(spark, built):
    from corvane.plans.index import settled

    index = settled(plans.Index(built.repositories, built.vectors, lexical.doc_tokens(records(spark, made(1, 900)).selectExpr("id", "synthesized_text as text"))))
    assert all("MapInArrow" not in t._jdf.queryExecution().executedPlan().toString() for t in (index.doc_terms, index.term_stats, index.vectors))
    got, want = (found(plans.page_after(batch(spark), i, None, "lexical", limit=20)) for i in (index, built))
    assert got == want and got
