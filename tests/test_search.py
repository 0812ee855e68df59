"""The composed search on the two service rows and on larger made-up corpora."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import vectors
from corvane.operators import stats
from corvane.plans import index as index_plans
from corvane.plans import search as plans
from corvane.plans import store
from corvane.sources.schemas import CURATED_SCHEMA

SERVICE = [
    ("tidewater/marlin", "Julia", 8650, 740, 2310, 0.81, 0.7, "Harbour tide forecasts from gauge readings in julia"),
    ("northlight/ferry", "Kotlin", 310, 25, 640, 0.4, 0.4, "Timetables of island ferries"),
]


def curated(spark, rows):
    names = ["name_with_owner", "primary_language", "stars", "forks", "commits", "activity_score", "popularity_score", "synthesized_text"]
    fields = {f.name: f.dataType for f in CURATED_SCHEMA.fields}
    schema = ", ".join(f"{n} {fields[n].simpleString()}" for n in names)
    df = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], f"id long, {schema}")
    rest = [n for n in fields if n not in names]
    return df.withColumns({n: F.lit(None).cast(fields[n]) for n in rest}).select("id", *fields)


def batch(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    return vectors.embed_hashed(df)


@pytest.fixture(scope="module")
def service(spark):
    return index_plans.build_index(curated(spark, SERVICE))


@pytest.fixture(scope="module")
def larger(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [
        (f"o/r{i}", rng.choice(["Go", "C", "go"]), rng.randint(0, 500), 0, 0, rng.random(), 0.0, " ".join(rng.choices(words, k=12)))
        for i in range(400)
    ]
    df = curated(spark, rows).withColumn("pushed_at", F.when(F.col("id") % 3 == 0, F.concat(F.lit("20"), F.col("id"))))
    return index_plans.build_index(df)


def test_hybrid_finds_the_expected_record(spark, service):
    result = plans.search(batch(spark, "harbour tide forecasts"), service)
    hits = result.hits.orderBy("position").collect()
    assert hits[0]["name_with_owner"] == "tidewater/marlin"
    assert result.summary.first()["total"] == 2
    assert {h["name_with_owner"]: h["metadata_score"] for h in hits} == {"tidewater/marlin": 0.7987, "northlight/ferry": 0.4493}


def test_index_is_ready_and_fresh(spark, service):
    row = stats.index_freshness(service.vectors, service.repositories).first()
    assert (row["indexed"], row["stored"], row["stale"], row["status"]) == (2, 2, False, "ready")
    empty = stats.index_freshness(service.vectors.where("false"), service.repositories).first()
    assert (empty["stale"], empty["status"]) == (True, "warming_up")


@pytest.mark.parametrize("indexed, stored, stale", [(1000, 1010, False), (1000, 1011, True), (9900, 10000, False), (9899, 10000, True)])
def test_staleness_tolerance(spark, indexed, stored, stale):
    assert stats.index_freshness(spark.range(indexed), spark.range(stored)).first()["stale"] is stale


def test_written_index_answers_like_the_built_one(spark, service, tmp_path):
    store.write_index(service, str(tmp_path))
    stored = store.read_index(spark, str(tmp_path))
    queries = batch(spark, "harbour tide forecasts", "island ferries")
    for mode in plans.MODES:
        want = sorted(map(tuple, plans.search(queries, service, mode).hits.select("query_id", "position", "id", "score").collect()))
        got = sorted(map(tuple, plans.search(queries, stored, mode).hits.select("query_id", "position", "id", "score").collect()))
        assert got == want


def test_pages_of_one_window_join_up(spark, larger):
    queries = batch(spark, "w1 w2 w3", "w4 w5")
    scored = plans.score_candidates(queries, larger, limit=20, offset=20)
    assert scored.groupBy("query_id").agg(F.max("position") == F.count("*")).distinct().count() >= 1
    first, second, both = (plans.fusion.page(scored, *p).select("query_id", "id") for p in ((0, 20), (20, 20), (0, 40)))
    assert sorted(map(tuple, first.unionAll(second).collect())) == sorted(map(tuple, both.collect()))


def test_hybrid_candidates_come_from_either_list(spark, larger):
    queries = batch(spark, "w1 w2 w3", "w4 w5")
    found = {m: {(r["query_id"], r["id"]) for r in plans.retrieve(queries, larger, m, 50).collect()} for m in plans.MODES}
    assert found["hybrid"] <= found["semantic"] | found["lexical"]
    assert len(found["hybrid"]) == 100


@pytest.mark.parametrize("mode", plans.MODES)
def test_filters_and_scores(spark, larger, mode):
    result = plans.search(batch(spark, "w1 w2 w3"), larger, mode, language="Go", min_stars=100, limit=100)
    hits = result.hits.collect()
    assert hits and all(h["primary_language"] == "Go" and h["stars"] >= 100 for h in hits)
    for h in hits:
        assert 0 <= h["score"] <= 1 and h["metadata_score"] >= 0.25
        assert h["lexical_score"] == (h["dense_score"] if mode == "lexical" else 0.0)
    assert max(h["dense_score"] for h in hits) == 1.0


@pytest.mark.parametrize("by, key", [("stars", "stars"), ("activity", "activity_score"), ("recency", "pushed_at"), ("relevance", "score")])
def test_sorting_within_the_window(spark, larger, by, key):
    hits = plans.search(batch(spark, "w1 w2"), larger, sort_by=by, limit=100).hits.orderBy("position").collect()
    values = [h[key] or "" if by == "recency" else h[key] for h in hits]
    assert values == sorted(values, reverse=True)
    for a, b in zip(hits, hits[1:], strict=False):
        assert a[key] != b[key] or a["rank"] < b["rank"]


def test_nothing_found_still_has_a_summary(spark, larger):
    result = plans.search(batch(spark, "w1", ""), larger, "lexical", language="COBOL")
    assert result.hits.count() == 0
    assert [(r["total"], r["count"]) for r in result.summary.collect()] == [(0, 0), (0, 0)]


def test_an_offset_past_the_window_is_an_empty_page(spark, larger):
    result = plans.search(batch(spark, "w1"), larger, "semantic", offset=2000, limit=10)
    assert result.hits.count() == 0 and result.summary.first()["total"] == 400


@pytest.mark.parametrize("options", [{"mode": "x"}, {"sort_by": "x"}, {"limit": 0}, {"limit": 101}, {"offset": -1}, {"min_stars": -1}])
def test_bad_options_are_rejected(spark, service, options):
    with pytest.raises(ValueError):
        plans.search(batch(spark, "a"), service, **options)


def test_language_filter_spelling(spark):
    df = spark.createDataFrame([("Go", 5), ("go", None), ("", 1)], "primary_language string, stars long")
    count = lambda **o: stats.filter_hits(df, **o).count()
    assert [count(language=x) for x in (None, "", "all", "ALL", "Go", "GO")] == [3, 3, 3, 3, 1, 0]
    assert [count(min_stars=n) for n in (0, 1, 5)] == [3, 2, 1]


def test_statistics_of_an_empty_table(spark):
    df = spark.createDataFrame([], "primary_language string, stars long, activity_score double")
    row = stats.stats_record(df, df).first()
    assert (row["total_repositories"], row["avg_stars"], row["avg_activity_score"], row["top_languages"]) == (0, 0.0, 0.0, [])


def test_many_queries_take_the_grid(spark, larger, monkeypatch):
    from corvane.operators import dense, lexical

    queries = batch(spark, *[f"w{i} w{i + 1}" for i in range(9)])
    want = sorted(map(tuple, plans.search(queries, larger).hits.select("query_id", "position", "id", "score").collect()))
    for module in (plans, dense, lexical):
        monkeypatch.setattr(module, "bounded_local", lambda *a: None)
    got = sorted(map(tuple, plans.search(queries, larger).hits.select("query_id", "position", "id", "score").collect()))
    assert got == want
