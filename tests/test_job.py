"""The batch job from record files to an answering index."""

import importlib.util
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.functions import scores, vectors
from corvane.plans import search as plans
from corvane.plans.store import read_index
from corvane.sources.repositories import array_to_lines, read_repositories

SPEC = importlib.util.spec_from_file_location("build_job", Path(__file__).parents[1] / "jobs" / "build.py")
job = importlib.util.module_from_spec(SPEC)
SPEC.loader.exec_module(job)


def test_records_to_answers(spark, tmp_path):
    texts = ["distributed cluster monitoring", "web automation testing", "export csv in browser", "web server"]
    records = [{"nameWithOwner": f"o/r{i}", "owner": "o", "name": f"r{i}", "description": t, "stars": i} for i, t in enumerate(texts)]
    (tmp_path / "in.json").write_text(json.dumps([*records, 3], indent=1))
    common = ["--dataset", str(tmp_path / "in.json"), "--out", str(tmp_path / "out"), "--layout", "array"]
    first = job.run(spark, job.parse([*common, "--sample-size", "3", "--skip-index", "--batch-size", "2"]))
    assert (first.existing, first.saved) == (0, 3)
    assert not (tmp_path / "out" / "index").exists()
    second = job.run(spark, job.parse([*common, "--load-id", "1", "--sample-size", "0"]))
    assert (second.existing, second.saved) == (3, 1)

    index = read_index(spark, str(tmp_path / "out" / "index"))
    queries = vectors.embed_hashed(spark.createDataFrame([(0, "web automation")], "query_id long, text string"))
    top = plans.search(queries, index).hits.orderBy("position").first()
    assert top["name_with_owner"] == "o/r1"
    assert {r["id"] for r in index.doc_terms.collect()} == {1, 2, 3, 4}


def test_a_second_run_keeps_the_first(spark, tmp_path):
    for start in (0, 100):
        records = [{"nameWithOwner": f"o/r{i}", "owner": "o", "name": f"r{i}"} for i in range(start, start + 4)]
        (tmp_path / f"in{start}.json").write_text("\n".join(map(json.dumps, records)))
        options = ["--dataset", str(tmp_path / f"in{start}.json"), "--out", str(tmp_path / "out"), "--skip-index"]
        report = job.run(spark, job.parse(options))
    assert (report.existing, report.saved) == (4, 4)
    assert spark.read.parquet(str(tmp_path / "out" / "repositories")).count() == 8
    named = [*options, "--load-id", "day1"]
    job.run(spark, job.parse(named))
    with pytest.raises(ValueError, match="stored already"):
        job.run(spark, job.parse(named))


def test_negative_counts_score_nothing(spark):
    row = spark.range(1).select(scores.popularity_score(F.lit(-1), F.lit(-5)).alias("p"), scores.popularity_score(F.lit(0), F.lit(0)).alias("z"))
    assert tuple(row.first()) == (0.0, 0.0)


def test_a_row_that_breaks_a_constraint_is_set_aside(spark, tmp_path):
    long = "x" * 400
    records = [{"nameWithOwner": f"o/{n}", "owner": "o", "name": n} for n in ("a", long, "b")]
    (tmp_path / "in.json").write_text("\n".join(map(json.dumps, records)))
    options = ["--dataset", str(tmp_path / "in.json"), "--out", str(tmp_path / "out"), "--skip-index", "--load-id", "1"]
    report = job.run(spark, job.parse(options))
    assert (report.saved, report.rejected) == (2, 1)
    kept = spark.read.parquet(str(tmp_path / "out" / "repositories"))
    assert sorted(r["name"] for r in kept.collect()) == ["a", "b"]
    bad = spark.read.parquet(str(tmp_path / "out" / "repositories-rejected")).first()
    assert bad["name_with_owner"] == f"o/{long}" and "length:name_with_owner" in bad["violations"]


def test_arrays_by_line_lose_nothing_unseen(spark, tmp_path):
    records = [{"nameWithOwner": f"o/r{i}", "owner": "o", "name": f"r{i}"} for i in range(5)]
    lines = tmp_path / "lines.json"
    lines.write_text("[\n" + ",\n".join(map(json.dumps, records)) + ",\n7\n]\n")
    rows = read_repositories(spark, str(lines), "array_lines").orderBy("seq").collect()
    assert [r["name"] for r in rows] == [f"r{i}" for i in range(5)]
    indented = tmp_path / "indented.json"
    indented.write_text(json.dumps(records, indent=2))
    assert read_repositories(spark, str(indented), "array").count() == 5
    with pytest.raises(Exception, match="not whole elements"):
        read_repositories(spark, str(indented), "array_lines").collect()
    with pytest.raises(Exception, match="not whole elements"):
        array_to_lines(spark, str(indented)).collect()
