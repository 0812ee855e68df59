"""Readers, de-duplication, incremental loads, ids, constraints and streaming."""

import json
import os

import pytest
from pyspark.sql import functions as F

from corvane.operators import dedupe
from corvane.plans import ingest as plans
from corvane.sources import curated as io
from corvane.sources import repositories
from corvane.streaming import ingest as streaming


def record(name, stars=0, **more):
    return {"nameWithOwner": name, "owner": name.split("/")[0], "name": name.split("/")[-1], "stars": stars, **more}


def write_lines(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in records))
    return str(folder)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_lines_keep_both_list_shapes_and_odd_numbers(spark, tmp_path):
    path = write_lines(
        tmp_path / "in",
        "a.json",
        [record("a/b", 3000000000, topics=[{"name": "X"}, "y"], isFork=True), record("a/c", "7")],
    )
    got = {r["nameWithOwner"]: r for r in repositories.read_repositories(spark, path).collect()}
    assert got["a/b"]["stars"] == "3000000000" and got["a/c"]["stars"] == "7"
    # An object keeps its content; the blanks in its text are no part of that.
    topics = got["a/b"]["topics"]
    assert json.loads(topics[0]) == {"name": "X"} and topics[1:] == ["y"] and got["a/b"]["isFork"] == "true"


def test_bad_lines_are_dropped_by_the_identity_filter(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"nameWithOwner": "a/b"}\nnot json\n[1]\n{"nameWithOwner": "a/c"}\n')
    out = plans.ingest(repositories.read_repositories(spark, str(folder)), None)
    assert rows(out, "name_with_owner") == [("a/b",), ("a/c",)]


def test_array_skips_other_elements_and_keeps_order(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    items = [1, record("a/b", 1), "x", None, [2], record("a/c", 2), record("a/b", 3)]
    (folder / "a.json").write_text(json.dumps(items, indent=2))
    out = plans.ingest(repositories.read_repositories(spark, str(folder), "array"), None)
    assert rows(out, "name_with_owner", "stars") == [("a/b", 1), ("a/c", 2)]


def test_pretty_array_read_as_lines_is_an_error(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps([record("a/b"), record("a/c")], indent=2))
    with pytest.raises(ValueError, match="layout"):
        plans.ingest_path(spark, str(folder), str(tmp_path / "out"), 0)
    with pytest.raises(ValueError, match="layout"):
        repositories.read_repositories(spark, str(folder), "rows")


def test_array_to_lines(spark, tmp_path):
    text = "[\n" + ",\n".join(json.dumps(record(f"a/{i}")) for i in range(5)) + "\n]\n"
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "b.json").write_text(f"[3, {json.dumps(record('b/0'))}, {json.dumps(record('b/1'))},\n{json.dumps(record('b/2', topics=['x']))}]")
    got = repositories.array_to_lines(spark, f"{tmp_path}/*.json").collect()
    assert sorted(json.loads(r["value"])["nameWithOwner"] for r in got) == [f"a/{i}" for i in range(5)] + ["b/0", "b/1", "b/2"]


def test_sample_fraction(spark):
    df = spark.range(2000)
    assert 800 < repositories.sample_fraction(df, 0.5).count() < 1200
    assert [repositories.sample_fraction(df, f).count() for f in (None, 0.0, 1.0, 2.0)] == [2000] * 4


def test_first_row_wins_even_for_a_hot_key(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (3000 - F.col("id")).alias("seq")
    )
    got = dict(rows(dedupe.dedupe_first(df.repartition(7), "k"), "k", "seq"))
    assert got["hot"] == 3 and len(got) == 2001
    assert "WindowGroupLimit" in dedupe.dedupe_first(df, "k")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("small", [False, True])
def test_only_new(spark, small):
    new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    stored = spark.createDataFrame([("b", 9), ("b", 8), ("c", 7)], "k string, v int")
    assert rows(dedupe.only_new(new, stored, "k", small=small), "k", "v") == [("a", 1)]


def test_ids_are_dense_and_ordered(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("seq")).repartition(9)
    got = rows(dedupe.assign_ids(df, "seq", start=11), "seq", "id")
    assert got == [(i, i + 11) for i in range(5000)]
    assert dedupe.assign_ids(df.where("seq < 0"), "seq").count() == 0


@pytest.mark.parametrize("bound", [1000, 10])
def test_first_n(spark, bound):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("seq")).repartition(5)
    assert rows(dedupe.take_first_new(df, 40, sorted_limit=bound), "seq") == [(i,) for i in range(40)]
    assert [dedupe.take_first_new(df, n).count() for n in (None, 0, -1)] == [1000] * 3


def test_constraints(spark):
    schema = """name_with_owner string, owner string, name string, primary_language string, created_at string,
        pushed_at string, license string, synthesized_text string"""
    fine = ("a/b", "a", "b", "Go", None, None, None, "t")
    df = spark.createDataFrame(
        [fine, ("d/d", "d", "d", "", None, None, None, "t"), ("d/d", "d", "d", "", None, None, None, "u"),
         ("x" * 256, None, "n" * 129, "l" * 65, None, None, "i" * 129, None)],
        schema,
    )
    good, bad = dedupe.validate(df)
    assert rows(good, "name_with_owner") == [("a/b",)]
    found = {r["name_with_owner"][:3]: r["violations"] for r in bad.collect()}
    assert found["d/d"] == ["unique:name_with_owner"]
    assert found["xxx"] == [
        "required:owner", "required:synthesized_text", "length:name_with_owner", "length:name",
        "length:primary_language", "length:license",
    ]


def test_loads_add_only_new_records_and_a_retry_changes_nothing(spark, tmp_path):
    source = write_lines(tmp_path / "in", "a.json", [record("a/b", 1), record("a/c", 2), record("a/b", 3)])
    out = str(tmp_path / "out")
    first = plans.ingest_path(spark, source, out, 0)
    assert (first.existing, first.saved) == (0, 2) and first.rate > 0
    again = plans.ingest_path(spark, source, out, 1)
    assert (again.existing, again.saved) == (2, 0)
    write_lines(tmp_path / "in", "b.json", [record("a/c", 9), record("a/d", 4), record("a/e", 5)])
    third = plans.ingest_path(spark, source, out, 2, n=1)
    assert (third.existing, third.saved) == (2, 1)
    want = [(1, "a/b", 1), (2, "a/c", 2), (3, "a/d", 4)]
    assert rows(spark.read.parquet(out), "id", "name_with_owner", "stars") == want
    # The same load once more replaces its own rows.
    retry = plans.ingest_path(spark, source, out, 2, n=1)
    assert retry.saved == 1 and rows(spark.read.parquet(out), "id", "name_with_owner", "stars") == want


def test_upsert(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([("c", 2), ("d", 3)], "v string, id long")
    assert rows(io.upsert_by_key(stored, new, "id"), "id", "v") == [(1, "a"), (2, "c"), (3, "d")]


def test_partitions_are_pruned_and_filters_pushed(spark, tmp_path):
    df = spark.createDataFrame([("a/b", "Go", 5), ("a/c", "C", 1), ("a/d", "Go", 2)], "name_with_owner string, primary_language string, stars long")
    io.write_curated(df, str(tmp_path / "p"), partition_by="primary_language")
    found = io.read_curated(spark, str(tmp_path / "p")).where("primary_language = 'Go' AND stars >= 3")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(primary_language" in plan and "GreaterThanOrEqual(stars,3)" in plan
    assert rows(found, "name_with_owner") == [("a/b",)]


def test_streamed_files_equal_a_batch_load_and_a_restart_adds_nothing(spark, tmp_path):
    source = write_lines(tmp_path / "in", "a.json", [record("a/b", 1), record("a/c", 2), record("a/b", 3)])
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    streaming.stream_ingest(spark, source, out, progress).awaitTermination()
    write_lines(tmp_path / "in", "b.json", [record("a/c", 9), record("a/d", 4)])
    streaming.stream_ingest(spark, source, out, progress).awaitTermination()
    want = [("a/b", 1), ("a/c", 2), ("a/d", 4)]
    assert rows(spark.read.parquet(out), "name_with_owner", "stars") == want
    streaming.stream_ingest(spark, source, out, progress).awaitTermination()
    assert rows(spark.read.parquet(out), "name_with_owner", "stars") == want
    assert rows(spark.read.parquet(out), "id") == [(1,), (2,), (3,)]


def test_a_replayed_batch_rebuilds_the_same_rows(spark, tmp_path):
    source = write_lines(tmp_path / "in", "a.json", [record("a/b", 1), record("a/c", 2)])
    out, progress = str(tmp_path / "out"), tmp_path / "progress"
    streaming.stream_ingest(spark, source, out, str(progress)).awaitTermination()
    before = rows(spark.read.parquet(out), "id", "name_with_owner", "load_id")
    # As after a crash between the write and the commit: the batch is planned but not committed.
    for commit in (progress / "commits").iterdir():
        commit.unlink()
    streaming.stream_ingest(spark, source, out, str(progress)).awaitTermination()
    assert rows(spark.read.parquet(out), "id", "name_with_owner", "load_id") == before


def test_streamed_index_holds_every_load(spark, tmp_path):
    source = write_lines(tmp_path / "in", "a.json", [record("a/b", 1, description="web server"), record("a/c", 2)])
    out, index = str(tmp_path / "out"), str(tmp_path / "index")
    for name, more in (("b.json", [record("a/d", 4, description="web client")]), ("c.json", [])):
        streaming.stream_ingest(spark, source, out, str(tmp_path / "p1")).awaitTermination()
        streaming.stream_index(spark, out, index, str(tmp_path / "p2")).awaitTermination()
        write_lines(tmp_path / "in", name, more or [record("a/b", 7)])
    found = streaming.read_streamed_index(spark, index)
    assert rows(found.vectors, "id") == [(1,), (2,), (3,)]
    assert rows(found.term_stats.where("term in ('web', 'client')"), "term", "df") == [("client", 1), ("web", 2)]
    assert found.term_stats.where("term = ''").first()["df"] == 3


def test_keys_keep_their_ids_and_few_are_looked_up(spark, tmp_path):
    from corvane.plans import keys

    out = str(tmp_path / "out")
    for load_id, names in (("a", ["a/b", "a/c", "a/d"]), ("b", ["a/c", "a/e"]), ("a", ["a/d", "a/f"]), ("c", ["a/b", "a/e", "a/g"])):
        source = write_lines(tmp_path / f"in-{len(names)}-{names[0][-1]}", "a.json", [record(n) for n in names])
        plans.load_batch(repositories.read_repositories(spark, source), out, load_id)
    want = [(1, "a/b", "c"), (3, "a/d", "a"), (4, "a/e", "b"), (5, "a/f", "a"), (6, "a/g", "c")]
    assert rows(spark.read.parquet(out), "id", "name_with_owner", "load_id") == want
    name = keys.key_table(spark, out)
    assert rows(keys.newest(spark.table(name)).where("load_id is null"), keys.KEY, "id") == [("a/c", 2)]
    # Few keys: their buckets alone. Many: the stored side is not shuffled.
    few = keys.look_up(spark, name, spark.createDataFrame([("a/b",), ("x/y",)], "name_with_owner string"))
    assert "SelectedBucketsCount: 2 out of 64" in few._jdf.queryExecution().executedPlan().toString()
    many = spark.range(1000).select(F.concat(F.lit("a/"), F.col("id").cast("string")).alias("name_with_owner"))
    assert rows(keys.look_up(spark, name, many), keys.KEY) == []
    plan = spark.table(name).join(many, keys.KEY).hint("merge")._jdf.queryExecution().executedPlan().toString()
    stored = plan[plan.index("FileScan parquet") - 400 : plan.index("FileScan parquet")]
    assert "Exchange hashpartitioning" not in stored


def test_a_load_that_died_holds_nothing(spark, tmp_path, monkeypatch):
    source, out = write_lines(tmp_path / "in", "a.json", [record("a/b", 1), record("a/c", 2)]), str(tmp_path / "out")

    def dies(*args, **more):
        raise OSError("the writer dies here")

    with monkeypatch.context() as m:
        m.setattr(plans, "append_load", dies)
        with pytest.raises(OSError):
            plans.ingest_path(spark, source, out, "first")
    report = plans.ingest_path(spark, source, out, "second")
    assert (report.existing, report.saved) == (0, 2)
    assert rows(spark.read.parquet(out), "id", "name_with_owner") == [(1, "a/b"), (2, "a/c")]


def test_unreadable_counts_go_to_quarantine(spark, tmp_path):
    source = write_lines(tmp_path / "in", "a.json", [record("a/b", "12,000"), record("a/c", " 7 "), record("a/d", None, forks="many", issues="")])
    out = str(tmp_path / "out")
    report = plans.ingest_path(spark, source, out, 0)
    assert (report.saved, report.rejected) == (1, 2)
    assert rows(spark.read.parquet(out), "name_with_owner", "stars") == [("a/c", 7)]
    bad = {r["name_with_owner"]: r["violations"] for r in spark.read.parquet(f"{out}-rejected").collect()}
    assert bad == {"a/b": ["unreadable:stars=12,000"], "a/d": ["unreadable:forks=many"]}


def test_lists_keep_objects_and_strings(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(
        '{"nameWithOwner": "a/b", "languages": ["Go", 5, true, ["x"], {"name": "C"}, null, "[1]", "{"], "topics": "no list"}\n'
        '{"nameWithOwner": "a/c", "languages": {"name": "C"}}\n{"nameWithOwner": "a/d", "languages": []}\n'
    )
    got = {r["nameWithOwner"]: r for r in repositories.read_repositories(spark, str(folder)).collect()}
    assert got["a/b"]["languages"] == ["Go", '{"name":"C"}', "[1]", "{"] and not got["a/b"]["topics"]
    assert not got["a/c"]["languages"] and got["a/d"]["languages"] == []


@pytest.mark.parametrize("split, indent", [(90, None), (400, 3), (1 << 20, 0)])
def test_arrays_of_any_layout_and_splits_smaller_than_an_element(spark, tmp_path, split, indent):
    tricky = ['}{][', 'quote " and \\ slash \\', "line\nbreak }", "", "é漢😀}", "x" * 300 + "}" * 20, '\\"}', "[{", "]}"]
    items = [record(f"a/{i}", i, description=t, topics=[{"name": t, "deep": {"a": [{}]}}]) for i, t in enumerate(tricky * 3)]
    mixed = [1, "}", [record("no/1"), [record("no/2")]], None, {}, *items[:13], "]", -2.5e3, [], *items[13:], True]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(mixed, indent=indent, ensure_ascii=bool(indent)))
    (folder / "b.json").write_text("[]")
    (folder / "c.json").write_text(json.dumps([record("c/0")], indent=indent) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        read = repositories.read_repositories(spark, str(folder), "array").where("nameWithOwner is not null")
        got = [(r["nameWithOwner"], r["stars"], r["description"]) for r in read.orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(r["nameWithOwner"], str(r["stars"]), r["description"]) for r in items] + [("c/0", "0", None)]


def test_a_cut_off_array_is_an_error(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps([record("a/b"), record("a/c")])[:-20])
    with pytest.raises(Exception, match="not a whole JSON array"):
        repositories.read_repositories(spark, str(folder), "array").collect()


def test_arriving_files_follow_the_text_and_keep_its_order(spark, tmp_path, monkeypatch):
    from corvane.plans import catalog

    docs = [(i, "s", "en", f"{i:04d} " + "x" * 96, 100) for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(catalog, "ARRIVAL_BYTES", 3000)
    path = catalog._arrival_files(spark, str(tmp_path))
    files = sorted(f for f in os.listdir(path) if f.endswith(".json"))
    assert len(files) >= 8
    texts = [json.loads(line)["description"] for f in files for line in open(f"{path}/{f}")]
    assert texts == [d[3] for d in docs]
