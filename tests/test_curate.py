"""Golden values and edge rows of cleaning, features and search documents."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import scores, text
from corvane.operators import curate
from corvane.sources.schemas import CURATED_SCHEMA, RAW_SCHEMA


def raw(spark, *records):
    rows = []
    for record in records:
        row = dict.fromkeys(RAW_SCHEMA.fieldNames())
        for name, value in record.items():
            if isinstance(value, list):
                value = [json.dumps(x) if isinstance(x, dict) else x for x in value]
            row[name] = value
        rows.append(tuple(row[c] for c in RAW_SCHEMA.fieldNames()))
    return spark.createDataFrame(rows, RAW_SCHEMA)


RECORD = {
    "owner": "tidewater",
    "name": "marlin",
    "nameWithOwner": "tidewater/marlin",
    "description": "Harbour tide tables & forecasts from gauge readings.",
    "primaryLanguage": "Julia",
    "languages": [{"name": "Julia", "size": 48213}],
    "topics": [{"name": "Oceans", "stars": 12}, {"name": "forecast", "stars": 31}],
    "stars": "8650",
    "forks": "740",
    "watchers": "212",
    "pullRequests": "415",
    "issues": "96",
    "defaultBranchCommitCount": "2310",
    "createdAt": "2019-11-04T09:15:00Z",
    "pushedAt": "2026-05-20T06:30:00Z",
    "license": "Mozilla Public License 2.0",
}


def one(df, column):
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given, want",
    [
        ("<div>Tides &lt; 3 m <i>at noon</i></div>\r\n ", "Tides &lt; 3 m at noon"),
        (None, ""),
        ("a\x00b", "ab"),
        (" a   b\x1c\x85", "a b"),
        ("1 < 2 stays, <> too", "1 too"),
        ("1 < 2 stays", "1 < 2 stays"),
        ("<a\nhref='x'>link</a>", "link"),
    ],
)
def test_clean_text(spark, given, want):
    df = spark.createDataFrame([(given,)], "t string")
    assert one(df, text.clean_text(F.col("t"))) == want


def test_clean_text_equals_the_rule_on_random_text(spark):
    rng = random.Random(1)
    alphabet = "ab<>& \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u2003\u2028\u3000\u200b"
    given = ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(given)), "i int, t string").withColumn("c", text.clean_text(F.col("t")))
    for row in df.collect():
        assert row["c"] == re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", row["t"])).strip(), repr(row["t"])


@pytest.mark.parametrize(
    "given, want",
    [
        ("2026-08-10T10:00:00Z", 1786356000),
        ("2026-08-10T12:00:00+02:00", 1786356000),
        ("2026-08-10T10:00:00", 1786356000),
        ("2026-08-10 10:00", 1786356000),
        ("2026-08-10T10:00+00:00", 1786356000),
        ("2026-08-10", 1786320000),
        ("2026-13-10", None),
        ("2026", None),
        ("garbage", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_iso_does_not_depend_on_the_session_zone(spark, given, want):
    df = spark.createDataFrame([(given,)], "t string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert one(df, F.unix_seconds(text.parse_iso(F.col("t")))) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize(
    "commits, pulls, issues, pushed, fraction, calendar",
    [
        (1500, 300, 200, "2026-08-25T12:00:00Z", 0.8418, 0.8414),
        (10, 0, 0, "2019-01-01T00:00:00Z", 0.0931, 0.0931),
        (0, 0, 0, None, 0.0231, 0.0231),
        (0, 0, 0, "nonsense", 0.0231, 0.0231),
        (0, 0, 0, "2030-01-01T00:00:00Z", 0.4, 0.4),
    ],
)
def test_activity(spark, commits, pulls, issues, pushed, fraction, calendar):
    df = spark.createDataFrame([(commits, pulls, issues, pushed)], "c long, p long, i long, at string")
    days = scores.days_since(text.parse_iso(F.col("at")))
    whole = scores.calendar_days_since(F.col("at"))
    for column, want in ((days, fraction), (whole, calendar)):
        got = one(df, scores.activity_score(F.col("c"), F.col("p"), F.col("i"), column))
        assert got == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("stars, forks, want", [(50000, 10000, 0.8630), (5, 1, 0.1228), (0, 0, 0.0), (10**9, 10**9, 1.0)])
def test_popularity(spark, stars, forks, want):
    df = spark.createDataFrame([(stars, forks)], "s long, f long")
    assert one(df, scores.popularity_score(F.col("s"), F.col("f"))) == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize(
    "language, target, want", [("Python", "Python", 1.0), ("JavaScript", "Python", 0.8), ("python", "PYTHON", 1.0), (None, "x", 0.8)]
)
def test_metadata(spark, language, target, want):
    df = spark.createDataFrame([(10000, 0.8, language)], "s long, a double, l string")
    got = one(df, scores.metadata_score(F.col("s"), F.col("a"), F.col("l"), target))
    assert got == pytest.approx(want, abs=1e-4)


def test_metadata_without_target_and_with_missing_values(spark):
    df = spark.createDataFrame([(8650, 0.81), (310, 0.4), (None, None)], "s long, a double")
    got = df.select(F.round(scores.metadata_score(F.col("s"), F.col("a"), F.lit("Go")), 4).alias("x")).collect()
    assert [r["x"] for r in got] == [0.7987, 0.4493, 0.0]


def test_search_document(spark):
    df = spark.createDataFrame(
        [("tidewater/marlin", "Tide tables", "Julia", ["Julia", "Fortran"], ["oceans", "forecast"], 0.88)],
        "n string, d string, l string, ls array<string>, t array<string>, a double",
    )
    c = F.col
    got = one(df, text.search_document(c("n"), c("d"), c("l"), c("ls"), c("t"), c("a")))
    assert got == (
        "Repository: tidewater/marlin | Primary Language: Julia | Languages: Fortran | Topics and tags: oceans, forecast"
        " | Description: Tide tables | Status: Highly active and maintained"
    )


def test_search_document_leaves_out_empty_sections_and_caps_lists(spark):
    many = [f"x{i}" for i in range(20)]
    df = spark.createDataFrame(
        [("a/b", "", "Unknown", [], [], 0.5), ("a/c", "", "", many, many, 0.1), ("a/d", "", "Go", ["Go"], [], 0.3)],
        "n string, d string, l string, ls array<string>, t array<string>, a double",
    )
    c = F.col
    got = [r["x"] for r in df.select(text.search_document(c("n"), c("d"), c("l"), c("ls"), c("t"), c("a")).alias("x")).collect()]
    assert got[0] == "Repository: a/b"
    assert got[1] == (
        f"Repository: a/c | Languages: {', '.join(many[:5])} | Topics and tags: {', '.join(many[:12])}"
        " | Status: Inactive or legacy"
    )
    assert got[2] == "Repository: a/d | Primary Language: Go"


def test_record(spark):
    row = curate.curate(raw(spark, RECORD)).first()
    assert row["name_with_owner"] == "tidewater/marlin" and row["primary_language"] == "Julia"
    assert row["topics"] == ["oceans", "forecast"] and row["languages"] == ["Julia"]
    assert row["activity_score"] == pytest.approx(0.7921, abs=1e-4)
    assert row["popularity_score"] == pytest.approx(0.6963, abs=1e-4)
    assert row["created_at"] == RECORD["createdAt"] and row["pushed_at"] == RECORD["pushedAt"]
    calendar = curate.curate(raw(spark, RECORD), whole_days=True).first()
    assert calendar["activity_score"] == pytest.approx(0.7919, abs=1e-4)


def test_curated_layout(spark):
    df = curate.curate(raw(spark, RECORD).withColumn("seq", F.lit(7)))
    assert df.columns == [*CURATED_SCHEMA.fieldNames(), "seq"]
    got = [f.dataType.simpleString() for f in df.schema.fields[:-1]]
    assert got == [f.dataType.simpleString() for f in CURATED_SCHEMA.fields]


def test_identity(spark):
    df = raw(
        spark,
        {"nameWithOwner": "a/b"},
        {"nameWithOwner": "", "owner": "<i>o</i>", "name": "n"},
        {"owner": "o"},
        {"owner": "", "name": " \n"},
        {},
    )
    got = [r["name_with_owner"] for r in curate.curate(df).collect()]
    assert got == ["a/b", "o/n", "o/"]


def test_defaults_and_odd_numbers(spark):
    df = raw(
        spark,
        {"nameWithOwner": "a/b"},
        {"nameWithOwner": "a/c", "stars": "3000000000", "forks": "12.7", "issues": "x", "isFork": "true", "license": " "},
    )
    first, second = curate.curate(df).collect()
    assert first["primary_language"] == "Unknown" and first["license"] is None and first["description"] == ""
    assert (first["stars"], first["is_fork"], first["languages"], first["topics"]) == (0, False, [], [])
    assert (second["stars"], second["forks"], second["issues"], second["is_fork"]) == (3000000000, 12, 0, True)
    assert second["license"] is None


def test_list_items_of_both_shapes(spark):
    df = raw(
        spark,
        {
            "nameWithOwner": "a/b",
            "languages": [{"name": "C <b>x</b>"}, "Go", {"size": 1}, {"name": None}, "", None, {"name": "<i>"}],
            "topics": [{"name": "HTTP"}, "Web"],
        },
    )
    row = curate.curate(df).first()
    assert row["languages"] == ["C x", "Go", ""]
    assert row["topics"] == ["http", "web"]


def test_compact_document(spark):
    row = curate.curate(raw(spark, RECORD, {"nameWithOwner": "a/b"}), style="compact").collect()
    assert row[0]["synthesized_text"].endswith("| Topics: oceans, forecast | Description: Harbour tide tables & forecasts from gauge readings. | Stars: 8650 | Activity: 0.7921")
    assert row[1]["synthesized_text"] == "Repository: a/b | Primary Language: Unknown | Topics:  | Description:  | Stars: 0 | Activity: 0.0231"


def test_payload_and_card(spark):
    curated = curate.curate(raw(spark, {"nameWithOwner": "a/b"}, {"nameWithOwner": "a/c", "topics": [f"t{i}" for i in range(15)]}))
    assert "synthesized_text" not in curate.payload(curated).columns
    missing = curated.withColumn("topics", F.lit(None).cast("array<string>"))
    assert curate.payload(missing).first()["topics"] == []
    first, second = curate.result_card(curated).collect()
    assert first["url"] == "https://github.com/a/b" and first["license"] == "No license"
    assert first["description"] == "No description provided."
    assert second["topics"] == [f"t{i}" for i in range(10)]


def test_curation_has_no_shuffle_and_no_python(spark):
    plan = curate.curate(raw(spark, RECORD))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
