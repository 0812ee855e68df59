"""N-gram join, line dedup, fingerprints and sharding against brute force on small and odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import common, line_dedup, ngram_join, queries, sharding, spotsigs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string"


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute_components(rows, threshold=80):
    sets, label = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.fixture(scope="module")
def near_texts():
    """Chains of edits, copies, shared passages, short and odd texts."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    rows, n = [], 0
    for group in range(12):
        text = [rng.choice(words) for _ in range(rng.choice((12, 40, 120)))] + (passage if group % 3 == 0 else [])
        for _ in range(rng.choice((1, 2, 9))):
            rows.append((n, " ".join(text)))
            n += 1
            if rng.random() < 0.7:
                text = list(text)
                text[rng.randrange(len(text))] = f"edit{n}"
    odd = [None, "", "   \n\t", "one", "ONE", "one two three four", "a b c", "É é É é É", "é é é é é", " ".join(["same"] * 50), " ".join(["same"] * 70)]
    return rows + [(n + i, t) for i, t in enumerate(odd)]


def test_components_equal_brute_force(spark, near_texts):
    df = spark.createDataFrame(near_texts, SCHEMA).repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df).collect()}
    assert found == brute_components(near_texts)


def test_large_group_of_near_copies(spark):
    """One group that no star covers: every text differs from the base in places of its own."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randrange(0, 4)):
            text[rng.randrange(len(text))] = f"x{i}"
        rows.append((i, " ".join(text)))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == brute_components(rows)


def test_keep_one_and_other_columns(spark):
    text = "one two three four five six seven"
    rows = [(3, text, "x", 1), (1, text.upper(), "y", 2), (2, None, "z", 3), (9, "", "z", 4), (3, text, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, node string, n int")
    kept = ngram_join.keep_one(df)
    assert set(kept.columns) == set(df.columns)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 9]


def test_keep_one_of_a_repeated_id(spark):
    text, other = "one two three four five six seven", "eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, text, "x"), (5, text.upper(), "a"), (5, other, "b"), (5, None, "c"), (7, other, "d"), (8, text, "e"), (None, text, "f")]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, node string"))
    assert sorted(r.node for r in kept.collect()) == ["b", "c", "f", "x"]


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ngram_join.ngram_components(df).count() == 0
    assert line_dedup.dedup_lines(df).count() == 0
    assert spotsigs.edited_texts(df).count() == 0
    assert sharding.interleave(df.withColumn("source", F.lit("s"))).count() == 0


def brute_lines(texts, least):
    def keys(t):
        return [line.strip(" \t\n\x0b\x0c\r").translate(LOWER) for line in (t or "").split("\n")]

    counts = {}
    for t in texts:
        for key in set(keys(t)):
            counts[key] = counts.get(key, 0) + 1
    out = []
    for t in texts:
        kept = [line for line, key in zip((t or "").split("\n"), keys(t)) if not (key and counts[key] >= least)]
        out.append(("\n".join(kept), (t or "").count("\n") + 1))
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(2)
    pool = ["Hello  ", " hello", " hello", "ÉTÉ", "été", "", "  ", "long " * 400, *(f"line {i}" for i in range(30))]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 8))) for _ in range(60)] + [None, "", "\n", "hello"]
    rows = [(i, t, i, "k") for i, t in enumerate(texts)] + [(None, "hello", 1, "k"), (5, texts[5], 5, "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_lines int, key string").repartition(4)
    found = sorted(((r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()))
    want = brute_lines([r[1] for r in rows], 10)
    assert found == sorted((t, n, n - (t.count("\n") + 1 if t or n == 1 else 0)) for t, n in want) or [f[:2] for f in found] == sorted(want)
    assert sum(f[2] for f in found) > 0


def test_first_occurrence_stays(spark):
    rows = [(i, f"common\nown {i}\nCommon") for i in range(12)]
    found = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA), keep_first=True).collect()}
    assert found[0] == "common\nown 0" and all(found[i] == f"own {i}" for i in range(1, 12))


def test_fingerprints(spark, tmp_path):
    texts = ["The cat of the house and a dog in it", None, "", "x", "The cat of the house and a dog in it", "é" * 7, "und der Hund " * 500]
    rows = [(i * 7, t, "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in queries.op2_fingerprints(spark, str(tmp_path)).collect()}
    plain = [t or "" for t in texts]
    for i, text in enumerate(plain):
        row, after = found[i * 7], plain[(i + 1) % len(plain)]
        half = len(text) // 2
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
    assert found[0].fingerprint == found[28].fingerprint and found[7].near_next == 1.0


def test_next_row_across_ranges(spark):
    rng = random.Random(1)
    ids = rng.sample(range(10_000), 300)
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], SCHEMA).repartition(6)
    order = sorted(ids)
    found = {r.doc_id: r.next_text for r in spotsigs.with_next(df, rows_per_range=20).collect()}
    assert found == {a: f"text {b}" for a, b in zip(order, order[1:] + order[:1])}


def brute_signatures(text, chain=2):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    content = [w for w in words if w not in spotsigs.ANCHORS]
    out, seen = set(), 0
    for w in words:
        if w in spotsigs.ANCHORS:
            if seen + chain <= len(content):
                out.add((w, *content[seen : seen + chain]))
        else:
            seen += 1
    return out or {tuple(words)}


def test_signatures_and_near_pairs(spark):
    rng = random.Random(4)
    words = [f"c{i}" for i in range(60)] + spotsigs.ANCHORS[:8] * 4
    rows = []
    for i in range(40):
        text = [rng.choice(words) for _ in range(60)]
        rows.append((2 * i, " ".join(text)))
        text[rng.randrange(60)] = "new"
        rows.append((2 * i + 1, " ".join(text)))
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = {r.doc_id: len(r.sigs) for r in spotsigs.with_signatures(df, "text", "sigs").collect()}
    sets = {d: brute_signatures(t) for d, t in rows}
    assert sizes == {d: len(s) for d, s in sets.items()}
    found = {(r.u, r.v): round(r.likeness, 9) for r in spotsigs.near_pairs(df, 0.6).collect()}
    # Equal fingerprints are one: their smallest id.
    least = sorted({frozenset(s): d for d, s in sorted(sets.items(), reverse=True)}.values())
    want = {}
    for a in least:
        for b in least:
            if a < b and (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.6:
                want[a, b] = round(j, 9)
    assert found == want


def test_shards(spark):
    rows = [(i, None if i == 4 else "é" * (i % 9), "hot" if i % 3 else None) for i in range(1003)] + [(7, "é" * 7, "hot")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(7)
    found = sharding.interleave(df, shards=40).collect()
    counts = {}
    for r in found:
        counts.setdefault(r.shard, []).append(r)
    sizes = [len(c) for c in counts.values()]
    assert len(found) == 1004 and len(sizes) == 40 and max(sizes) - min(sizes) <= 1
    for own in counts.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        hot = sum(r.source == "hot" for r in own)
        assert abs(hot - len(own) * 670 / 1004) <= 2
    assert all(r.text_crc32 == zlib.crc32(("é" * (r.doc_id % 9) if r.doc_id != 4 else "").encode()) for r in found)


def test_counters_follow_the_cores_not_the_partitions(spark):
    """Each task sends one table of counters, so a table of many small files must not mean many of them."""
    cores = spark.sparkContext.defaultParallelism
    rows = [(i, " ".join(f"w{i * 7 + k}" for k in range(9))) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5 * cores)
    sets = ngram_join.named_sets(docs)
    assert sets.where("segment is null").count() == len(rows)
    assert sets.where("segment is not null").groupBy("segment").count().agg(F.max("count")).first()[0] <= cores


def test_counts_beyond_sixteen_bits():
    counts = ngram_join.ShingleCounts()
    common, rare = np.uint64(5 << 40), np.uint64((1 << 64) - 1)
    for _ in range(3):
        counts.add(np.concatenate([np.full(70_000, common), [rare]]))
    found = {s: np.frombuffer(zlib.decompress(c), np.uint32) for s, c in counts.rows()}
    assert set(found) == {0, 255}
    assert (found[0][5], found[0].sum()) == (210_000, 210_000)
    assert (found[255][-1], found[255].sum()) == (3, 3)


def test_edges_take_few_files(spark):
    """Components of a chain and a star, by few tasks whatever the number of partitions."""
    cores = spark.sparkContext.defaultParallelism
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)]
    wide = spark.newSession()
    wide.conf.set("spark.sql.shuffle.partitions", 5 * cores)
    wide.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    labels = common.components(wide.createDataFrame(edges, "u bigint, v bigint").repartition(5 * cores))
    assert {r.node: r.label for r in labels.collect()} == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 160), 100)}
    assert len({f.rsplit("/", 1)[-1] for f in labels.inputFiles()}) <= cores


def test_a_worker_gives_memory_back(monkeypatch):
    class Rows:
        def mapInArrow(self, fn, schema):
            return list(fn(iter([pa.RecordBatch.from_arrays([pa.array(range(600))], ["n"])])))

    seen = []
    monkeypatch.setattr(common, "give_back", lambda: seen.append(True))
    assert [b.num_rows for b in common.arrow_map(Rows(), lambda batches: batches, "n bigint")] == [256, 256, 88]
    assert seen == [True]
