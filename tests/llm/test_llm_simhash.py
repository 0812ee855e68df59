"""SimHash against brute force: fingerprints, bit-sliced distances, components of near and equal texts."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corvane.llm import queries, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \n\t", "one", "ONE", "one two", "a b c", "A  B\tC", "É é É", "x" * 5000, "no break here now", "same " * 900, "same " * 3]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=3):
    """rows: (doc_id, fingerprint)."""
    label = {f: f for _, f in rows}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    own = sorted(label)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if bin(a ^ b).count("1") <= radius:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    least = {}
    for d, f in rows:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return {f: least.get(root(f)) for _, f in rows}


def test_fingerprints_of_pieces(monkeypatch):
    rng = random.Random(2)
    long = " ".join(rng.choice(["Aa", "bé", "c", "漢字", "dd\n"]) for _ in range(3000))
    for chunk in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        for text in [*ODD, long]:
            assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 7])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), False)) for _ in range(300)]
    values = np.concatenate([base, base ^ np.array(flips, np.uint64)])
    planes = simhash.planes_of(values)
    for d in (1, 63, 64, 65, 300, 599):
        words = np.arange(planes.shape[1] - 2)
        valid = simhash.packed((np.arange(len(words) * 64) < len(values) - d).reshape(-1, 64))
        got = simhash.near_at(planes, words, valid, d, radius)
        want = [i for i in range(len(values) - d) if bin(int(values[i] ^ values[i + d])).count("1") <= radius]
        assert got.tolist() == want


def near_values(rng, groups):
    """Fingerprints in chains, stars and balls; some of them far from all."""
    out = []
    for size, flips in groups:
        own = center = rng.getrandbits(64)
        for _ in range(size):
            out.append(own)
            own = (center if rng.random() < 0.5 else own) ^ sum(1 << b for b in rng.sample(range(64), flips))
    return out


@pytest.mark.parametrize("tile", [8192, 16])
def test_links_keep_all_components(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(tile)
    values = near_values(rng, [(1, 0), (2, 3), (40, 1), (40, 2), (60, 3), (30, 4), (5, 9)] + [(1, 0)] * 200)
    rows = list(enumerate(values))
    signed = [(d, f - (1 << 64) if f >> 63 else f) for d, f in rows]
    nodes = spark.createDataFrame(signed, "least bigint, fp bigint").groupBy("fp").agg(F.min("least").alias("least"))
    links = {(r.u, r.v) for r in simhash.near_links(nodes).collect()}
    for u, v in links:
        assert u != v and bin((u ^ v) & (1 << 64) - 1).count("1") <= 3
    label = {f: f for _, f in signed}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    for u, v in links:
        x, y = sorted((root(u), root(v)))
        label[y] = x
    want = plain_components(rows)
    got = {}
    for (d, f), (_, s) in zip(rows, signed):
        got.setdefault(root(s), set()).add(want[f])
    assert all(len(x) == 1 for x in got.values()) and len(got) == len(set(want.values()))


def test_dense_group_costs_few_rows():
    values = np.array([1 << b for b in range(64)] + [0], np.uint64).repeat(1)
    n = len(values)
    u, v = simhash.joining_links(values, np.full(n, n), np.zeros(n, bool), np.zeros(n, bool), 3)
    assert len(u) == n - 1


def test_components_equal_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts = list(ODD) * 2
    for _ in range(25):
        text = [rng.choice(words) for _ in range(rng.choice((15, 80, 400)))]
        for _ in range(rng.choice((1, 3, 8))):
            texts.append(" ".join(text))
            text = list(text)
            text[rng.randrange(len(text))] = rng.choice(words)
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "one", "x", 2), (None, "alone without an id", "x", 2), (3, "A b C", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, label int").repartition(3)
    out = simhash.near_components(docs).collect()
    prints = [(d, plain_fingerprint(t)) for d, t, *_ in rows]
    want = plain_components(prints)
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in out), key=str)
    assert got == sorted(((d, f, want[f]) for d, f in prints), key=str)
    assert len(set(want.values())) < len(texts) - 20
    assert simhash.near_components(docs.limit(0)).collect() == []


def test_query_on_the_tables(spark):
    rows = queries.op12_simhash(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    prints = [(d, plain_fingerprint(t)) for d, t in docs]
    want = plain_components(prints)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows) == sorted((d, f"{f:016x}", want[f]) for d, f in prints)
