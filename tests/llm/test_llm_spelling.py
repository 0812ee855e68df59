"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import queries, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, drop_every=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def plain_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    """word -> (n, n_near, form, form_n, root)"""
    # Near words share one with a letter left out, or are it.
    holes = {}
    for w in counts:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            holes.setdefault(key, []).append(w)
    near = {w: set() for w in counts}
    for own in holes.values():
        for a in own:
            near[a].update(b for b in own if plain_near(a, b))
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], counts.get(form[w]), root)
    return out


def variants(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(4, 9))) for _ in range(120)] + ["Straße", "ÜBERALL", "naïveté", "x" * 300, "x" * 301]
    texts = []
    for i in range(400):
        words = []
        for _ in range(rng.choice((0, 5, 60))):
            w = base[min(rng.randrange(len(base)), rng.randrange(len(base)))]
            if rng.random() < 0.3:
                p = rng.randrange(len(w))
                w = rng.choice((w[:p] + w[p + 1 :], w[:p] + rng.choice("abcé") + w[p + 1 :], w[:p] + rng.choice("abcé") + w[p:]))
            words.append(rng.choice((w, w.upper(), w.title())))
        texts.append(rng.choice((" ", "-", "\n", "7")).join(words))
    texts += ["chains " * 40, "chains, chainsé. " * 15, "chainsée! " * 5 + "chainsée" + "xy chainsée" * 2]
    out = list(enumerate([*texts, None, "", "1 2 3", "ab cd"]))
    return out + [(None, texts[3]), (None, None), (5, texts[5]), (5, texts[5])]


def frame(spark, rows):
    full = [(d, t, "clash", 1) for d, t in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, word string, n int").repartition(3)


@pytest.mark.parametrize("cell, sample", [(4096, 1 << 16), (20, 1 << 16), (30, 64)])
def test_variants_equal_brute_force(spark, rows, monkeypatch, cell, sample):
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "SAMPLE", sample)
    counts = plain_counts(rows)
    want = plain_variants(counts)
    got = variants(spelling.spelling_variants(frame(spark, rows), drop_every=97))
    assert got == want
    assert len(want) > 200 and sum(r[2] is not None for r in want.values()) > 20
    assert any(want[r[2]][2] is not None for r in want.values() if r[2] is not None)


def test_pieces_and_held_words(spark, rows, monkeypatch):
    monkeypatch.setattr(spelling, "CHUNK", 16)
    monkeypatch.setattr(spelling, "HELD_WORDS", 10)
    counted = {r.word: r.n for r in spelling.word_counts(frame(spark, rows), drop_every=97).where("n >= 3").collect()}
    assert counted == plain_counts(rows)
    assert "".join(spelling._pieces("É Ab".encode() * 9)) == "É ab" * 9


def test_one_edit_and_empty(spark):
    words = ["abcde", "abcdf", "abced", "abcd", "bcde", "abxde", "aabcde", "abcdee", "edcba"]
    for a in words:
        for b in words:
            if len(a) <= len(b) <= len(a) + 1:
                got = bool(spelling.one_edit(spelling.codes_of([a]), spelling.codes_of([b]))[0])
                assert got == plain_near(a, b), (a, b)
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_long_chain_of_forms(spark):
    words = ["a" * (5 + i) for i in range(9)]
    table = spark.createDataFrame([(w, 3 * 2**i) for i, w in enumerate(words)], "word string, n bigint")
    links = spelling.forms(table).where("form is not null").select("word", F.col("form").alias("root"))
    assert {r.word: r.root for r in spelling.roots(links).collect()} == {w: words[-1] for w in words[:-1]}


def test_leaves_fill_the_space():
    rng = np.random.default_rng(1)
    sample = ["".join(rng.choice(list("abcdefé"), 6)) for _ in range(500)]
    others = ["".join(rng.choice(list("abcdefgzé"), 6)) for _ in range(300)]
    router = spelling.Router(sample, 50_000)
    counts = spelling.letter_counts(spelling.codes_of(others))
    home = router.home(6, counts)
    assert len(set(home.tolist())) > 5
    visited = [set() for _ in others]
    for cell, who in router.cells(6, counts, 1):
        for w in who:
            visited[w].add(cell)
    for i, w in enumerate(others):
        assert home[i] in visited[i]
        for j, v in enumerate(others):
            if plain_near(w, v):
                assert home[j] in visited[i]


def test_query_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert variants(queries.op13_spelling_variants(spark, "/root/testdata/sf0.01")) == plain_variants(plain_counts(docs))
