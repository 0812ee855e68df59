"""The fill-in-middle transformation against a plain version, and its rank index against all boundaries."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import fim, queries
from corvane.llm.common import text_buffers

TEXTS = [
    None, "", " ", "a", "ab", "漢字 かな\n\n", "é" * 3000, "aé漢😀" * 700, "plain " * 90, "has <P> inside", "and <S>", "<M>", "<P", "P><S", "<<P",
    "a<b>c " * 50, "x" * 200_000 + "é" * 200_000 + "😀" * 100_000 + "y" * 50,
]


def plain_version(doc_id, text):
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:lo], text[lo:hi], text[hi:]
    if h4 % 100 < 20:
        return n, "spm", lo, hi - lo, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", lo, hi - lo, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_equals_plain_version_and_restores(spark):
    rows = [(i, t, "clash", 3) for i, t in enumerate(TEXTS * 12)] + [(None, "no id at all", "x", 1), (4, "same id", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, output string, n int").repartition(3)
    out = fim.fill_in_middle(docs).withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted([(-1 if d is None else d, *plain_version(d, t), t or "") for d, t, *_ in rows], key=str)
    got = [(-1 if r.doc_id is None else r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output, r.again) for r in out]
    assert sorted(got, key=str) == want
    assert {r.form for r in out} == {"plain", "spm", "psm"}


def test_other_draws_and_shares(spark):
    docs = spark.createDataFrame([(i, "some words to cut") for i in range(400)], "doc_id bigint, text string")
    a, b = (fim.fill_in_middle(docs, salt=s, plain_percent=0, spm_percent=50) for s in ("1:", "2:"))
    forms = dict(a.groupBy("form").count().collect())
    assert set(forms) == {"psm", "spm"} and min(forms.values()) > 150
    assert a.join(b, ["doc_id", "output"]).count() < 40
    assert fim.fill_in_middle(docs.limit(0)).collect() == []


@pytest.mark.parametrize("unit", fim.UNITS)
@pytest.mark.parametrize("epsilon", [0, 3, 127])
def test_index_has_every_boundary(unit, epsilon):
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("abé漢😀  \n"), 5000)) + "z" * 1000
    data = np.frombuffer(text.encode(), np.uint8)
    if unit == "char":
        cuts = [len(text[:i].encode()) for i in range(len(text) + 1)]
    elif unit == "line":
        cuts = [0, *(len(text[: i + 1].encode()) for i, c in enumerate(text) if c == "\n"), len(data)]
    else:
        begins = [i for i, c in enumerate(text) if i == 0 or (not c.isspace() and text[i - 1].isspace())]
        cuts = [*(len(text[:i].encode()) for i in begins), len(data)]
    index, _ = fim.build_index(data, np.zeros(1, np.int64), unit, epsilon)
    for held in (index, fim.RankIndex.frombytes(index.tobytes())):
        assert held.n == len(cuts) - 1
        assert held.offset(np.arange(len(cuts))).tolist() == cuts
    if epsilon == 127:
        assert len(index.starts) < len(cuts) / 20 and np.abs(index.residuals.astype(int)).max() <= 127


def test_texts_longer_than_a_chunk(monkeypatch):
    monkeypatch.setattr(fim, "CHUNK", 64)
    import pyarrow as pa

    texts = ["é" * 100, "", "ab cd  ef\n" * 30, None, "漢" * 50, " lead", ""]
    data, at = text_buffers(pa.array(texts, pa.string()))
    for unit in fim.UNITS:
        index, ranks = fim.build_index(data, at[:-1], unit)
        for i, text in enumerate(texts):
            own, _ = fim.build_index(*(lambda d, a: (d, a[:-1][: len(d)]))(*text_buffers(pa.array([text], pa.string()))), unit)
            stop = ranks[i + 1] if i + 1 < len(ranks) else index.n
            assert stop - ranks[i] == own.n
            assert (index.offset(np.arange(ranks[i], stop)) - at[i]).tolist() == own.offset(np.arange(own.n)).tolist()


def test_stored_indexes(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    for row in fim.rank_indexes(docs).collect():
        text = TEXTS[row.doc_id] or ""
        index = fim.RankIndex.frombytes(row.rank_index)
        cuts = np.array(sorted({0, len(text) // 3, len(text) // 2, len(text)}))
        assert index.n == row.n == len(text)
        assert index.offset(cuts).tolist() == [len(text[:c].encode()) for c in cuts]


def test_query_on_the_tables(spark):
    out = queries.op11_fill_in_middle(spark, "/root/testdata/sf0.001")
    docs = dict(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    rows = out.collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, form, first, middle, output = plain_version(r.doc_id, docs[r.doc_id])
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (output, docs[r.doc_id] or "")]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, first, middle, *digests)
