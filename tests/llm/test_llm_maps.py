"""Secrets, packing, BPE, toxicity, neighbours, revisits and the pipeline on small and odd tables."""

import base64
import hashlib
import json
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corvane.llm import bpe, hnsw, line_dedup, ngram_join, packing, queries, secret_scan, toxicity, warc

ODD = [
    None, "", " ", "a", "don't STOP  now\n\n\tok", "é" * 300, "x" * 5000, "漢字 かな 123456 ٣٤", "é İ ß Σας.",
    "tabs\tand\r\nlines  end.", "word, word. word.. word.'s 'tis", "<|endoftext|> mid<|startoftext|>dle", "!!! ... ,,,", "A.B,C. d.,",
]


def frame(spark, texts, extra="n_tokens int"):
    return spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], f"doc_id bigint, text string, {extra}")


def test_base_spans():
    text = 'Password: "abc123-x" token=12345 AKIA' + "A" * 16 + " " + "a1" * 12 + " ſecret=abcdefgh"
    kinds = [(s.kind, text[s.start : s.end]) for s in secret_scan.find_secrets(text) if s.kind != "literal"]
    assert kinds == [("assign", 'Password: "abc123-x'), ("access", "AKIA" + "A" * 16), ("hex", "a1" * 12)]
    assert secret_scan.find_secrets(None) == [] == secret_scan.find_secrets("")


def test_constants_reach_sensitive_names():
    text = 'part = "9fK2x"\nrest = "77Qpz8"\nDB_PASSWORD = part + rest\nname = "9fK2x77Qpz8"\nnote: "hello there"'
    found = {text[s.start : s.end] for s in secret_scan.find_secrets(text) if s.kind == "literal"}
    assert found == {"9fK2x", "77Qpz8"}
    json = '{"client_secret": "aB3$kd92Lm", "title": "aB3$kd92Lm"}'
    assert [json[s.start : s.end] for s in secret_scan.find_secrets(json) if s.kind == "literal"] == ["aB3$kd92Lm"]


SECRET = "zK8sd02mQ1xY7"
FORMS = [
    "signing_key            = '%s'", f"signing_key{' ' * 500}= '%s'", f"{'x' * 300}_signing_key = '%s'",
    'const privateKey: string = "%s"', 'apiKey: string = "%s"', 'privateKey?: string | null="%s"', 'def f(private_key: str = "%s", n: int = 3):',
    'private_key: Optional[List[str]] = "%s"', "const SIGNING_KEY: &'static str = \"%s\";", 'signing_key: std::string = "%s"', 'var signingKey string = "%s"',
    'signing_key = b"%s"', "signing_key = Rb'%s'", 'signing_key = f"%s"', 'const SIGNING_KEY: &[u8] = br#"%s"#;', 'signing_key = @"%s"', 'Error: password = "%s"',
]


@pytest.mark.parametrize("form", FORMS)
def test_forms_of_assignment(form):
    text = form % SECRET
    spans = secret_scan.find_secrets(text)
    assert SECRET in {text[s.start : s.end] for s in spans if s.kind == "literal"}
    assert SECRET not in secret_scan.redacted(text, spans)


def test_long_expressions_and_types_without_values():
    parts = [f"z{i}Q" for i in range(40)]
    text = "part = " + " + ".join(f'"{p}"' for p in parts) + "\nsigning_key = part"
    assert [text[s.start : s.end] for s in secret_scan.find_secrets(text)] == parts
    # A value that doubles a thousand times is scored without being written out.
    text = 'a = "x1y2"\n' + "a = a + a\n" * 1000 + "signing_key = a"
    assert [text[s.start : s.end] for s in secret_scan.find_secrets(text)] == ["x1y2"]
    text = f'label: string = "{SECRET}"\nprivateKey: string = other'
    assert secret_scan.find_secrets(text) == []


MORE_FORMS = [
    'password = os.environ.get("APP_PASSWORD", "%s")', "token = getenv('TOKEN', '%s')", 'key = 1\nsecret = wrap("%s")', '"Authorization": "Bearer %s"',
    "headers['Authorization'] = 'Basic %s'", "<password>%s</password>", "<db:secret>\n  %s \n</db:secret>", "DB_PASS=%s", 'signing_key = """%s"""',
    "signing_key = '''%s'''", "https://x.org/?user=7&api_token=%s&n=1", "a=b=signing_key=%s", "signing_key=%s==",
]


@pytest.mark.parametrize("form", MORE_FORMS)
def test_more_forms_of_assignment(form):
    text = form % SECRET
    spans = secret_scan.find_secrets(text)
    assert any(SECRET in text[s.start : s.end] for s in spans if s.kind == "literal"), spans
    assert SECRET not in secret_scan.redacted(text, spans)


def test_names_of_keys_are_no_secrets():
    for text in ('token = os.environ.get("API_TOKEN")', 'password = config("db.password")', "secret = load('path/to/secret')"):
        assert [s for s in secret_scan.find_secrets(text) if s.kind == "literal"] == []


@pytest.mark.parametrize(
    "unit", ["a=1&", "a=a=a=", "a:b:c:", "token=1&", "token:x1:", "key=f(", 'key="', "a='b\"", '="""', "<a>", "<a>b", "a::", "x://a:", "password=x9?", "var a b", "a: b = "]
)
def test_long_unbroken_text_takes_linear_time(unit):
    text = unit * (1_000_000 // len(unit))
    started = time.process_time()
    secret_scan.find_secrets(text)
    assert time.process_time() - started < 25


def independent_base(text):
    """Base spans by stepping through every start, without the patterns."""
    text, out, at, low = text or "", [], 0, (text or "").translate({i: i + 32 for i in range(65, 91)})
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    while at < len(text):
        name = next((n for n in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(n, at)), None)
        end = None
        if name:
            i = at + len(name)
            # An optional quote is taken if it is there: what follows cannot be one.
            i += text[i : i + 1] in ('"', "'") and len(text[i : i + 1])
            while text[i : i + 1] == " ":
                i += 1
            if text[i : i + 1] in (":", "=") and text[i : i + 1]:
                i += 1
                while text[i : i + 1] == " ":
                    i += 1
                i += text[i : i + 1] in ('"', "'") and len(text[i : i + 1])
                j = i
                while j < len(text) and text[j] in value:
                    j += 1
                if j > i:
                    end = j
                    if j - i >= 6:
                        out.append((at, 0, j))
        at = end if end is not None else at + 1
    for kind, chars, least, head in ((1, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20, "AKIA"), (2, set("0123456789abcdef"), 24, "")):
        at = 0
        while at < len(text):
            i = at + len(head)
            if text.startswith(head, at) and i < len(text) and text[i] in chars:
                while i < len(text) and text[i] in chars:
                    i += 1
                if i - at >= least:
                    out.append((at, kind, i))
                at = i
            else:
                at += 1
    return [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out)]


def test_query_equals_independent_base_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in queries.op1_secret_scan(spark, "/root/testdata/sf0.01").collect()}
    for doc_id, text in docs:
        base = independent_base(text)
        row = rows[doc_id]
        assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        counts = [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]
        assert [row.n_assign, row.n_access, row.n_hex] == counts
        assert set(base) <= set(row.spans.split(",")) | ({""} if not base else set())
    assert len(rows) == len(docs) and sum(r.n_assign + r.n_access + r.n_hex for r in rows.values()) > 20


def test_scan_and_redact(spark):
    rows = [t and t + " token = abcdef123456" for t in ODD] + ["ff" * 20, "0" * 23]
    out = secret_scan.scan_secrets(frame(spark, rows, "spans int"), redact=True).orderBy("doc_id").collect()
    for row, text in zip(out, rows):
        base = secret_scan.find_secrets(text)
        assert [s["start"] for s in row.spans] == [s.start for s in base]
        assert row.text == secret_scan.redacted(text, base)
        assert "abcdef123456" not in (row.text or "")
    assert out[-2].text == "[SECRET]" and out[-1].text == "0" * 23


def test_redacts_all_forms(spark):
    out = secret_scan.scan_secrets(frame(spark, [f % SECRET for f in FORMS]), redact=True).collect()
    assert len(out) == len(FORMS) and all(SECRET not in r.text and "[SECRET]" in r.text for r in out)


def test_packing_is_exact_and_gapless(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = ODD + ["the cat sat. " * n for n in (1, 3, 30, 30, 700, 2500)]
    pieces = packing.token_pieces(frame(spark, texts), path, capacity=512).collect()
    for i, text in enumerate(texts):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted((p.piece, p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id == i)
        want = [(k // 512, k, len(ids[k : k + 512]), zlib.crc32(ids[k : k + 512].tobytes())) for k in range(0, len(ids), 512)]
        assert own == want, repr(text)
    packed = packing.pack(packing.token_pieces(frame(spark, texts), path, capacity=512), 512).collect()
    assert len(packed) == len(pieces)
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 512


def test_words_remembered_are_bounded_and_forgotten(spark, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "REMEMBERED", 100)
    rng = np.random.default_rng(3)
    letters = list("abcdeinorstxz") * 6 + list("AEé'.,0#$")
    texts = [" ".join("".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(40)) for _ in range(60)]
    monkeypatch.setattr(packing, "arrow_map", lambda df, fn, schema: fn)
    monkeypatch.setattr(packing, "_encoders", {})
    cut = packing.token_pieces(frame(spark, texts), path, with_ids=True)
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    held = []
    for out in cut(batch.slice(i, 10) for i in range(0, 60, 10)):
        words = packing._encoders[path]
        held.append(len(words) + len(words.older))
        for doc_id, ids in zip(out.column("doc_id").to_pylist(), out.column("ids").to_pylist()):
            assert ids == np.array([*plain.encode(texts[doc_id], add_special_tokens=False).ids, 1], "<u4").tobytes()
    assert 0 < max(held) <= 200
    # The worker stays with Spark after the task; the words do not.
    assert not words and not words.older


def test_all_letters_before_signs_equal_the_plain_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha()]
    texts = [f"{c}{sign}" for c in letters if not 0x3400 <= ord(c) < 0xD800 and ord(c) < 0x20000 for sign in ".,"]
    texts += [f"a{c}. {c}b," for c in letters[::7]] + ["in<|endoftext|>side", "<|ENDOFTEXT|>", " <|startoftext|>.", "A<|endoftext|>.", "<|x|>."]
    for text, encoded in zip(texts, plain.encode_batch(texts, add_special_tokens=False)):
        assert packing.token_bytes(text, path) == np.array([*encoded.ids, 1], "<u4").tobytes(), repr(text)


def test_words_of_known_letters_go_to_the_model_once_a_block(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    known = [chr(c) for c in range(0x21, 0x500) if re.match(packing.DIRECT, chr(c))]
    assert len(known) > 400 and not {"İ", "Σ", "µ", "×", "·", "\u0301"} & set(known)
    for c in known:
        assert plain.normalizer.normalize_str(c) == c.lower() and re.match(packing.DIRECT, c.lower())
    rng = np.random.default_rng(5)
    letters = [c for c in known if c != "|"] + list("aeiou'sré.,0<>#É") * 20
    texts = [" ".join("".join(rng.choice(letters, rng.integers(0, 9))) for _ in range(60)) for _ in range(80)]
    texts += ["Straße, ÉCOLE!!! мир's Ελλάδα2024. don't WE'LL 'tis\tł" + "ó" * 90, None, "", " "]
    monkeypatch.setattr(packing, "_encoders", {})
    packing.token_bytes("", path)
    words, whole, model = packing._encoders[path], [], []

    class Watched:
        def encode(self, word, **_):
            whole.append(word)

        def tokenize(self, signs, own=words.model):
            model.append(signs)
            return own.tokenize(signs)

    words.tokenizer = words.model = Watched()
    ids, stops = packing.token_ids(pa.array(texts * 3, pa.string()), path)
    assert not whole and len(model) - len(set(model)) <= 3  # keys too long to be remembered
    for i, own in enumerate(np.split(ids, stops[:-1])):
        text = texts[i % len(texts)]
        assert own.tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 1], repr(text)


def test_blocks_keep_all_rows_and_other_tokenizers_their_rules(tmp_path, monkeypatch):
    texts = [None, "", "a" * 10, "é" * 40, None, "b", "c" * 200, "", "d" * 30]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    parts = list(packing.blocks(iter([batch.slice(0, 0), batch, batch.slice(2, 3)]), 50))
    assert [i for p in parts for i in p.column("doc_id").to_pylist()] == [*range(9), 2, 3, 4]
    assert 0 < min(p.num_rows for p in parts) and max(p.num_rows for p in parts) < 9
    assert all(sum(len((t or "").encode()) for t in p.column("text").to_pylist()[:-1]) < 50 for p in parts)
    # Cased letters: words of other rules go through the whole tokenizer.
    path = public_tokenizers.path("word_bpe_49k.json")
    rules = json.loads(Tokenizer.from_file(path).to_str())
    rules["normalizer"]["normalizers"].pop()
    (tmp_path / "cased.json").write_text(json.dumps(rules))
    cased = Tokenizer.from_file(str(tmp_path / "cased.json"))
    for kind in (pa.string(), pa.large_string()):
        for name, plain in ((str(tmp_path / "cased.json"), cased), (path, Tokenizer.from_file(path))):
            ids, stops = packing.token_ids(pa.array(ODD, kind).slice(1), name)
            for text, own in zip(ODD[1:], np.split(ids, stops[:-1])):
                assert own.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1], repr(text)


@pytest.mark.parametrize("seed", range(4))
def test_sweep_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, 400).tolist()
    counts = {n: lengths.count(n) for n in set(lengths)}
    rules, used = packing.sweep(counts, 64)
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps[gaps.index(min(fit))] -= n
        else:
            gaps.append(64 - n)
    assert used == len(gaps)
    assert sum(r[2] for r in rules) == 400


@pytest.fixture(scope="module")
def encoder():
    return bpe.PrefixEncoder(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))


def test_bpe_equals_tiktoken(spark, encoder):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.encode_documents(frame(spark, ODD), path, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    for row, text in zip(out, ODD):
        assert row.ids == plain.encode_ordinary(text or "")
        assert encoder.decode(row.ids) == (text or "").encode()
    digests = bpe.encode_documents(frame(spark, ODD), path, public_tokenizers.PATTERN, keep="digest").collect()
    assert [r.n_tokens for r in sorted(digests, key=lambda r: r.doc_id)] == [len(r.ids) for r in out]


def test_bpe_appends_and_edits(encoder):
    rng = np.random.default_rng(1)
    data = bytes(rng.choice(list(b"abcdethein gos"), 400).tolist())
    table = encoder.table(data)
    assert encoder.append(data[:150], encoder.table(data[:150]), data[150:]) == table
    for start, end, new in ((10, 12, b"the"), (0, 5, b""), (390, 400, b"xyz"), (200, 200, b"in the"), (50, 300, b"q")):
        after, edited = encoder.edit(data, table, start, end, new)
        assert after == data[:start] + new + data[end:]
        assert edited == encoder.table(after)


def test_toxicity_learns_and_survives_odd_input(spark):
    rng = np.random.default_rng(0)
    words = ["the", "house", "green", "river", "walks", "you", "often", "under", "stone"]
    rows = []
    for i in range(600):
        text = rng.choice(words, 30).tolist()
        if i % 5 == 0:
            text[rng.integers(30)] = ("grobli", "Snarfo!", "gr0bli")[i % 3]
        rows.append((i, " ".join(text), i % 5 == 0))
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(1000, None, 0.1), (1001, "", 0.1)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows if i % 3] + [(2000, 1), (None, 1), (5, None)], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    found = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    assert len(found) == 602 and all(0 <= s <= 1 for s in found.values())
    held = [(found[i], y) for i, _, y in rows if not i % 3]
    assert np.mean([(s >= 0.7) == y for s, y in held]) > 0.95
    empty = toxicity.fit_toxicity(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_documents(docs, empty).collect()} == {0.0}


def test_toxicity_looks_at_a_word_once(monkeypatch):
    calls = []
    plain_word = toxicity.plain_word
    monkeypatch.setattr(toxicity, "plain_word", lambda w: calls.append(w) or plain_word(w))
    lexicon, remembered = {"grobli": 2.0, "snar~": 1.5}, {}
    texts = ["you GROBLI snarfo! the green river", "the green green river, you gr0bli", "YOU the snarfo!"] * 20
    found = [toxicity.features(t, lexicon, remembered) for t in texts]
    assert len(calls) == len({w for t in texts for w in t.split()})
    own = dict(zip(toxicity.FEATURES, found[0]))
    assert (own["hits"], own["weight_density"], own["shouted_share"], own["hits_near_second"]) == (2.0, 3.5 / 6, 1 / 6, 1.0)


def test_toxicity_features_of_odd_words():
    lexicon = {"grobli": 2.0, "é": 1.5, "abcd~": 3.0}
    words = ["gr0bli", "g*robli", "***", "heyyy", "ÉTÉ", "é", "x²y", "a1", "٠a", "you!", "tU", "İİİ", "aAa", "11", "\x1c", "abcdef", "ok-ok", "ÀB"]
    rng = np.random.default_rng(5)
    remembered = {}
    for _ in range(50):
        own = rng.choice(words, rng.integers(1, 30)).tolist()
        text = "\u3000 \n".join(own)
        own, plain = re.findall(r"[^\x20\x09-\x0D]+", text), toxicity.plain_word
        cores = [w.strip(toxicity._EDGE) for w in own]
        weights = [toxicity.word_weight(plain(w), lexicon) for w in own]
        f = dict(zip(toxicity.FEATURES, toxicity.features(text, lexicon, remembered)))
        assert f["hits"] == sum(w > 0 for w in weights)
        assert f["disguised_hits"] == sum(w > 0 and not c.isalpha() for w, c in zip(weights, cores))
        assert f["second_share"] == sum(plain(w) in toxicity.SECOND_PERSON for w in own) / len(own)
        assert f["capital_share"] == sum(c.isupper() for c in text) / len(text)
        assert f["shouted_share"] == sum(len(w) > 2 and w.isupper() for w in own) / len(own)
        assert f["digit_in_word"] == sum(any(map(str.isdigit, c)) and any(map(str.isalpha, c)) for c in cores) / len(own)
        assert f["stretched"] == sum(any(a == b == c for a, b, c in zip(w, w[1:], w[2:])) for w in own) / len(own)
        assert f["masked"] == sum("*" in c and not c.isalnum() for c in cores) / len(own)


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[200:500] = x[200]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(5000, None, 1), (5020, [0.0] * 16, 1), (5040, [float("nan")] * 16, 1), (5060, [None] + [1.0] * 15, 1), (5080, [], 1), (5100, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, score int")
    found = {}
    for r in hnsw.nearest(df, shard_rows=400).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(range(0, 1500, 20))
    hits, d = 0, x.astype(float)
    for q, own in found.items():
        scores = (d * d[q]).sum(axis=1)
        scores[q] = -np.inf
        best = np.lexsort((np.arange(1500), -scores))[:20]
        hits += len({v for v, _ in own} & set(best.tolist()))
        assert own == sorted(own, key=lambda t: (-t[1], t[0])) and all(abs(scores[v] - s) < 1e-9 for v, s in own)
    assert hits / (20 * len(found)) >= 0.9
    few = hnsw.nearest(df.where("vec_id < 5")).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert hnsw.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("longest", [1e2, 1e6, 1e15])
def test_neighbours_beside_long_and_short_vectors(spark, longest):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= longest
    x[11] /= longest
    x[300:600] *= rng.uniform(1, 1e3, (300, 1))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    found = {}
    for r in hnsw.nearest(df, shard_rows=500).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    d, hits = x.astype(float), 0
    for q, own in found.items():
        scores = d @ d[q]
        scores[q] = -np.inf
        hits += len(own & set(np.lexsort((np.arange(len(d)), -scores))[:20].tolist()))
    assert len(found) == 60 and hits / (20 * 60) >= 0.9


CLASHES = "_mark _lost _first _label _p _r _score _vector _raw _features _curved _rank _rank_part _rank_at _rank_before _Node shingle num label key u v"


def test_clashing_column_names(spark):
    extra = CLASHES.split()
    rows = [(i, f"same line\nown words of line {i}" + " you snarfo" * (i % 4 == 0), *range(len(extra))) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{c} int" for c in extra))
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(24)], "doc_id bigint, toxic int"))
    outs = {
        "lines": line_dedup.dedup_lines(docs),
        "copies": line_dedup.dedup_lines(docs, copy_share=0.5),
        "scores": toxicity.score_documents(docs, model),
        "kept": ngram_join.keep_one(docs.unionByName(docs.where("doc_id < 3").withColumn("text", F.lit("another text of that id here")))),
        "secrets": secret_scan.scan_secrets(docs, redact=True),
    }
    for name, out in outs.items():
        assert set(docs.columns) <= set(out.columns), name
        for r in out.collect():
            assert [r[c] for c in extra] == list(range(len(extra))), name
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    pieces = pieces.select("*", *(F.lit(i).alias(c) for i, c in enumerate(extra)))
    for r in packing.pack(pieces).collect():
        assert [r[c] for c in extra] == list(range(len(extra)))


def test_empty_tables_give_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    path = public_tokenizers.path("word_bpe_49k.json")
    assert secret_scan.scan_secrets(docs, redact=True).collect() == []
    assert packing.pack(packing.token_pieces(docs, path)).collect() == []
    assert bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect() == []
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.score_documents(docs, model).collect() == []
    records = spark.createDataFrame([], "record_id bigint, url string, ts bigint, kind string, etag string, last_modified bigint, headers map<string,string>")
    assert warc.resolve_revisits(records).collect() == []
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, "unused").collect() == []


def test_revisits(spark):
    h = {"Content-Type": "text/html", "ETag": '"a"', "Date": "1"}
    n = {"date": "9", "Content-Length": "0", "X": "y"}
    rows = [
        (1, "http://www.a.org:80/x/?b=2&a=1&utm_source=q#f", 10, "response", '"a"', None, h),
        (2, "https://A.org/x?a=1&b=2", 10, "revisit", '"a"', None, n),
        (3, "https://A.org/x?a=1&b=2", 11, "revisit", 'W/"a"', None, n),
        (4, "a.org/x?a=1&b=2", 10_000_000, "revisit", '"b"', None, n),
        (5, "a.org/x?b=2&a=1", 90_000_000, "revisit", None, None, n),
        (6, None, 5, "response", None, 7, h), (7, None, 6, "revisit", '"q"', 7, None), (8, "a.org/X", None, "revisit", None, None, n),
    ]
    schema = "record_id bigint, url string, ts bigint, kind string, etag string, last_modified bigint, headers map<string,string>"
    found = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, schema)).collect()}
    assert {k: (r.status, r.refers_to) for k, r in found.items()} == {
        2: ("missing", None), 3: ("resolved", 1), 4: ("changed", None), 5: ("unchecked", None), 7: ("resolved", 6), 8: ("missing", None),
    }
    assert found[3].headers == {"Content-Type": "text/html", "ETag": '"a"', "date": "9", "X": "y"}
    assert found[7].headers == h


def test_pipeline_stages(spark, tmp_path):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        text = " ".join(rng.choice(words, 40))
        if i % 8 == 0:
            text += " grobli snarfo"
        if i % 10 == 1:
            text = "Shared notice line\n" + text
        if i == 33:
            text += ' password = "zK8sd02mQ1"'
        rows.append((i, text, "en", "s", len(text)))
    rows += [(400, rows[3][1] + " end", "en", "s", 0), (401, None, None, None, None), (402, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(400)], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        kept.append({r.doc_id: r.text for r in docs.collect()})
    assert set(kept[0]) == {r[0] for r in rows if r[0] % 8 or r[0] > 399}
    assert all("Shared notice" not in (t or "") for t in kept[1].values()) and set(kept[1]) == set(kept[0])
    assert set(kept[1]) - set(kept[2]) == {400}
    assert "zK8sd02mQ1" not in kept[3][33] and "[SECRET]" in kept[3][33]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(kept[3])


def test_pipeline_keeps_one_of_many_copies(spark, tmp_path):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    prose = [" ".join(rng.choice(words, 40)) for _ in range(240)]
    rows = [(i, "Shared notice line\n" + t if i % 4 == 1 else t + " grobli" * (i % 8 == 0)) for i, t in enumerate(prose)]
    lines = [" ".join(rng.choice(words, 12)) for _ in range(8)]
    rows += [(1000 + i, "\n".join(lines[:4])) for i in range(15)]
    rows += [(2000 + i, "\n".join([*lines[4:], f"own line {i}"])) for i in range(12)]
    rows += [(3000 + i, "Menu\nImprint" if i % 2 else "Menu\nContact") for i in range(24)] + [(4000, ""), (4001, None)]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int("grobli" in (t or ""))) for i, t in rows], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    after = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        after.append({r.doc_id: r.text for r in docs.collect()})
    assert {i for i, _ in rows if i >= 1000} <= set(after[0])
    texts = after[-1]
    assert [i for i in texts if 1000 <= i < 2000] == [1000] and texts[1000] == "\n".join(lines[:4])
    assert texts[2000] == "\n".join([*lines[4:], "own line 0"]) and all(texts[2000 + i] == f"own line {i}" for i in range(1, 12))
    assert {i: t for i, t in texts.items() if 3000 <= i < 4000} == {3000: "Menu\nContact", 3001: "Imprint"}
    assert all("Shared notice" not in (t or "") for t in texts.values())
    assert {i for i, t in texts.items() if not t} == {4000, 4001}
    docs = spark.read.parquet(str(tmp_path / f"stage{len(after) - 1}"))
    assert {r.doc_id for r in corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).collect()} == set(texts)


def test_registered_queries():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 14))
    assert F is not None
