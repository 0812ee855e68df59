"""Registered queries of the operators, each over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, fim, hnsw, line_dedup, ngram_join, packing, secret_scan, sharding, simhash, spelling, spotsigs, toxicity, warc
from corvane.llm.common import read_table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all kinds, and the base spans' digest."""
    rows = secret_scan.scan_secrets(_texts(spark, sf_dir)).drop("text")

    def joined(kept: Column) -> Column:
        return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.KINDS[:3]))
    kinds = F.transform("spans", lambda s: s["kind"])

    def count(kind: str) -> Column:
        return F.size(F.filter(kinds, lambda k: k == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in secret_scan.KINDS[:3]]
    return rows.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness."""
    rows = spotsigs.edited_texts(_texts(spark, sf_dir))
    rows = spotsigs.with_signatures(rows, "edited", "edited_sigs")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.as_text(F.col("sigs")).alias("fingerprint"),
        spotsigs.as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        spotsigs.likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that link at 80 per cent of their 5-word shingles."""
    return ngram_join.ngram_components(_texts(spark, sf_dir))


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vec_id divisible by 20."""
    return hnsw.nearest(read_table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    pieces = packing.token_pieces(_texts(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(_texts(spark, sf_dir), path, public_tokenizers.PATTERN, keep="digest")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every text; labels of held-out rows are not read."""
    docs = _texts(spark, sf_dir)
    model = toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels").where(~held_out()))
    rows = toxicity.score_documents(docs, model)
    flag = F.when(F.col("score") >= toxicity.REJECT, 1).otherwise(0)
    return rows.select("doc_id", held_out().alias("held_out"), "score", flag.alias("predicted"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards whose counts differ by one at most."""
    rows = sharding.interleave(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    none = F.lit(None).cast("int").alias("grown_shard")
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", none, "source")


def captures(pages: DataFrame) -> DataFrame:
    """Capture records of every page: a full response, a revisit a day later, for some pages a revisit
    with other validators or one before the response."""
    kinds = F.concat(
        F.array(F.lit(0), F.lit(1)),
        F.when(F.col("page_id") % 5 == 0, F.array(F.lit(2))).otherwise(F.array().cast("array<int>")),
        F.when(F.col("page_id") % 7 == 0, F.array(F.lit(3))).otherwise(F.array().cast("array<int>")),
    )
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", F.md5(html).alias("h"), F.octet_length(html).alias("size"), F.explode(kinds).alias("k"))
    k = F.col("k")
    ts = F.col("page_id") * 60 + F.get(F.array(*map(F.lit, (0, 86400, 172800, -30))), k)
    tag = lambda h: F.concat(F.lit('"'), F.substring(h, 1, 16), F.lit('"'))
    etag = (
        F.when(k == 2, tag(F.md5("h")))
        .when((k == 1) & (F.col("page_id") % 3 == 0), F.lit(None))
        .when(k == 1, F.concat(F.lit("W/"), tag(F.col("h"))))
        .otherwise(tag(F.col("h")))
    )
    rows = rows.withColumn("ts", ts).withColumn("etag", etag)
    pairs = lambda *kv: F.create_map(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in kv))
    full = pairs(
        "Content-Type", "text/html", "Content-Length", F.col("size"), "Date", F.col("ts"), "Cache-Control", "max-age=60", "ETag", F.col("etag")
    )
    bare = pairs("Date", F.col("ts"), "Cache-Control", "max-age=120", "Content-Length", "0", "Age", "1")
    return rows.select(
        (F.col("page_id") * 4 + k).alias("record_id"), "url", "ts", F.when(k == 0, "response").otherwise("revisit").alias("kind"),
        "etag", (F.col("page_id") * 60 - F.when(k == 2, 0).otherwise(3600)).alias("last_modified"),
        F.when(k == 0, full).otherwise(bare).alias("headers"),
    )


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of the pages' captures with the response it stands for and its merged headers."""
    rows = warc.resolve_revisits(captures(read_table(spark, sf_dir, "pages")))
    return rows.select("record_id", "canonical_url", "ts", "refers_to", "status", warc.header_text(F.col("headers")).alias("headers"))


OP9_SQL = r"""
WITH base AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, ''))) AS size,
    unnest(list_concat(list_concat([0, 1], CASE WHEN page_id % 5 = 0 THEN [2] ELSE [] END), CASE WHEN page_id % 7 = 0 THEN [3] ELSE [] END)) AS k
  FROM pages),
caps AS (
  SELECT page_id * 4 + k AS record_id, url, page_id * 60 + [0, 86400, 172800, -30][k + 1] AS ts, k = 0 AS is_full, size,
    CASE WHEN k = 2 THEN '"' || substr(md5(h), 1, 16) || '"' WHEN k = 1 AND page_id % 3 = 0 THEN NULL
      WHEN k = 1 THEN 'W/"' || substr(h, 1, 16) || '"' ELSE '"' || substr(h, 1, 16) || '"' END AS etag,
    page_id * 60 - CASE WHEN k = 2 THEN 0 ELSE 3600 END AS last_modified,
    regexp_replace(regexp_replace(trim(coalesce(url, '')), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM base),
parts AS (
  SELECT *, regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www[0-9]*\.|:(80|443)$', '', 'g')
      || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS page,
    list_aggregate(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
      lambda p: NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)=|^$'))), 'string_agg', '&') AS kept
  FROM caps),
canon AS (SELECT *, page || CASE WHEN coalesce(kept, '') <> '' THEN '?' || kept ELSE '' END AS canonical_url FROM parts),
found AS (
  SELECT *, last_value(CASE WHEN is_full THEN {'id': record_id, 'etag': etag, 'lm': last_modified, 'size': size} END IGNORE NULLS)
    OVER (PARTITION BY canonical_url ORDER BY ts, is_full, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b
  FROM canon),
checked AS (
  SELECT *, coalesce(regexp_replace(etag, '^W/', '') = regexp_replace(b.etag, '^W/', ''), last_modified = b.lm) AS same
  FROM found WHERE NOT is_full)
SELECT record_id, canonical_url, ts, CASE WHEN b IS NOT NULL AND same THEN b.id END AS refers_to,
  CASE WHEN b IS NULL THEN 'missing' WHEN same IS NULL THEN 'unchecked' WHEN same THEN 'resolved' ELSE 'changed' END AS status,
  CASE WHEN b IS NOT NULL AND same
    THEN 'age: 1' || chr(10) || 'cache-control: max-age=120' || chr(10) || 'content-length: ' || b.size || chr(10)
      || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || b.etag
    ELSE 'age: 1' || chr(10) || 'cache-control: max-age=120' || chr(10) || 'content-length: 0' || chr(10) || 'date: ' || ts END AS headers
FROM checked
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the lines whose key ten documents hold."""
    rows = line_dedup.dedup_lines(_texts(spark, sf_dir))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT rowid AS r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(hot.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot USING (key) GROUP BY r
"""

def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut and reordered, and the text rebuilt from that."""
    rows = fim.fill_in_middle(_texts(spark, sf_dir))
    return rows.select(
        "doc_id",
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
numbers AS (
  SELECT *, ('0x' || substr(h, 1, 8))::UBIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::UBIGINT % (n + 1) AS b,
    ('0x' || substr(h, 17, 8))::UBIGINT % 100 AS c, ('0x' || substr(h, 25, 8))::UBIGINT % 100 AS d FROM drawn),
cuts AS (
  SELECT doc_id, t, n, least(a, b)::BIGINT AS lo, greatest(a, b)::BIGINT AS hi,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain'
      WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (SELECT *, substring(t, 1, lo) AS p, substring(t, lo + 1, hi - lo) AS m, substring(t, hi + 1) AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END)
    AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""

def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, and components of those that differ in three bits at most."""
    rows = simhash.near_components(_texts(spark, sf_dir))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its near words' number, its form and the root of its group."""
    return spelling.spelling_variants(_texts(spark, sf_dir), drop_every=97)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_fingerprints,
        op3_ngram_join,
        op4_hnsw,
        op5_packing,
        op6_bpe,
        op7_toxicity,
        op8_sharding,
        op9_warc_revisits,
        op10_line_dedup,
        op11_fill_in_middle,
        op12_simhash,
        op13_spelling_variants,
    )
}
ORACLES = {"op9_warc_revisits": OP9_SQL, "op10_line_dedup": OP10_SQL, "op11_fill_in_middle": OP11_SQL}
