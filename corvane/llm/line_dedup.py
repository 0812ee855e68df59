"""Line dedup: two Bloom filters suspect repeated lines, and only suspects shuffle for confirmation.

A line's key is the line without white space (0x20, 0x09-0x0D) at both ends and with A-Z lower-cased.

1. Tasks note the hash of every distinct key of a document in a once-seen and a twice-seen filter;
   the filters of all tasks merge into one pair of bounded size.
2. A second pass emits (document, key) only for keys in the twice-seen filter. They are counted
   exactly, by the key itself, with partial aggregates: a line of a third of all documents reaches
   its reducer as one row per task. Past the filters' bound more keys are suspected and moved; the
   result stays exact.
3. Confirmed keys return to their documents by a join of narrow rows. Documents that lose nothing
   stay where they are; only the others meet their list of keys.

Null and empty texts are one empty line. Equal rows are separate documents, as are rows that share an
id. All columns of the input are kept, whatever their names; ``text``, ``n_lines`` and ``n_dropped`` are the operator's.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import (
    FILTER_FIELDS,
    U64,
    SeenTwice,
    arrow_map,
    builders,
    filter_batch,
    filter_bits,
    key_filter,
    merged_filter,
    mix,
    unused,
    utf8,
)
from corvane.session import materialise

WHITE = b" \t\n\x0b\x0c\r"
MIN_DOCS = 10
MIN_CHARS = 1
SALTS = 32
#: A document of which repeated lines make up this share is a copy, not a text with boilerplate.
COPY_SHARE = 0.5


def line_keys(text: str | None) -> list[bytes]:
    """The key of every line; bytes lower-case and strip ASCII only."""
    return [line.strip(WHITE) for line in utf8(text).lower().split(b"\n")]


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(k, digest_size=8).digest() for k in keys), np.uint64)


def _row_mark(doc_id, text: str | None) -> bytes:
    return hashlib.blake2b(utf8(text), digest_size=16, key=str(doc_id).encode()).digest()


def twice_seen(docs: DataFrame, min_chars: int) -> tuple[np.ndarray, int]:
    """The filter of line keys that two documents may share, and its log2 size."""
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    log2_bits = filter_bits(docs.agg(F.sum(F.coalesce(lines, F.lit(1)))).first()[0] or 0)
    fields = [pa.field("segment", pa.int32()), pa.field("once", pa.binary()), pa.field("twice", pa.binary())]

    def note(batches):
        seen = SeenTwice(log2_bits)
        for batch in batches:
            keys = [k for t in batch.column("text").to_pylist() for k in set(line_keys(t)) if _long_enough(k, min_chars)]
            if keys:
                seen.add(_hashes(keys))
        yield from filter_batch(seen, fields)

    return merged_filter(arrow_map(builders(docs.select("text")), note, FILTER_FIELDS), log2_bits), log2_bits


def suspects(docs: DataFrame, min_chars: int, sized: bool = False) -> DataFrame:
    """(doc_id, mark, key): the distinct suspected keys of every document.

    With ``sized`` also ``size``, the bytes of all distinct keys of the document.
    """
    bits, log2_bits = twice_seen(docs, min_chars)
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def emit(batches):
        for batch in batches:
            ids, marks, found, sizes = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                keys = [k for k in set(line_keys(text)) if _long_enough(k, min_chars)]
                if not keys:
                    continue
                keep = np.flatnonzero(SeenTwice.holds(held.value, _hashes(keys), log2_bits)).tolist()
                if keep:
                    ids += [doc_id] * len(keep)
                    marks += [_row_mark(doc_id, text)] * len(keep)
                    found += [keys[i] for i in keep]
                    sizes += [sum(map(len, keys))] * len(keep)
            if ids:
                arrays = [pa.array(ids, pa.int64()), pa.array(marks, pa.binary()), pa.array(found, pa.binary())]
                arrays += [pa.array(sizes, pa.int64())] * sized
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "mark", "key", "size"][: len(arrays)])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, mark binary, key binary" + ", size bigint" * sized
    found = materialise(arrow_map(rows, emit, schema), "suspects")
    held.destroy()
    return found


def repeated_lines(found: DataFrame, min_docs: int) -> DataFrame:
    """(key, n_docs, first_mark) of the suspects that ``min_docs`` documents hold: the exact count.

    The first occurrence is in the smallest doc_id, ties by the row's mark.
    """
    counts = found.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("doc_id", "mark")).alias("first")
    )
    return counts.where(F.col("n_docs") >= min_docs).select("key", "n_docs", F.col("first.mark").alias("first_mark"))


def first_of_copies(lost: DataFrame, share: float) -> DataFrame:
    """``lost`` (doc_id, mark, _lost, size) with ``_first``: the keys whose first occurrence in a copy is in this row.

    A copy is a document of which lost keys make up ``share`` or more. A key meets its tasks as one row per task.
    """
    copies = lost.where(F.expr("aggregate(_lost, 0L, (n, k) -> n + octet_length(k))") >= F.col("size") * share)
    keys = copies.select("doc_id", "mark", F.explode("_lost").alias("key"))
    first = keys.groupBy("key").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    first = first.groupBy(F.col("first.mark").alias("mark")).agg(F.collect_set("key").alias("_first"))
    return lost.drop("_first", "size").join(first, "mark", "left")


def dedup_lines(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    keep_first: bool = False,
    copy_share: float | None = None,
) -> DataFrame:
    """``docs`` with repeated lines removed from ``text``, plus ``n_lines`` and ``n_dropped``.

    With ``keep_first`` the first line of the first document that holds a key stays. With ``copy_share`` it
    stays in the first document only among those that would lose that share of their text or more: content
    of copies stays once, lines added to other texts go.
    """
    own = [f for f in docs.schema.fields if f.name not in ("n_lines", "n_dropped")]
    docs = docs.select(*(f.name for f in own))
    sized = copy_share is not None
    found = suspects(docs, min_chars, sized)
    confirmed = repeated_lines(found, min_docs)
    # A confirmed key stands once per salt, so that a line of a third of all documents meets it in many tasks.
    salted = confirmed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = found.withColumn("salt", F.pmod(F.hash("mark"), F.lit(SALTS)))
    lost = found.join(salted, ["key", "salt"]).groupBy("doc_id", "mark").agg(
        F.collect_set("key").alias("_lost"),
        F.collect_set(F.when(F.col("mark") == F.col("first_mark"), F.col("key"))).alias("_first"),
        *([F.first("size").alias("size")] if sized else []),
    )
    lost = materialise(lost, "lost")
    if sized:
        lost = materialise(first_of_copies(lost, copy_share), "first")
    ids = lost.select("doc_id").where("doc_id is not null").distinct()
    log2_bits = filter_bits(ids.count(), 26)
    held = docs.sparkSession.sparkContext.broadcast(key_filter(ids, log2_bits))
    extra = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    mark_name, lost_name, first_name = (unused([f.name for f in own], c) for c in ("_mark", "_lost", "_first"))
    marked = T.StructType([*own, T.StructField(mark_name, T.BinaryType())])
    result = T.StructType([*own, *extra])
    at = [f.name for f in own].index("text")

    def touched(batch) -> np.ndarray:
        ids = batch.column("doc_id").cast(pa.int64())
        keys = mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64))
        return SeenTwice.holds(held.value, keys, log2_bits) | ids.is_null().to_numpy(zero_copy_only=False)

    def finished(batch, texts, lines, dropped):
        arrays = list(batch.columns[: len(own)])
        arrays[at] = pa.array(texts, pa.string())
        names = [f.name for f in own] + ["n_lines", "n_dropped"]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names)

    def untouched(batches):
        for batch in batches:
            batch = batch.filter(pa.array(~touched(batch)))
            texts = batch.column("text").to_pylist()
            yield finished(batch, [t or "" for t in texts], [(t or "").count("\n") + 1 for t in texts], [0] * len(texts))

    def mark(batches):
        for batch in batches:
            batch = batch.filter(pa.array(touched(batch)))
            marks = [_row_mark(d, t) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())]
            names = [f.name for f in own] + [mark_name]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.binary())], names)

    def drop(batches):
        for batch in batches:
            texts, lines, dropped = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("text", lost_name, first_name))
            for text, gone, first in zip(*columns):
                gone, spare = set(gone or ()), set(first or ()) if keep_first or sized else set()
                kept, all_ = [], (text or "").split("\n")
                for line, key in zip(all_, line_keys(text)):
                    if key not in gone:
                        kept.append(line)
                    elif key in spare:
                        spare.discard(key)
                        kept.append(line)
                texts.append("\n".join(kept))
                lines.append(len(all_))
                dropped.append(len(all_) - len(kept))
            yield finished(batch, texts, lines, dropped)

    clean = arrow_map(docs, untouched, result)
    rest = arrow_map(docs, mark, marked)
    lost = lost.select(F.col("mark").alias(mark_name), F.col("_lost").alias(lost_name), F.col("_first").alias(first_name))
    rest = arrow_map(rest.join(lost, mark_name, "left").select(*(f.name for f in own), lost_name, first_name), drop, result)
    return clean.unionByName(rest)
