"""Helpers shared by the corpus operators: hashing, twice-seen filters, components, native ranges."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.session import materialise

U64 = np.uint64
MASK64 = (1 << 64) - 1
#: Bytes of filter in one row, and bits of the largest filter that is broadcast (32 MB).
SEGMENT_BYTES = 16 << 10
MAX_FILTER_BITS = 28


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(taken: Iterable[str], name: str) -> str:
    """``name``, lengthened until no column has it (Spark tells no case apart)."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def utf8(value: str | None) -> bytes:
    return (value or "").encode("utf-8", "surrogatepass")


def builders(df: DataFrame) -> DataFrame:
    """Few, long-running tasks for work that keeps a fixed-size summary per task.

    Their number follows the cores, not the input, so the summaries to merge do too.
    """
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def squeezed(values: np.ndarray) -> bytes:
    """A task's share of a summary is sparse: it shrinks to a fraction before it is written and shuffled."""
    return zlib.compress(values.tobytes(), 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class SeenTwice:
    """Two Bloom filters of equal size: keys seen once, and keys seen at least twice.

    ``add`` takes keys that each count once (distinct within a document). Partial filters of
    different tasks merge without loss: a key of both lies in the intersection of the first filters.
    """

    def __init__(self, log2_bits: int):
        self.log2 = log2_bits
        self.once = np.zeros(1 << (log2_bits - 3), np.uint8)
        self.twice = np.zeros(1 << (log2_bits - 3), np.uint8)

    @staticmethod
    def places(keys: np.ndarray, log2_bits: int) -> tuple[np.ndarray, np.ndarray]:
        shift = U64(64 - log2_bits)
        return (keys * U64(0x9E3779B97F4A7C15)) >> shift, mix(keys) >> shift

    @staticmethod
    def holds(bits: np.ndarray, keys: np.ndarray, log2_bits: int) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for p in SeenTwice.places(keys, log2_bits):
            found &= (bits[p >> U64(3)] >> (p & U64(7)).astype(np.uint8)) & 1 == 1
        return found

    def put(self, bits: np.ndarray, keys: np.ndarray) -> None:
        for p in self.places(keys, self.log2):
            np.bitwise_or.at(bits, p >> U64(3), np.uint8(1) << (p & U64(7)).astype(np.uint8))

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        again = (counts > 1) | self.holds(self.once, keys, self.log2)
        self.put(self.twice, keys[again])
        self.put(self.once, keys)

    def rows(self) -> Iterator[tuple[int, bytes, bytes]]:
        step = min(SEGMENT_BYTES, len(self.once))
        for i in range(0, len(self.once), step):
            if self.once[i : i + step].any():
                yield i // step, squeezed(self.once[i : i + step]), squeezed(self.twice[i : i + step])


FILTER_FIELDS = "segment int, once binary, twice binary"


def filter_bits(keys: int, most: int = MAX_FILTER_BITS) -> int:
    """log2 of the filter size for so many keys: 8 bits a key, up to the bound.

    Past the bound more keys are suspected than repeat; results stay exact, more rows move.
    """
    return int(min(most, max(17, np.ceil(np.log2(max(1, keys) * 8)))))


def merged_filter(parts: DataFrame, log2_bits: int, which: str = "twice") -> np.ndarray:
    """The merged filter of all tasks' ``FILTER_FIELDS`` rows; its size is fixed by ``log2_bits``."""

    def merge(pdf):
        once = twice = np.zeros(min(SEGMENT_BYTES, 1 << (log2_bits - 3)), np.uint8)
        for a, b in zip(pdf["once"], pdf["twice"]):
            a = np.frombuffer(zlib.decompress(a), np.uint8)
            twice = twice | np.frombuffer(zlib.decompress(b), np.uint8) | (once & a)
            once = once | a
        out = {"segment": [pdf["segment"].iloc[0]], "bits": [(twice if which == "twice" else once).tobytes()]}
        return type(pdf)(out)

    total = 1 << (log2_bits - 3)
    bits = np.zeros(total, np.uint8)
    step = min(SEGMENT_BYTES, total)
    for row in parts.groupBy("segment").applyInPandas(merge, "segment int, bits binary").collect():
        at = row["segment"] * step
        bits[at : at + step] = np.frombuffer(row["bits"], np.uint8)
    return bits


def filter_batch(seen: SeenTwice, fields: list[pa.Field]) -> Iterator[pa.RecordBatch]:
    """A task's filter as batches of the given schema; columns other than the filter's are null."""
    rows = list(seen.rows())
    for i in range(0, len(rows), 256):
        part = rows[i : i + 256]
        own = dict(zip(("segment", "once", "twice"), zip(*part)))
        arrays = [pa.array(own[f.name], f.type) if f.name in own else pa.nulls(len(part), f.type) for f in fields]
        yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))


def key_filter(keys: DataFrame, log2_bits: int) -> np.ndarray:
    """A Bloom filter of a one-column DataFrame of longs, bounded by ``log2_bits``."""
    name = keys.columns[0]
    fields = [pa.field("segment", pa.int32()), pa.field("once", pa.binary()), pa.field("twice", pa.binary())]

    def build(batches):
        seen = SeenTwice(log2_bits)
        for batch in batches:
            values = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            seen.put(seen.once, mix(values.view(U64)))
        yield from filter_batch(seen, fields)

    return merged_filter(builders(keys.select(name)).mapInArrow(build, FILTER_FIELDS), log2_bits, "once")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its values (nulls are empty)."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v); label is the least node of the component.

    Alternating large-star and small-star rounds: every round is one aggregate and one join over the
    edges, written to the shared folder, and a chain halves with every round. The least neighbour
    comes from a partial aggregate, so a node with many links sends one row per task. Edges are narrow:
    a task goes through several of their partitions, one after another.
    """
    flat = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    flat = materialise(builders(flat), "links")
    state = None
    while True:
        mark = flat.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(mark) == state or not mark[0]:
            break
        state = tuple(mark)
        both = flat.unionByName(flat.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = builders(both.groupBy("u").agg(F.min("v").alias("m"))).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = builders(large.distinct())
        least = builders(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        flat = materialise(builders(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), "links")
    children = flat.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = flat.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return children.unionByName(roots)


def unit_starts(columns: list[np.ndarray]) -> np.ndarray:
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def whole_units(batches, order: list[str], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted partition in batches of about ``rows`` that do not part a unit (equal ``order`` columns)."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= rows:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            last = int(unit_starts([whole.column(c).to_numpy() for c in order])[-1])
            if last:
                yield whole.slice(0, last)
            held, count = [whole.slice(last)], whole.num_rows - last
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def dense_rank_rows(df: DataFrame, keys: list[str | Column], name: str) -> DataFrame:
    """``name``: the row's place from 0 in the order of ``keys``, without a single-task sort.

    Rows are range-partitioned and sorted, written once to the shared folder (range bounds are
    sampled, so a second evaluation could deal rows otherwise) and shifted by the sizes of the
    partitions before theirs: one row per partition. Equal rows get different places.
    """
    low = F.monotonically_increasing_id()
    part, at, before = (unused([*df.columns, name], c) for c in ("_rank_part", "_rank_at", "_rank_before"))
    placed = materialise(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("*", F.shiftright(low, 33).cast("int").alias(part), low.bitwiseAND((1 << 33) - 1).alias(at)),
        "ranked",
    )
    sizes = sorted((r[part], r["n"]) for r in placed.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect())
    rows, seen = [], 0
    for number, n in sizes:
        rows.append((number, seen))
        seen += n
    shift = df.sparkSession.createDataFrame(rows, f"{part} int, {before} bigint")
    return placed.join(F.broadcast(shift), part).withColumn(name, F.col(before) + F.col(at)).drop(part, at, before)


def range_bucket(df: DataFrame, key: str, rows_per_bucket: int, most: int = 1 << 17) -> tuple[Column, int]:
    """A column that numbers ranges of ``key`` with about so many rows each, and their number.

    Bounds are quantiles of the key column alone. The column finds its range by bisection over the
    bounds, so it is one expression of about 17 steps a row. Null keys lie in the first range.
    """
    total = df.agg(F.count(key)).first()[0]
    n = int(min(most, max(1, total // rows_per_bucket)))
    if n == 1:
        return F.lit(0), 1
    shares = [i / n for i in range(1, n)]
    bounds = df.agg(F.percentile_approx(key, shares, 100 * n).alias("b")).first()["b"]
    bounds = sorted(set(bounds))
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    held = F.from_json(F.lit(str(bounds)), "array<bigint>")

    def bisect(low: Column, step: Column) -> Column:
        return F.when(F.get(held, low + step - 1) <= F.col(key), low + step).otherwise(low)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), bisect), len(bounds) + 1


def give_back() -> None:
    """Return what this worker has freed to the system: Spark keeps workers, and idle ones hold it beside the busy."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def arrow_map(
    df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, rows: int = 256
) -> DataFrame:
    """``mapInArrow`` in batches of at most ``rows``: texts are wide, and a worker turns whole batches into objects.

    The session's own batch size stays as it is; Spark bounds it by bytes, too. A worker gives freed memory
    back after each task.
    """

    def sliced(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)

    def mapped(batches):
        try:
            yield from fn(sliced(batches))
        finally:
            give_back()

    return df.mapInArrow(mapped, schema)
