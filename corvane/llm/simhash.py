"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has a bit set where more than half of the hashes of the text's word shingles (repeats
included) have it. Fingerprints that differ in at most ``radius`` bits link.

1. Equal fingerprints are one node, by a partial aggregate, so copies cost nothing further.
2. The 64 bits are cut into ``radius + 2`` blocks. Linked fingerprints agree in at least two blocks, so
   they meet in a bucket for one pair of blocks. Buckets of one node go at once. A bucket of more than
   ``TILE`` nodes is cut into tiles by hash, and every pair of tiles becomes a unit of work of its own.
3. A task takes whole units, thousands of buckets at a time, and stores their bits as planes: one
   machine word holds the same bit of 64 fingerprints. Shifted by d places against itself, a plane
   gives that bit's difference for 64 pairs at once; carry-save counters add up the planes, and a block
   of 64 pairs is abandoned once all of its pairs exceed the radius (or lie in different buckets).
4. Within a unit only links that join two parts are emitted, so a dense group of n nodes costs n - 1
   rows and ends as soon as it is connected; components of those links are those of all links.

Null and empty texts and texts without words: fingerprint zero, linked like any other. Texts with fewer
words than a shingle: the whole sequence is the one shingle. Equal rows give equal rows; rows that share
a doc_id share nothing but what their texts give. A null doc_id is no candidate for a component's name;
a component without another name has a null one. Only ``doc_id`` and ``text`` are read, so other columns
of any name are left out. Long texts are hashed a piece at a time.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import U64, arrow_map, components, text_buffers, unit_starts, whole_units
from corvane.session import materialise

RADIUS = 3
WORDS_PER_SHINGLE = 3
SEED = 42
#: Bytes of a text hashed at a time.
CHUNK = 1 << 20
#: Nodes of a tile, and planes added between two looks at what can be abandoned.
TILE = 8192
PLANES = 8
_SPACES = b" \t\n\x0b\x0c\r"


def _words(data: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words of a text, in lists of about ``CHUNK`` bytes that end between words."""
    low = 0
    while low < len(data):
        high = low + CHUNK
        while high < len(data) and data[high] not in _SPACES:
            high += 1
        yield data[low:high].lower().split()
        low = high


def fingerprint(data: bytes, words: int = WORDS_PER_SHINGLE) -> int:
    """The unsigned fingerprint of a text's bytes."""
    ones, total, held = np.zeros(64, np.int64), 0, []
    for own in _words(data):
        held += own
        if len(held) >= words:
            joined = map(b" ".join, zip(*(held[i:] for i in range(words))))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined, itertools.repeat(SEED)), ">u8", len(held) - words + 1)
            ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
            total += len(hashes)
            held = held[len(held) - words + 1 :]
    if not total and held:
        whole = np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], ">u8")
        ones, total = np.unpackbits(whole.view(np.uint8)).astype(np.int64), 1
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS_PER_SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` holds the 64 bits as a signed number."""

    def build(batches):
        for batch in batches:
            data, at = text_buffers(batch.column("text"))
            found = [fingerprint(data[a:b].tobytes(), words) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, U64).view(np.int64))], ["doc_id", "fp"])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"), build, "doc_id bigint, fp bigint")


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes of 64-bit numbers: row p holds bit p of all, 64 to a word, and two spare words."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    words = -(-len(values) // 64) + 2
    out = np.zeros((64, words * 8), np.uint8)
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return out.view(U64)


def packed(flags: np.ndarray) -> np.ndarray:
    """Rows of 64 flags as one word each."""
    return np.packbits(flags, axis=-1, bitorder="little").view(U64).ravel()


def shifted(plane: np.ndarray, words: np.ndarray, d: int) -> np.ndarray:
    """The plane's bits ``d`` places further on, for the given words."""
    at, s = words + (d >> 6), d & 63
    low = plane.take(at, mode="clip")
    return low if not s else (low >> U64(s)) | (plane.take(at + 1, mode="clip") << U64(64 - s))


def carry_save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry of three bits in every lane."""
    either = a ^ b
    return either ^ c, (a & b) | (either & c)


class Counters:
    """Bitwise counters of 64 lanes a word: numbers up to the radius in ``radius.bit_length()`` planes."""

    def __init__(self, words: int, radius: int):
        self.radius = radius
        self.bits = [np.zeros(words, U64) for _ in range(radius.bit_length())]
        self.over = np.zeros(words, U64)

    def add(self, planes: list[np.ndarray]) -> None:
        """Add planes of equal weight: three bits of a weight become one of it and one of the next."""
        for k, held in enumerate(self.bits):
            carries = []
            for i in range(0, len(planes), 2):
                pair = planes[i : i + 2]
                if len(pair) == 2:
                    held, carry = carry_save(held, *pair)
                else:
                    held, carry = held ^ pair[0], held & pair[0]
                carries.append(carry)
            self.bits[k], planes = held, carries
        for plane in planes:
            self.over |= plane

    def within(self) -> np.ndarray:
        """Lanes whose number does not exceed the radius."""
        more, equal = np.zeros_like(self.over), ~np.zeros_like(self.over)
        for k in reversed(range(len(self.bits))):
            if self.radius >> k & 1:
                equal &= self.bits[k]
            else:
                more |= equal & self.bits[k]
                equal &= ~self.bits[k]
        return ~(self.over | more)

    def keep(self, kept: np.ndarray) -> None:
        self.bits = [b[kept] for b in self.bits]
        self.over = self.over[kept]


def near_at(planes: np.ndarray, words: np.ndarray, valid: np.ndarray, d: int, radius: int) -> np.ndarray:
    """Lanes i of ``words`` that are ``valid`` and whose fingerprint is near the one ``d`` places on."""
    counters = Counters(len(words), radius)
    for p in range(0, 64, PLANES):
        counters.add([planes[q][words] ^ shifted(planes[q], words, d) for q in range(p, p + PLANES)])
        left = (valid & ~counters.over) != 0
        if not left.any():
            return np.zeros(0, np.int64)
        if left.mean() < 0.75:
            words, valid = words[left], valid[left]
            counters.keep(left)
    found = np.unpackbits((valid & counters.within()).view(np.uint8), bitorder="little").reshape(-1, 64)
    w, lane = np.nonzero(found)
    return words[w] * 64 + lane


def joining_links(values: np.ndarray, ends: np.ndarray, cross: np.ndarray, tile: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of near pairs within each unit that join its parts.

    ``ends`` is the end of the unit of every row; rows of a ``cross`` unit are compared only with rows of
    the other tile. Distances d between places are taken in turn, all units at once.
    """
    n = len(values)
    planes = planes_of(values)
    size = (planes.shape[1] - 2) * 64
    left = np.zeros(size, np.int64)
    left[:n] = ends - np.arange(n) - 1
    tiles = planes_of(tile.astype(U64))[0]
    apart = packed(np.pad(cross, (0, size - n)).reshape(-1, 64))
    starts = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]])) if n else np.zeros(0, np.int64)
    parent = np.arange(n)
    life = left.reshape(-1, 64).max(axis=1) if size else left
    found, d = [], 1
    while (words := np.flatnonzero(life >= d)).size:
        valid = packed(left.reshape(-1, 64)[words] >= d)
        valid &= ~apart[words] | (tiles[words] ^ shifted(tiles, words, d))
        i = near_at(planes, words, valid, d, radius)
        i = i[parent[i] != parent[i + d]] if len(i) else i
        if len(i):
            found += join(parent, i, i + d)
            low, high = np.minimum.reduceat(parent, starts), np.maximum.reduceat(parent, starts)
            done = np.repeat(low == high, np.diff(np.append(starts, n)))
            left[:n][done] = 0
            life = left.reshape(-1, 64).max(axis=1)
        d += 1
    u, v = zip(*found) if found else ((), ())
    return np.array(u, np.int64), np.array(v, np.int64)


def join(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Merge the parts of the pairs; ``parent`` stays flat. Returns the pairs that joined two parts."""
    of: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := of.get(x, x)) != x:
            x = up
        return x

    kept = []
    for a, b in zip(u.tolist(), v.tolist()):
        x, y = root(int(parent[a])), root(int(parent[b]))
        if x != y:
            of[max(x, y)] = min(x, y)
            kept.append((a, b))
    if of:
        moved = np.array(list(of))
        names = np.arange(len(parent))
        names[moved] = [root(x) for x in of]
        parent[:] = names[parent]
    return kept


def block_bounds(radius: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``radius + 2`` blocks."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def near_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links between distinct fingerprints ``fp`` whose components are those of all links."""
    if not 0 <= radius <= 15:
        raise ValueError("radius must be from 0 to 15")

    def block(low: int, width: int):
        return F.shiftrightunsigned("fp", low).bitwiseAND((1 << width) - 1)

    pairs = list(itertools.combinations(block_bounds(radius), 2))
    keys = [F.struct(F.lit(t).alias("t"), F.shiftleft(block(*a), b[1]).bitwiseOR(block(*b)).alias("k")) for t, (a, b) in enumerate(pairs)]
    rows = nodes.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.t", "key.k")
    counts = rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    rows = rows.join(counts, ["t", "k"]).withColumn("tiles", F.ceil(F.col("c") / TILE).cast("int"))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    units = rows.select("t", "k", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "fp")
    order = ["t", "k", "a", "b"]
    units = units.repartition(*order).sortWithinPartitions(*order, "tile")

    def compare(batches):
        for part in whole_units(batches, order):
            columns = [part.column(c).to_numpy() for c in (*order, "tile", "fp")]
            starts = unit_starts(columns[:4])
            ends = np.repeat(np.append(starts[1:], len(columns[0])), np.diff(np.append(starts, len(columns[0]))))
            values = columns[5].astype(np.int64).view(U64)
            u, v = joining_links(values, ends, columns[2] != columns[3], columns[4] == columns[3], radius)
            yield pa.RecordBatch.from_arrays([pa.array(columns[5][u]), pa.array(columns[5][v])], ["u", "v"])

    return arrow_map(units, compare, "u bigint, v bigint", 1 << 16).distinct()


def near_components(docs: DataFrame, radius: int = RADIUS, words: int = WORDS_PER_SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id that links reach, the row's own included.
    """
    rows = materialise(fingerprints(docs, words), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    labels = components(materialise(near_links(nodes, radius), "near")).withColumnRenamed("node", "fp")
    nodes = nodes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "label").select("fp", "component_id")
    return rows.join(named, "fp", "left").select("doc_id", "fp", "component_id")
