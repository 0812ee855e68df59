"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds its distinct shingles of five words. Two sets link when
``100 * |intersection| >= threshold * |union|`` (threshold in per cent, 80 by default).

1. One pass counts all shingles into a fixed table of counters, kept as one byte each on a logarithmic
   scale, and names every set. (counter, hash) is one total order for all documents, rare first;
   counters only steer the order, so neither their collisions nor their scale cost a result.
2. A second pass sorts each set in that order and keeps its prefix: linked sets share a prefix shingle.
   Equal sets (copies) become one node by a partial aggregate, before anything is posted.
3. Every prefix shingle is posted under a key of 48 bits of its hash, and tasks read whole buckets in
   order. The counters tell which shingles are so common that their bucket is dealt to several tasks.
   Every member meets the bucket's first node (the smallest set that can lead off a linked pair), so a
   group of near copies costs a star, not all its pairs. Buckets of three or more stay open.
4. Linked nodes become components. In open buckets that still hold nodes of different components every two
   of these are compared by the filters, in tiles of bounded size. A first round verifies only pairs that
   would join a tile's components, at most one for each node; what still lies in different components after
   that is compared whole, without the pairs that failed, so every link between two components is found.
5. Length and positional filters act where a pair is made, then the suffix filter (an upper bound of the
   overlap from counts in fixed partitions of the sets), before sets are fetched. A pair is verified
   once, by the exact intersection.

Nulls and texts without words: empty set, linked with nothing, component of their own. Shorter texts
(1 to 4 words): the whole sequence is the one shingle. Equal rows give equal output rows; rows that
share a doc_id share its component. A null doc_id counts as no candidate for the component's name.
``keep_one`` keeps all columns, whatever their names; the others read ``doc_id`` and ``text`` alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import U64, SeenTwice, arrow_map, builders, components, filter_bits, key_filter, mix, squeezed, unit_starts, unused, whole_units
from corvane.llm.ngrams import all_shingles, set_id, shingle_sets
from corvane.session import materialise

THRESHOLD = 80
#: Counters of the frequency table (16 MB as it is sent out), steps of their scale to a doubling, and
#: counters in one row while the tasks' tables are summed.
COUNTER_BITS = 24
SCALE = 10
COUNTER_SEGMENT = 1 << 16
#: Partitions of the suffix filter, and how many of them are joined into one for its first look.
PARTS = 256
FOLD = 8
#: The low bits of a key number the shares of a common shingle's bucket (0: not shared out); aimed-at rows of a share.
SHARE_BITS = 16
SHARE_ROWS = 50_000
#: The low bits of a posting's place in its bucket hold its place in the prefix.
POS_BITS = 31
#: Nodes of a tile where all of a bucket are compared, and pairs looked at together.
TILE = 1024
BLOCK = 1 << 18
#: Rounds that verify one pair for each node and tile; then one of all pairs that are left.
ROUNDS = 1


def prefix_length(n: int, threshold: int) -> int:
    """Shingles of a set of ``n`` of which a linked set must hold one."""
    return n - (threshold * n + 99) // 100 + 1


def least_overlap(n: np.ndarray, m: np.ndarray, threshold: int) -> np.ndarray:
    """Least overlap of linked sets of these sizes."""
    return -(-(threshold * (n + m)) // (100 + threshold))


def may_link(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray, threshold: int) -> np.ndarray:
    """Length and positional filter: places i and j can be the first common ones of sets of n and m shingles."""
    near = 100 * np.minimum(n, m) >= threshold * np.maximum(n, m)
    return near & (np.minimum(n - i, m - j) >= least_overlap(n, m, threshold))


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte each, in steps of a tenth of a doubling."""
    return np.minimum(np.rint(SCALE * np.log2(1.0 + counts)), 255).astype(np.uint8)


class ShingleCounts:
    """A task's counters by the upper bits of the hash: 16 bits each, and what goes beyond them beside the table."""

    HALF = 1 << 15

    def __init__(self):
        self.table = np.zeros(1 << COUNTER_BITS, np.uint16)
        self.over: dict[int, int] = {}

    def add(self, shingles: np.ndarray) -> None:
        for low in range(0, len(shingles), self.HALF):
            at = shingles[low : low + self.HALF] >> U64(64 - COUNTER_BITS)
            np.add.at(self.table, at, 1)
            full = np.unique(at[self.table[at] >= self.HALF])
            self.table[full] -= np.uint16(self.HALF)
            for place in full.tolist():
                self.over[place] = self.over.get(place, 0) + self.HALF

    def rows(self) -> Iterator[tuple[int, bytes]]:
        beyond = np.array(sorted(self.over.items()), np.int64).reshape(-1, 2)
        for low in range(0, len(self.table), COUNTER_SEGMENT):
            part = self.table[low : low + COUNTER_SEGMENT].astype(np.uint32)
            own = beyond[np.searchsorted(beyond[:, 0], low) : np.searchsorted(beyond[:, 0], low + COUNTER_SEGMENT)]
            part[own[:, 0] - low] += own[:, 1].astype(np.uint32)
            if part.any():
                yield low // COUNTER_SEGMENT, squeezed(part)


SETS = "doc_id bigint, n bigint, node binary, segment int, counts binary"


def named_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n, node) of every document, and rows of each task's counters (segment, counts), written once.

    The tasks are as many as the cores, so what their counters take on disk does not grow with the documents.
    """
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
    schema = pa.schema([pa.field(c.split()[0], k) for c, k in zip(SETS.split(", "), kinds)])

    def read(batches):
        counts = ShingleCounts()
        for batch in batches:
            own = shingle_sets(batch.column("text"))
            if own:
                counts.add(np.concatenate(own))
            nodes = pa.array([set_id(s) if len(s) else None for s in own], pa.binary())
            arrays = [batch.column("doc_id"), pa.array([len(s) for s in own], pa.int64()), nodes]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.nulls(len(own), k) for k in kinds[3:])], schema=schema)
        for segment, part in counts.rows():
            arrays = [pa.nulls(1, k) for k in kinds[:3]]
            arrays += [pa.array([segment], pa.int32()), pa.array([part], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return materialise(arrow_map(builders(docs.select(F.col("doc_id").cast("bigint"), "text")), read, SETS), "sets")


def shingle_counters(sets: DataFrame) -> np.ndarray:
    """All tasks' counters in one table, by the upper bits of the hash, one byte each."""

    def total(pdf):
        both = sum(np.frombuffer(zlib.decompress(c), np.uint32).astype(np.uint64) for c in pdf["counts"])
        return type(pdf)({"segment": [pdf["segment"].iloc[0]], "counts": [squeezed(scaled(both))]})

    table = np.zeros(1 << COUNTER_BITS, np.uint8)
    parts = sets.where("segment is not null").select("segment", "counts")
    for row in parts.groupBy("segment").applyInPandas(total, "segment int, counts binary").collect():
        at = row["segment"] * COUNTER_SEGMENT
        own = np.frombuffer(zlib.decompress(row["counts"]), np.uint8)
        table[at : at + len(own)] = own
    return table


def part_counts(shingles: np.ndarray) -> bytes | None:
    """How many of a set lie in each partition, one byte each, compressed; None if one holds more than a byte tells."""
    parts = np.bincount((shingles >> U64(7)) & U64(PARTS - 1), minlength=PARTS)
    return squeezed(parts.astype(np.uint8)) if parts.max() < 256 else None


def part_table(parts: list[bytes | None]) -> np.ndarray:
    """One row of counts for each set; zeros where they are not known."""
    rows = [zlib.decompress(p) if p else bytes(PARTS) for p in parts]
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, PARTS)


def node_table(docs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(num, node, doc_id, n, keys, parts) of every distinct set: a number, one document that has it, its prefix."""
    table = shingle_counters(sets)
    held = docs.sparkSession.sparkContext.broadcast(table)
    shift = U64(64 - COUNTER_BITS)
    names = ["node", "doc_id", "n", "keys", "parts"]

    def order(batches):
        counters = held.value
        for batch in batches:
            rows, ids = [], batch.column("doc_id").to_pylist()
            for doc_id, own in zip(ids, shingle_sets(batch.column("text"))):
                if len(own):
                    count = counters[own >> shift]
                    rare = own[np.argsort(count, kind="stable")[: prefix_length(len(own), threshold)]]
                    node = set_id(own)
                    common = np.exp2(counters[rare >> shift].astype(float) / SCALE) / SHARE_ROWS
                    shares = np.minimum(np.ceil(common), (1 << SHARE_BITS) - 1).astype(np.uint64)
                    share = np.where(shares > 1, 1 + int.from_bytes(node[:8], "little") % shares, 0).astype(np.uint64)
                    keys = (rare >> U64(SHARE_BITS) << U64(SHARE_BITS)) | share
                    rows.append((node, doc_id, len(own), keys.tobytes(), part_counts(own)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    rows = arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"), order, "node binary, doc_id bigint, n bigint, keys binary, parts binary")
    one = [F.any_value(c).alias(c) for c in names[2:]]
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *one)
    nodes = materialise(nodes.select(F.monotonically_increasing_id().alias("num"), *names), "nodes")
    held.destroy()
    return nodes


def postings(nodes: DataFrame, threshold: int) -> DataFrame:
    """(key, place, num) of every prefix shingle; ``place`` orders a bucket: first those that can lead off a
    linked pair (their place can be the first common one with a set of their size or more), by set size.

    It holds, from the upper bits down, whether the posting comes late, the size and the place in the prefix.
    """

    def post(batches):
        for batch in batches:
            keys = [np.frombuffer(k, np.int64) for k in batch.column("keys").to_pylist()]
            if not keys:
                continue
            sizes = np.array([len(k) for k in keys])
            pos = np.concatenate([np.arange(s) for s in sizes])
            n = np.repeat(batch.column("n").to_numpy(), sizes)
            late = (n - pos < least_overlap(n, n, threshold)).astype(np.int64)
            arrays = [np.concatenate(keys), late << 62 | n << POS_BITS | pos, np.repeat(batch.column("num").to_numpy(), sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["key", "place", "num"])

    return arrow_map(nodes.select("num", "n", "keys"), post, "key bigint, place bigint, num bigint")


def first_round(nodes: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v) of every bucket's first node with its members, and the postings of buckets that stay open."""
    rows = postings(nodes, threshold).repartition("key").sortWithinPartitions("key", "place", "num")
    names, kinds = ["u", "v", "key", "num", "n", "pos"], [pa.int64()] * 4 + [pa.int32()] * 2

    def stars(batches):
        for part in whole_units(batches, ["key"]):
            key, place, num = (part.column(c).to_numpy() for c in ("key", "place", "num"))
            late, n, pos = place >> 62, place >> POS_BITS & ((1 << (62 - POS_BITS)) - 1), place & ((1 << POS_BITS) - 1)
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            starts = np.flatnonzero(new)
            bucket = np.cumsum(new) - 1
            lead = starts[bucket]
            led = late[lead] == 0
            fits = led & ~new & may_link(n, pos, n[lead], pos[lead], threshold)
            pairs = np.unique(np.sort(np.column_stack([num[lead[fits]], num[fits]]), axis=1), axis=0)
            # A late posting is of use beside a smaller set that leads off; other shares may hold that.
            shared = (key & ((1 << SHARE_BITS) - 1)) != 0
            useful = shared | led & ((late == 0) | (n > n[lead]))
            count = np.add.reduceat(useful, starts) if len(starts) else starts
            stay = np.flatnonzero(useful & (shared | (count[bucket] >= 3)))
            if len(pairs):
                none = [pa.nulls(len(pairs), k) for k in kinds[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *none], names)
            if len(stay):
                none = [pa.nulls(len(stay), k) for k in kinds[:2]]
                values = [key[stay] >> SHARE_BITS, num[stay], n[stay].astype(np.int32), pos[stay].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*none, *map(pa.array, values)], names)

    found = materialise(arrow_map(rows, stars, "u bigint, v bigint, key bigint, num bigint, n int, pos int", 1 << 16), "buckets")
    pairs = builders(found.where("u is not null").select("u", "v").distinct())
    return pairs, found.where("key is not null").select(F.col("key").alias("shingle"), "num", "n", "pos")


def mixed_buckets(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings with their ``label`` in buckets that hold more than one component."""
    own = rows.select("shingle", "num", "n", "pos").join(labels, "num", "left").withColumn("label", F.coalesce("label", "num"))
    ends = own.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    return materialise(builders(own.join(ends.where("low <> high").select("shingle"), "shingle", "left_semi")), "mixed")


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most shingles that sets with these counts by partition can share."""
    return np.minimum(a, b).sum(axis=1, dtype=np.int64)


def joining_pairs(mixed: DataFrame, nodes: DataFrame, failed: DataFrame, threshold: int, every: bool = False) -> DataFrame:
    """(u, v): pairs of different components that share a bucket and pass all filters, tile by tile.

    Of a tile's pairs only those are given that would join its components if all of them held: at most one
    for each node. ``failed`` (u, v) names pairs that were verified before and do not link. With ``every``
    all pairs are given.
    """
    counts = mixed.groupBy("shingle").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    both = failed.unionByName(failed.select(F.col("v").alias("u"), F.col("u").alias("v")))
    apart = both.groupBy(F.col("u").alias("num")).agg(F.collect_list("v").alias("apart"))
    named = mixed.select("num").distinct().join(nodes.select("num", "parts"), "num").join(apart, "num", "left")
    rows = mixed.join(counts, "shingle").join(named, "num")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("num"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    order = ["shingle", "a", "b"]
    low, high = F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b")
    rows = rows.select("shingle", low, high, "tile", "num", "n", "pos", "label", "parts", "apart")
    rows = rows.repartition(*order).sortWithinPartitions(*order, "tile", "num")

    def candidates(part) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        tile, a, b, num, n, pos, label = (part.column(c).to_numpy().astype(np.int64) for c in ("tile", "a", "b", "num", "n", "pos", "label"))
        known = part.column("parts").to_pylist()
        parts = part_table(known)
        unknown = np.array([p is None for p in known])
        folded = parts.reshape(len(parts), -1, FOLD).sum(axis=2, dtype=np.uint16)
        not_linked = {(x, y) for x, own in zip(num.tolist(), part.column("apart").to_pylist()) for y in own or ()}
        step = max(1, BLOCK // max(1, len(num)))
        for low in range(0, len(num), step):
            i, j = np.nonzero(label[low : low + step, None] != label[None])
            i += low
            keep = (i < j) & ((a[i] == b[i]) | (tile[i] != tile[j]))
            i, j = i[keep], j[keep]
            keep = may_link(n[i], pos[i], n[j], pos[j], threshold)
            i, j = i[keep], j[keep]
            for counts in (folded, parts):
                least = least_overlap(n[i], n[j], threshold)
                keep = unknown[i] | unknown[j] | (overlap_bound(counts[i], counts[j]) >= least)
                i, j = i[keep], j[keep]
            if not_linked:
                keep = np.array([p not in not_linked for p in zip(num[i].tolist(), num[j].tolist())], bool)
                i, j = i[keep], j[keep]
            yield i, j

    def chosen(part) -> list[tuple[int, int]]:
        num, label = part.column("num").to_pylist(), part.column("label").to_pylist()
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        pairs = []
        for i, j in candidates(part):
            for x, y in zip(i.tolist(), j.tolist()):
                a, b = root(label[x]), root(label[y])
                if every or a != b:
                    up[max(a, b)] = min(a, b)
                    pairs.append((min(num[x], num[y]), max(num[x], num[y])))
        return pairs

    def compare(batches):
        for part in whole_units(batches, order, rows=TILE):
            starts = np.append(unit_starts([part.column(c).to_numpy() for c in order]), part.num_rows).tolist()
            pairs = sorted({p for x, y in zip(starts, starts[1:]) for p in chosen(part.slice(x, y - x))})
            u, v = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return builders(arrow_map(rows, compare, "u bigint, v bigint").distinct())


def suffix_filter(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose overlap can still suffice, by the counts of both sets in fixed partitions."""

    def keep(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = [batch.column(c) for c in ("parts_u", "parts_v")]
            a, b = (part_table(s.to_pylist()) for s in sides)
            unknown = np.logical_or(*(s.is_null().to_numpy(zero_copy_only=False) for s in sides))
            n, m = (batch.column(c).to_numpy() for c in ("n_u", "n_v"))
            likely = unknown | (overlap_bound(a, b) >= least_overlap(n, m, threshold))
            yield batch.filter(pa.array(likely)).select(["u", "v"])

    def side(name: str) -> DataFrame:
        return nodes.select(F.col("num").alias(name), F.col("parts").alias(f"parts_{name}"), F.col("n").alias(f"n_{name}"))

    full = pairs.join(side("v"), "v").join(side("u"), "u")
    return builders(arrow_map(full.select("u", "v", "n_u", "n_v", "parts_u", "parts_v"), keep, "u bigint, v bigint"))


def node_sets(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(num, leads, shingles) of every node in ``pairs``, read again from one document of each; ``leads``: it is a u."""
    spark = docs.sparkSession
    named = pairs.select(F.col("u").alias("num"), F.lit(True).alias("leads"))
    named = named.unionByName(pairs.select(F.col("v").alias("num"), F.lit(False).alias("leads")))
    named = named.groupBy("num").agg(F.max("leads").alias("leads"))
    wanted = materialise(builders(named.join(nodes, "num").select("num", "node", "doc_id", "leads")), "wanted")
    ids = wanted.select("doc_id").where("doc_id is not null")
    # 16 bits a key: every document that the filter lets through by mistake is shuffled with its set.
    log2_bits = filter_bits(2 * ids.count(), 26)
    held = spark.sparkContext.broadcast(key_filter(ids, log2_bits))

    def fetch(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            keys = mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64))
            # A node whose only documents have a null id is fetched with every null id.
            keep = SeenTwice.holds(held.value, keys, log2_bits) | ids.is_null().to_numpy(zero_copy_only=False)
            own = shingle_sets(batch.column("text").filter(pa.array(keep)))
            own = [s for s in own if len(s)]
            arrays = [pa.array([set_id(s) for s in own], pa.binary()), pa.array([s.tobytes() for s in own], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "shingles"])

    # Sets are shuffled once, by name: copies come as often as the filter lets them through, and one stays for the join.
    read = arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"), fetch, "node binary, shingles binary")
    read = read.groupBy("node").agg(F.any_value("shingles").alias("shingles"))
    full = materialise(read.join(wanted.select("num", "node", "leads"), "node").select("num", "leads", "shingles"), "fetched")
    held.destroy()
    return full


def verify(pairs: DataFrame, full: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose exact intersection links them."""

    def decide(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("set_u").to_pylist(), batch.column("set_v").to_pylist()):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * common >= threshold * (len(a) + len(b) - common))
            yield batch.filter(pa.array(linked, pa.bool_())).select(["u", "v"])

    both = pairs.join(full.select(F.col("num").alias("v"), F.col("shingles").alias("set_v")), "v")
    both = both.join(full.where("leads").select(F.col("num").alias("u"), F.col("shingles").alias("set_u")), "u")
    return builders(arrow_map(both.select("u", "v", "set_u", "set_v"), decide, "u bigint, v bigint"))


def ngram_links(docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Membership (doc_id, n, node) of all documents, the nodes, and (num, label) of every linked node.

    ``label`` is the least number of the node's component.
    """
    sets = named_sets(docs)
    nodes = node_table(docs, sets, threshold)
    members = sets.where("segment is null").select("doc_id", "n", "node")
    pairs, rows = first_round(nodes, threshold)
    found = failed = docs.sparkSession.createDataFrame([], "u bigint, v bigint")
    labels = found.select(F.col("u").alias("num"), F.col("v").alias("label"))
    turn = 0
    while True:
        if turn:
            rows = mixed_buckets(rows, labels)
            pairs = joining_pairs(rows, nodes, failed, threshold, every=turn > ROUNDS)
        pairs = materialise(pairs, "pairs")
        if turn and pairs.isEmpty():
            break
        # The pairs of later rounds have passed the suffix filter in their tiles.
        likely = pairs if turn else materialise(suffix_filter(pairs, nodes, threshold), "likely")
        linked = materialise(verify(likely, node_sets(docs, nodes, likely), threshold), "linked")
        if not linked.isEmpty():
            # The labels so far are stars over the components, which say the same as all earlier links.
            found = labels.select(F.col("num").alias("u"), F.col("label").alias("v")).unionByName(linked)
            labels = materialise(builders(components(found).withColumnRenamed("node", "num")), "labels")
        if turn > ROUNDS:
            break
        failed = materialise(builders(failed.unionByName(likely.join(linked, ["u", "v"], "left_anti"))), "failed")
        turn += 1
    return members, nodes, labels


def node_components(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, node, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    members, nodes, labels = ngram_links(docs, threshold)
    nodes = nodes.select("num", "node", "doc_id").join(labels, "num", "left").withColumn("label", F.coalesce("label", "num"))
    least = nodes.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = nodes.join(least, "label").select("node", "component_id")
    return members.join(named, "node", "left").select(
        "doc_id", "node", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def ngram_components(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links reach. A row without words is its own component.
    """
    return node_components(docs, threshold).drop("node")


def with_node(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` plus ``name``, the name of the text's shingle set; null without words."""
    columns = [*docs.columns, name]

    def identify(batches):
        for batch in batches:
            nodes = [set_id(s) if len(s) else None for s in shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary())], columns)

    return arrow_map(docs, identify, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose doc_id names their component: one document of each group stays.

    Only ids meet the texts: the ids that go are joined away. An id that also stands on a row that stays goes
    by id and set. Rows that share the id that stays all stay, and so does a null doc_id.
    """
    found = node_components(docs.select("doc_id", "text"), threshold)
    found = materialise(found.select("doc_id", "node", (F.col("doc_id") != F.col("component_id")).alias("goes")), "members")
    gone = materialise(builders(found.where("goes").select("doc_id", "node").distinct()), "gone")
    ids = gone.select("doc_id").distinct()
    both = materialise(builders(found.where("not goes").select("doc_id").distinct().join(ids, "doc_id", "left_semi")), "both")
    kept = docs.join(ids, "doc_id", "left_anti")
    if both.isEmpty():
        return kept
    name = unused(docs.columns, "_node")
    rest = with_node(docs.join(both, "doc_id", "left_semi").select(*docs.columns), name)
    gone = gone.withColumnRenamed("node", name)
    rest = rest.join(gone, ["doc_id", name], "left_anti").drop(name)
    return kept.unionByName(rest.select(*kept.columns))
