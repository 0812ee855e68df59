"""Nearest neighbours by inner product: one navigable small-world graph per shard, shard results merged.

Vectors are dealt to shards by their length, in bands of a factor of two, and by a hash of their id.
Within a shard equal vectors are one node, and nodes lie on the unit sphere (they are scaled by the
longest one's length, and one coordinate is added so that all have it), which makes the largest inner
product the nearest node. As a shard's lengths are alike, no long vector swallows the differences
between the others. Layers are prefixes of one node order; every layer
is a flat array of neighbour numbers (-1: none). Nodes are inserted in batches that double the
layer, searched together, and linked by the diversity rule. Searches run many queries in step.

The index is a table of one row per shard. Queries are sent to every shard as rows that follow the
shard's row, so a task holds one graph and one batch of queries. Scores are recomputed in double
precision on the original vectors.

Vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of
different lengths never meet. Ties go to the smaller vec_id; rows of the query's own id are no
candidates. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import U64, mix
from corvane.session import materialise

SHARD_ROWS = 8192
#: Links a node seeks, the most it keeps, and the beam widths while building and searching.
LINKS, MOST_LINKS = 16, 32
BUILD_BEAM, SEARCH_BEAM = 64, 96
SHRINK = 16
EXPAND = 4
BATCH = 512


def on_sphere(vectors: np.ndarray) -> np.ndarray:
    """Vectors over the longest one's length, with one more coordinate that gives all the length 1."""
    wide = vectors.astype(np.float64)
    squares = (wide**2).sum(axis=1)
    most = squares.max()
    rest = np.sqrt(np.maximum(1.0 - squares / most, 0.0))
    return np.hstack([wide / np.sqrt(most), rest[:, None]]).astype(np.float32)


def beam_search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of the ``width`` nearest found from ``entry`` (rows x entries), best first."""
    rows = np.arange(len(queries))[:, None]
    seen = np.zeros((len(queries), len(links) + 1), bool)
    seen[:, -1] = True
    seen[rows, entry] = True
    nodes = np.full((len(queries), width), -1, np.int32)
    sims = np.full((len(queries), width), -np.inf, np.float32)
    first = np.einsum("bed,bd->be", x[entry], queries)
    # Repeated entries count once.
    order = np.argsort(entry, axis=1, kind="stable")
    ranked = np.take_along_axis(entry, order, 1)
    again = np.zeros(entry.shape, bool)
    np.put_along_axis(again, order, np.hstack([np.zeros((len(entry), 1), bool), ranked[:, 1:] == ranked[:, :-1]]), 1)
    first[again] = -np.inf
    n = min(width, entry.shape[1])
    best = np.argsort(-first, axis=1)[:, :n]
    nodes[:, :n], sims[:, :n] = np.take_along_axis(entry, best, 1), np.take_along_axis(first, best, 1)
    nodes[sims == -np.inf] = -1
    done = nodes < 0
    active = np.arange(len(queries))
    while len(active):
        own = np.where(done[active], -np.inf, sims[active])
        pick = np.argsort(-own, axis=1, kind="stable")[:, :EXPAND]
        good = np.take_along_axis(own, pick, 1) > -np.inf
        keep = good.any(axis=1)
        active, pick, good = active[keep], pick[keep], good[keep]
        if not len(active):
            break
        a = active[:, None]
        at = np.where(good, nodes[a, pick], -1)
        done[a, pick] = True
        near = np.where(at[:, :, None] >= 0, links[at], -1).reshape(len(active), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[a, near]] = -1
        seen[a, near] = True
        value = np.einsum("bed,bd->be", x[near], queries[active])
        value[near < 0] = -np.inf
        all_nodes = np.hstack([nodes[active], near.astype(np.int32)])
        all_sims = np.hstack([sims[active], value])
        all_done = np.hstack([done[active], near < 0])
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        nodes[active], sims[active] = np.take_along_axis(all_nodes, top, 1), np.take_along_axis(all_sims, top, 1)
        done[active] = np.take_along_axis(all_done, top, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)


def diverse(x: np.ndarray, nodes: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` links of each row's candidates (best first): those nearer to the row than to a
    kept link come first, the others fill up."""
    valid = nodes >= 0
    own = x[nodes]
    between = own @ own.transpose(0, 2, 1)
    kept = np.zeros(nodes.shape, bool)
    for c in range(nodes.shape[1]):
        closer = (between[:, c, :] >= sims[:, c, None]) & kept
        kept[:, c] = valid[:, c] & ~closer.any(axis=1)
    order = np.argsort(np.where(kept, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
    return np.where(np.take_along_axis(valid, order, 1), np.take_along_axis(nodes, order, 1), -1).astype(np.int32)


def add_links(x: np.ndarray, links: np.ndarray, to: np.ndarray, of: np.ndarray) -> None:
    """Put the links ``of[i] -> to[i]`` in; nodes with too many keep the diverse ones."""
    order = np.lexsort((to, of))
    of, to = of[order], to[order]
    nodes, first, counts = np.unique(of, return_index=True, return_counts=True)
    widest = int(counts.max()) if len(counts) else 0
    for lo in range(0, len(nodes), BATCH):
        some, at, n = nodes[lo : lo + BATCH], first[lo : lo + BATCH], counts[lo : lo + BATCH]
        fresh = np.full((len(some), widest), -1, np.int32)
        inner = np.arange(widest)[None, :] < n[:, None]
        fresh[inner] = to[np.concatenate([np.arange(a, a + c) for a, c in zip(at, n)])]
        cand = np.hstack([links[some], fresh])
        cand.sort(axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        sims = np.einsum("bed,bd->be", x[cand], x[some])
        sims[cand < 0] = -np.inf
        best = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * MOST_LINKS]
        cand, sims = np.take_along_axis(cand, best, 1), np.take_along_axis(sims, best, 1)
        few = (cand >= 0).sum(axis=1) <= MOST_LINKS
        out = np.full((len(some), MOST_LINKS), -1, np.int32)
        w = min(MOST_LINKS, cand.shape[1])
        out[few, :w] = cand[few, :w]
        if (~few).any():
            chosen = diverse(x, cand[~few], sims[~few], MOST_LINKS)
            out[~few, : chosen.shape[1]] = chosen
        links[some] = out


def layer_sizes(n: int) -> list[int]:
    """Nodes of every layer, bottom first: a sixteenth of the layer below."""
    sizes = [n]
    while sizes[-1] > 4 * MOST_LINKS:
        sizes.append(-(-sizes[-1] // SHRINK))
    return sizes


def descend(x: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, stop: int) -> np.ndarray:
    """Entry nodes for layer ``stop``, from the top layer down."""
    top = len(layers[-1])
    entry = np.argsort(-(queries @ x[:top].T), axis=1)[:, :EXPAND] if top else np.zeros((len(queries), 1), int)
    for links in reversed(layers[stop + 1 : -1]):
        nodes, _ = beam_search(x[: len(links)], links, queries, entry, EXPAND)
        entry = np.where(nodes >= 0, nodes, nodes[:, :1])
    return entry


def build_graph(x: np.ndarray) -> list[np.ndarray]:
    """Flat neighbour arrays of every layer, bottom first; layer l holds the first nodes of ``x``."""
    sizes = layer_sizes(len(x))
    layers: list[np.ndarray] = [np.zeros((0, MOST_LINKS), np.int32)] * len(sizes)
    for level in reversed(range(len(sizes))):
        n = sizes[level]
        links = np.full((n, MOST_LINKS), -1, np.int32)
        done = min(n, 2 * MOST_LINKS)
        sims = x[:done] @ x[:done].T
        np.fill_diagonal(sims, -np.inf)
        near = np.argsort(-sims, axis=1, kind="stable")[:, : max(0, done - 1)].astype(np.int32)
        if near.shape[1]:
            chosen = diverse(x, near, np.take_along_axis(sims, near, 1), MOST_LINKS)
            links[:done, : chosen.shape[1]] = chosen
        layers[level] = links
        while done < n:
            stop = min(n, 2 * done, done + BATCH)
            q = x[done:stop]
            if level + 1 < len(sizes):
                entry = descend(x, layers, q, level)
                entry = np.where(entry < done, entry, 0)
            else:
                entry = np.zeros((len(q), 1), int)
            nodes, sims = beam_search(x[:done], links[:done], q, entry, min(BUILD_BEAM, done))
            # Nodes of one batch see each other too.
            mates = q @ q.T
            np.fill_diagonal(mates, -np.inf)
            close = np.argsort(-mates, axis=1, kind="stable")[:, : min(LINKS, len(q) - 1)]
            nodes = np.hstack([nodes, (close + done).astype(np.int32)])
            sims = np.hstack([sims, np.take_along_axis(mates, close, 1)])
            order = np.argsort(-sims, axis=1, kind="stable")
            nodes, sims = np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)
            chosen = diverse(x, nodes, sims, LINKS)
            links[done:stop, : chosen.shape[1]] = chosen
            of = np.repeat(np.arange(done, stop), chosen.shape[1])
            to = chosen.ravel()
            real = to >= 0
            add_links(x, links, of[real].astype(np.int32), to[real])
            done = stop
    return layers


INDEX = "shard int, dim int, vectors binary, ids binary, starts binary, layers array<binary>"


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v, dim) of the vectors that take part."""
    v = F.col(vector).cast("array<float>")
    whole = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).where(
        F.col(id_col).isNotNull() & whole & F.exists("v", lambda x: x != 0)
    ).withColumn("dim", F.size("v"))


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: about ``shard_rows`` vectors of one width and band of lengths."""
    squares = F.aggregate("v", F.lit(0.0), lambda sum_, x: sum_ + x.cast("double") * x.cast("double"))
    vectors = vectors.withColumn("band", F.floor(F.log2(squares) / 2).cast("int"))
    # One row per vector width and power of two: a few hundred for each width.
    counts = sorted(tuple(r) for r in vectors.groupBy("dim", "band").agg(F.count(F.lit(1)).alias("n")).collect())
    bands, shards = [], 0
    for dim, band, n in counts:
        bands.append((dim, band, shards, -(-n // shard_rows)))
        shards += bands[-1][3]
    held = vectors.sparkSession.createDataFrame(bands, "dim int, band int, first int, parts int")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        raw = np.stack([np.asarray(v, np.float32) for v in pdf["v"]]) + np.float32(0)
        _, first, node = np.unique(raw, axis=0, return_index=True, return_inverse=True)
        # A shuffled order, so that layers are random samples.
        order = np.argsort(mix(pdf["vec_id"].to_numpy()[first].astype(np.int64).view(U64)), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        node = place[node.ravel()]
        own = raw[first[order]]
        by_node = np.argsort(node, kind="stable")
        starts = np.searchsorted(node[by_node], np.arange(len(own) + 1))
        layers = build_graph(on_sphere(own))
        return pd.DataFrame(
            {
                "shard": [pdf["shard"].iloc[0]], "dim": [own.shape[1]], "vectors": [own.tobytes()],
                "ids": [pdf["vec_id"].to_numpy()[by_node].astype(np.int64).tobytes()],
                "starts": [starts.astype(np.int64).tobytes()], "layers": [[x.tobytes() for x in layers]],
            }
        )

    own = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("shard")
    dealt = vectors.join(F.broadcast(held), ["dim", "band"]).select("vec_id", "v", "dim", own)
    return dealt.groupBy("shard", "dim").applyInPandas(build, INDEX)


class Shard:
    """A loaded index row."""

    def __init__(self, row: dict):
        self.vectors = np.frombuffer(row["vectors"], np.float32).reshape(-1, row["dim"])
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.starts = np.frombuffer(row["starts"], np.int64)
        self.layers = [np.frombuffer(x, np.int32).reshape(-1, MOST_LINKS) for x in row["layers"]]
        self.x = on_sphere(self.vectors)

    def nearest(self, queries: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, exact scores), best first; -1 where there are fewer."""
        wide = queries.astype(np.float64)
        unit = wide / np.maximum(np.sqrt((wide**2).sum(axis=1, keepdims=True)), 1e-300)
        flat = np.hstack([unit, np.zeros((len(unit), 1))]).astype(np.float32)
        entry = descend(self.x, self.layers, flat, 0) if len(self.layers) > 1 else np.zeros((len(flat), 1), int)
        nodes, _ = beam_search(self.x, self.layers[0], flat, entry, max(width, k))
        scores = (self.vectors[nodes].astype(np.float64) * queries[:, None, :].astype(np.float64)).sum(axis=2)
        scores[nodes < 0] = -np.inf
        return nodes, scores

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, width: int):
        """(query, vec_id, score) rows: the best ``k`` of this shard by score, then vec_id."""
        nodes, scores = self.nearest(queries, k + 1, width)
        for own, found, score in zip(query_ids, nodes, scores):
            taken = []
            order = np.lexsort((self.ids[self.starts[np.maximum(found, 0)]], -score))
            for at in order:
                node = found[at]
                # Ties reach past the k-th row only with larger ids of the same node.
                if node < 0 or (len(taken) >= k and score[at] < taken[k - 1][0]):
                    break
                ids = self.ids[self.starts[node] : self.starts[node + 1]]
                taken += [(score[at], i) for i in ids[ids != own][:k]]
                taken.sort(key=lambda t: (-t[0], t[1]))
            yield from ((own, i, s) for s, i in taken[:k])


def search_index(index: DataFrame, queries: DataFrame, k: int = 20, width: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score) of ``queries`` (vec_id, v, dim) over a stored ``index``."""
    kind = "shard int, dim int, query_id bigint, vectors binary, ids binary, starts binary, layers array<binary>"
    shards = [tuple(r) for r in index.select("shard", "dim").collect()]
    if not shards:
        return queries.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    held = index.sparkSession.createDataFrame(shards, "shard int, dim int")
    sent = queries.join(F.broadcast(held), "dim").select("shard", "dim", F.col("vec_id").alias("query_id"), "v")
    none = F.lit(None)
    rows = index.select("shard", "dim", none.cast("bigint").alias("query_id"), none.cast("array<float>").alias("v"), "vectors", "ids", "starts", "layers")
    sent = sent.select("*", *(none.cast("binary").alias(c) for c in ("vectors", "ids", "starts")), none.cast("array<binary>").alias("layers"))
    both = rows.unionByName(sent).repartition(max(len(shards), 1), "shard", "dim")
    # The shard's row has no query and comes first.
    both = both.sortWithinPartitions("shard", "dim", F.col("query_id").asc_nulls_first())

    def run(batches):
        shard, at = None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH).to_pylist()
                pending: list[dict] = []
                out: list = []
                for row in [*part, None]:
                    if row is None or row["query_id"] is None or (row["shard"], row["dim"]) != at:
                        if pending:
                            ids = np.array([r["query_id"] for r in pending])
                            out += shard.search(ids, np.array([r["v"] for r in pending], np.float32), k, width)
                            pending = []
                        if row is not None and row["query_id"] is None:
                            shard, at = Shard(row), (row["shard"], row["dim"])
                            continue
                    if row is not None and (row["shard"], row["dim"]) == at:
                        pending.append(row)
                if out:
                    q, i, s = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    both = both.select("shard", "dim", "query_id", "v", "vectors", "ids", "starts", "layers")
    found = both.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(df: DataFrame, every: int = 20, k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``k`` nearest rows of every row whose id is divisible by ``every``."""
    vectors = valid_vectors(df)
    index = materialise(build_index(vectors, shard_rows), "hnsw")
    return search_index(index, vectors.where(F.col("vec_id") % every == 0), k)
