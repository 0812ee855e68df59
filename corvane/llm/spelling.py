"""Spelling variant grouping with k-d trees over letter counts.

Two words are near if they differ by one inserted, deleted or replaced code point. An edit moves one
letter's count up by one, another's down by one, or both, so near words lie at an L1 distance of at most
two as vectors of letter counts.

1. Words are counted in every task before they are shuffled.
2. One k-d tree for each word length, with split planes from at most ``SAMPLE`` words (those of least
   hash), cuts the space into at most about ``MOST_CELLS`` boxes of similar size. Every word has one home
   cell, and visits as a query the cells of its length pair (its own length, the next longer one) whose
   box its distance bound reaches. The planes only steer the sizes of cells, not results.
3. A task takes a cell's words, builds the k-d tree below that cell over their exact counts, and runs
   the visitors in batches: subtrees whose box is too far are pruned; in the leaves reached, bit masks of
   the letters, then their order decide. Visitors are streamed, never held
   as a whole.
4. A word's form is its near word of the largest count, if that is at least twice its own; counts double
   along a chain, so roots are found by doubling pointers in few joins.

A null or empty text has no words. A null doc_id counts as the empty string where ids are hashed.
Repeated rows count as often as they occur. Only ``doc_id`` and ``text`` are read, so other columns of
any name are left out. Texts and words may be of any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import arrow_map, text_buffers
from corvane.session import materialise

LEAST_LENGTH, LEAST_COUNT, FACTOR = 5, 3, 2
#: Bytes of a text read at a time, and distinct words a task holds before it emits their counts.
CHUNK = 1 << 20
HELD_WORDS = 200_000
#: Words that place the split planes; words aimed at in a cell; most cells; words of a leaf in a task's tree.
SAMPLE = 1 << 16
CELL = 4096
MOST_CELLS = 4096
LEAF = 64
#: Numbers in a block of comparisons, and rows that a task reads or routes together.
BLOCK = 1 << 22
ROWS = 1 << 14
#: Letters a to z and U+00C0 to U+00FF.
LETTERS = 26 + 64
_RUN = re.compile("[a-zÀ-ÿ]+")
_BREAK = re.compile(rb"[^A-Za-z\x80-\xff]")


def _pieces(data: bytes) -> Iterator[str]:
    """A text with A-Z lower-cased, in pieces that part no run of letters."""
    low = 0
    while low < len(data):
        found = _BREAK.search(data, low + CHUNK)
        high = found.end() if found else len(data)
        yield data[low:high].lower().decode("utf-8", "replace")
        low = high


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, drop_every: int | None = None) -> DataFrame:
    """(word, n) of all runs of letters of at least ``least_length``, over all rows.

    With ``drop_every`` a run loses one letter where that number divides the CRC-32 of ``doc_id:run``, at
    the place that the CRC-32 gives: known misspellings, to measure by.
    """

    def count(batches):
        held: Counter[str] = Counter()

        def emit():
            arrays = [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["word", "n"])

        for batch in batches:
            data, at = text_buffers(batch.column("text"))
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for piece in _pieces(data[a:b].tobytes()):
                    for run, n in Counter(_RUN.findall(piece)).items():
                        if drop_every:
                            h = zlib.crc32(run.encode(), seed)
                            if not h % drop_every:
                                run = run[: h % len(run)] + run[h % len(run) + 1 :]
                        if len(run) >= least_length:
                            held[run] += n
                if len(held) >= HELD_WORDS:
                    yield emit()
                    held.clear()
        if held:
            yield emit()

    rows = arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"), count, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def codes_of(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-16-le"), np.uint16).reshape(len(words), -1)


def letter_numbers(codes: np.ndarray) -> np.ndarray:
    """Letters as numbers from 0."""
    return np.where(codes < 128, codes.astype(np.int64) - 97, codes.astype(np.int64) - 0xC0 + 26)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """Rows of letter counts."""
    flat = (np.arange(len(codes))[:, None] * LETTERS + letter_numbers(codes)).ravel()
    return np.bincount(flat, minlength=len(codes) * LETTERS).reshape(-1, LETTERS)


class KdTree:
    """Split planes over letter counts; leaf k holds the points ``order[ends[k] : ends[k + 1]]``."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.dim, self.cut, self.child, self.leaf = [], [], [], []
        order, self.ends = [], [0]
        # Depth first, so that every node is numbered before its children.
        stack = [(np.arange(len(points)), None)]
        while stack:
            own, parent = stack.pop()
            node = len(self.dim)
            if parent is not None:
                self.child[parent[0]][parent[1]] = node
            plane = self.plane(points[own]) if len(own) > leaf else None
            self.dim.append(plane[0] if plane else -1)
            self.cut.append(plane[1] if plane else 0)
            self.child.append([-1, -1])
            self.leaf.append(-1 if plane else len(self.ends) - 1)
            if plane:
                low = points[own, plane[0]] <= plane[1]
                stack += [(own[~low], (node, 1)), (own[low], (node, 0))]
            else:
                order.append(own)
                self.ends.append(self.ends[-1] + len(own))
        self.order = np.concatenate(order)

    @staticmethod
    def plane(points: np.ndarray) -> tuple[int, int] | None:
        """The letter and count that halve the points best; None if all are equal."""
        middle = np.partition(points, len(points) // 2, axis=0)[len(points) // 2]
        best = None
        for cut in (middle, middle - 1):
            uneven = np.abs(2 * (points <= cut).sum(axis=0) - len(points))
            d = int(np.argmin(uneven))
            if uneven[d] < len(points) and (best is None or uneven[d] < best[0]):
                best = (int(uneven[d]), d, int(cut[d]))
        return best[1:] if best else None

    def bounds(self, dims: int) -> None:
        """The box of every inner node along its own split letter, as the planes above it give it."""
        low = {0: np.zeros(dims, np.int64)}
        high = {0: np.full(dims, 1 << 40)}
        self.low, self.high = np.zeros(len(self.dim), np.int64), np.zeros(len(self.dim), np.int64)
        for node, (d, cut, (left, right)) in enumerate(zip(self.dim, self.cut, self.child)):
            own_low, own_high = low.pop(node), high.pop(node)
            if d >= 0:
                self.low[node], self.high[node] = own_low[d], own_high[d]
                low[left], high[left], low[right], high[right] = own_low, own_high.copy(), own_low.copy(), own_high
                high[left][d], low[right][d] = min(own_high[d], cut), max(own_low[d], cut + 1)

    def reached(self, queries: np.ndarray, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, queries) of all leaves whose box holds a point that has at most one letter more and ``down`` fewer.

        A plane moves the box along one letter, so only that letter's part of the distances changes.
        """
        if not hasattr(self, "low"):
            self.bounds(queries.shape[1])
        none = np.zeros(len(queries), np.int64)
        stack = [(0, np.arange(len(queries)), none, none)]
        while stack:
            node, own, more, fewer = stack.pop()
            d, cut = self.dim[node], self.cut[node]
            if d < 0:
                yield self.leaf[node], own
                continue
            q = queries[own, d]
            over = fewer + np.maximum(q - cut, 0) - np.maximum(q - self.high[node], 0)
            under = more + np.maximum(cut + 1 - q, 0) - np.maximum(self.low[node] - q, 0)
            left, right = over <= down, under <= 1
            if left.any():
                stack.append((self.child[node][0], own[left], more[left], over[left]))
            if right.any():
                stack.append((self.child[node][1], own[right], under[right], fewer[right]))


class Router:
    """The trees that assign words to cells, by word length; a length without a tree is one cell."""

    def __init__(self, sample: list[str], total: int):
        leaf = max(1, -(-CELL * len(sample) // max(1, total)), -(-len(sample) // MOST_CELLS))
        by_length: dict[int, list[str]] = {}
        for word in sample:
            by_length.setdefault(len(word), []).append(word)
        self.trees = {n: KdTree(letter_counts(codes_of(own)), leaf) for n, own in by_length.items() if len(own) > leaf}
        for tree in self.trees.values():
            tree.order = None

    def cells(self, length: int, counts: np.ndarray, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, rows) of the cells of words of ``length`` that the words with these counts must visit."""
        tree = self.trees.get(length)
        if tree is None:
            yield 0, np.arange(len(counts))
            return
        yield from tree.reached(counts, down)

    def home(self, length: int, counts: np.ndarray) -> np.ndarray:
        """The cell of every word."""
        out = np.zeros(len(counts), np.int32)
        tree = self.trees.get(length)
        if tree is not None:
            node = np.zeros(len(counts), np.int64)
            dim, cut, child, leaf = (np.array(x) for x in (tree.dim, tree.cut, tree.child, tree.leaf))
            while (inner := np.flatnonzero(dim[node] >= 0)).size:
                at = node[inner]
                node[inner] = child[at, (counts[inner, dim[at]] > cut[at]).astype(np.int64)]
            out = leaf[node].astype(np.int32)
        return out


VISITS = "length int, cell int, visitor int, word string, n bigint"


def visits(words: DataFrame) -> DataFrame:
    """Rows of ``VISITS``: every word in its home cell (visitor 0), and as a query of its length (1) or of the next (2)."""
    total = words.count()
    sample = [r["word"] for r in words.orderBy(F.xxhash64("word"), "word").select("word").limit(SAMPLE).collect()]
    held = words.sparkSession.sparkContext.broadcast(Router(sample, total))

    def send(batches):
        router = held.value
        for batch in batches:
            words, n = np.array(batch.column("word").to_pylist(), object), batch.column("n").to_numpy()
            lengths = np.array([len(w) for w in words], np.int64)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                # Long words take many bytes each: a bounded number at a time.
                for at in range(0, len(rows), step := max(1, BLOCK // max(length, LETTERS))):
                    own = rows[at : at + step]
                    counts = letter_counts(codes_of(words[own].tolist()))
                    home = router.home(length, counts)
                    found = [(length, home, 0, own)]
                    for cell, who in router.cells(length, counts, 1):
                        found.append((length, cell, 1, own[who[home[who] != cell]]))
                    for cell, who in router.cells(length + 1, counts, 0):
                        found.append((length + 1, cell, 2, own[who]))
                    for size, cell, visitor, who in found:
                        if len(who):
                            columns = [np.full(len(who), size, np.int32), np.broadcast_to(np.int32(cell), len(who)).astype(np.int32)]
                            arrays = [*map(pa.array, columns), pa.array(np.full(len(who), visitor, np.int32))]
                            arrays += [pa.array(words[who], pa.string()), pa.array(n[who])]
                            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in VISITS.split(", ")])

    # Routing is work of its own: a bounded number of words a task, however few bytes they are.
    return arrow_map(words.repartition(max(1, -(-total // ROWS)), "word"), send, VISITS, ROWS)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of code points differ by one replaced (equal width) or one inserted code point (``b`` wider by one)."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    head = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= a.shape[1]


def letter_masks(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the letters that occur, and of those that occur twice; some rare letters share a bit.

    A letter more sets at most one further bit of each, a letter fewer clears at most one.
    """
    numbers = np.sort(letter_numbers(codes), axis=1)
    bits = np.uint64(1) << np.where(numbers < 26, numbers, 26 + numbers % 38).astype(np.uint64)
    again = np.where(numbers[:, 1:] == numbers[:, :-1], bits[:, 1:], np.uint64(0))
    return np.bitwise_or.reduce(bits, axis=1), np.bitwise_or.reduce(again, axis=1)


def near_masks(q: np.ndarray, t: np.ndarray, down: int) -> np.ndarray:
    return (np.bitwise_count(t & ~q) <= 1) & (np.bitwise_count(q & ~t) <= down)


class Cell:
    """The words of a cell, all of one length, under a k-d tree of their letter counts."""

    def __init__(self, words: list[str], n: list[int]):
        self.words, self.n = np.array(words, object), np.array(n, np.int64)
        self.codes = codes_of(words)
        self.tree = KdTree(letter_counts(self.codes), LEAF)
        # In the order of the leaves.
        order = self.tree.order
        self.words, self.n, self.codes = self.words[order], self.n[order], self.codes[order]
        self.masks = letter_masks(self.codes)

    def near(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of ``words``, row of the cell) of all near pairs; ``words`` have the cell's length or one less."""
        codes = codes_of(words)
        down = int(codes.shape[1] == self.codes.shape[1])
        queries = letter_counts(codes)
        once, twice = letter_masks(codes)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for k, who in self.tree.reached(queries, down):
            low, high = self.tree.ends[k], self.tree.ends[k + 1]
            step = max(1, BLOCK // (high - low))
            for at in range(0, len(who), step):
                some = who[at : at + step]
                i, j = np.nonzero(near_masks(once[some, None], self.masks[0][None, low:high], down))
                if len(i):
                    found.append((some[i], low + j))
        if not found:
            return
        i, j = (np.concatenate(x) for x in zip(*found))
        keep = near_masks(twice[i], self.masks[1][j], down)
        i, j = i[keep], j[keep]
        width = max(1, BLOCK // codes.shape[1])
        for low in range(0, len(i), width):
            a, b = i[low : low + width], j[low : low + width]
            same = one_edit(codes[a], self.codes[b])
            if same.any():
                yield a[same], b[same]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every word with each of its near words; (word, n) are distinct words and counts."""
    rows = visits(words).repartition("length", "cell").sortWithinPartitions("length", "cell", "visitor", "word")

    def search(batches):
        key, cell, members = None, None, []

        def pairs(queries: list[str], n: np.ndarray, both: bool):
            own = np.array(queries, object)
            for i, j in cell.near(queries):
                yield out(own[i], n[i], cell.words[j], cell.n[j])
                if both:
                    yield out(cell.words[j], cell.n[j], own[i], n[i])

        def out(word, n, near, near_n):
            arrays = [pa.array(word, pa.string()), pa.array(n), pa.array(near, pa.string()), pa.array(near_n)]
            return pa.RecordBatch.from_arrays(arrays, ["word", "n", "near", "near_n"])

        def built():
            """The tree of the words gathered so far, and the pairs among them."""
            nonlocal cell, members
            if members:
                cell = Cell([w for w, _ in members], [n for _, n in members])
                members = []
                step = max(1, BLOCK // max(LETTERS, cell.codes.shape[1]))
                for at in range(0, len(cell.words), step):
                    yield from pairs(cell.words[at : at + step].tolist(), cell.n[at : at + step], False)

        for batch in batches:
            lengths, cells, kinds = (batch.column(c).to_numpy() for c in ("length", "cell", "visitor"))
            changed = np.flatnonzero((np.diff(lengths) != 0) | (np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
            for low, high in zip([0, *changed.tolist()], [*changed.tolist(), batch.num_rows]):
                if low == high:
                    continue
                own = (int(lengths[low]), int(cells[low]))
                if own != key:
                    yield from built()
                    key, cell = own, None
                part = batch.slice(low, high - low)
                found, n = part.column("word").to_pylist(), part.column("n").to_numpy()
                if kinds[low] == 0:
                    members += zip(found, n.tolist())
                    continue
                yield from built()
                if cell is not None:
                    step = max(1, BLOCK // max(LETTERS, own[0]))
                    for at in range(0, len(found), step):
                        yield from pairs(found[at : at + step], n[at : at + step], bool(kinds[low] == 2))
        yield from built()

    return arrow_map(rows, search, "word string, n bigint, near string, near_n bigint", ROWS)


def forms(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, n_near, form, form_n) of every word that has near words."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    rows = near_words(words).groupBy("word").agg(F.any_value("n").alias("n"), F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    big = -F.col("best.less") >= factor * F.col("n")
    return rows.select("word", "n_near", F.when(big, F.col("best.form")).alias("form"), F.when(big, -F.col("best.less")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): ``links`` (word, root) followed to the end, twice as far with every join."""
    held = materialise(links, "roots")
    while True:
        onward = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = materialise(held.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        if further.where("next is not null").isEmpty():
            return further.select("word", "root")
        held = further.select("word", "root")


def spelling_variants(
    docs: DataFrame,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    factor: int = FACTOR,
    drop_every: int | None = None,
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``docs`` (doc_id, text) that is long and frequent enough.

    ``root`` is the last of the chain of forms, the word itself where there is none.
    """
    words = materialise(word_counts(docs, least_length, drop_every).where(F.col("n") >= least_count), "words")
    found = materialise(forms(words, factor), "forms")
    ends = roots(found.where("form is not null").select("word", F.col("form").alias("root")))
    rows = words.join(found, "word", "left").join(ends, "word", "left")
    n_near = F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near")
    return rows.select("word", "n", n_near, "form", "form_n", F.coalesce("root", "word").alias("root"))
