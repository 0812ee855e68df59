"""Best-fit packing of token sequences by synchronous sweeps over range-sorted documents and gaps.

Documents longer than the capacity are cut into full pieces and a rest; nothing else is cut. Lengths
are whole numbers up to the capacity, so sorted documents and sorted gaps are runs of equal values,
at most ``capacity`` of each however many rows there are. A superstep takes one run of equal
lengths, longest first, and matches all its documents at once: each goes to its successor, the
smallest gap that holds it, conflicts are resolved by rank (rank r of the run takes place r of the
gaps' run), the gaps are updated and the next run follows. That is best-fit decreasing, without
a row leaving its task: the sweep yields rules (rank interval -> sequences, offset), and every row
finds its place by its own rank, which one distributed range sort gives.

Null and empty texts are one token (the end mark). Equal rows are separate documents. Results name
the input's doc_id; other columns are not read. The strings of special tokens in a text give their ids, as the
tokenizer has it by default. ``pack`` keeps all columns of its pieces but ``sequence_id`` and ``offset``.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import arrow_map, dense_rank_rows, unused
from corvane.session import materialise

CAPACITY = 4096
END_ID = 1
#: Words of each of the two generations whose ids a task remembers; the older goes when the younger is full.
REMEMBERED = 100_000
LONGEST_REMEMBERED = 64
#: Bytes of text whose words are told apart at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Words of a block that are turned into Python strings at once.
WORDS_AT_ONCE = 4096
#: Rules (48 bytes each) that are broadcast.
BROADCAST_RULES = 200_000

#: Letters that stay one letter each as the normalizer composes and lower-cases, whatever stands beside them:
#: Latin (not the dotted capital I), Greek (not the capital sigma) and Cyrillic.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſΆΈ-ΊΌΎ-ΡΤ-ώЀ-ҁ"
#: Words of these characters and visible ASCII are split here, into what ``PRE_TOKENIZER`` matches; blanks stay apart.
DIRECT = f"^[!-~{LETTERS}]*$"
MATCHES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]| |[^{LETTERS}0-9 ]+")
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZER = [
    {
        "type": "Split",
        "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
        "behavior": "Removed",
        "invert": True,
    },
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: Signs of the byte-level alphabet for the bytes that are no visible Latin-1 character: the next ones from U+0100.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_SIGNS = {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)).difference(_VISIBLE)))}

#: Stands between the ids of two words; no id is as large.
MARK = b"\xff" * 4

_encoders: dict[str, _Words] = {}


def _parts(component) -> list | None:
    """The steps of a tokenizer's normalizer or pre-tokenizer."""
    found = json.loads(component.__getstate__()) if component else {}
    return found.get("normalizers") or found.get("pretokenizers")


class _Words(dict):
    """Little-endian 32-bit ids by key: a match of the pre-tokenizer, or a blank and a word for the whole tokenizer.

    The blank alone stands between words: ``MARK``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.splits = _parts(self.tokenizer.normalizer) == NORMALIZER and _parts(self.tokenizer.pre_tokenizer) == PRE_TOKENIZER
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        own = self.older.get(key)
        if own is None:
            own = self.encode(key)
        if len(key) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[key] = own
        return own

    def encode(self, key: str) -> bytes:
        if key == " ":
            return MARK
        if key[0] == " ":
            ids = self.tokenizer.encode(key[1:], add_special_tokens=False).ids
        else:
            signs = key if key.isascii() else key.encode().decode("latin-1").translate(BYTE_SIGNS)
            ids = [t.id for t in self.model.tokenize(signs)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids_of(self, found: pa.Array) -> tuple[bytes, np.ndarray]:
        """The ids of the words, ``MARK`` after each word, and the words' places in that order.

        Strings of special tokens are looked for before a text is lower-cased: they are left to the tokenizer.
        """
        direct = np.zeros(len(found), bool)
        if self.splits:
            direct |= pc.match_substring_regex(found, DIRECT).to_numpy(zero_copy_only=False)
            direct &= ~pc.match_substring(found, "<|").to_numpy(zero_copy_only=False)
        keys = MATCHES.findall(_joined(found.filter(pa.array(direct))).lower())
        for word in found.filter(pa.array(~direct)).to_pylist():
            keys += (" " + word, " ") if word else (" ",)
        place = np.where(direct, np.cumsum(direct) - 1, direct.sum() + np.cumsum(~direct) - 1)
        return b"".join(map(self.__getitem__, keys)), place

    def forget(self) -> None:
        self.clear()
        self.older = {}


def _joined(words: pa.Array) -> str:
    """The words in one string, a blank after each."""
    if not len(words):
        return ""
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(whole, pa.scalar(" ", words.type))[0].as_py() + " "


def token_ids(texts: pa.Array, path: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the whole texts, each with the end mark, one after the other, and where each text's ids stop.

    Words do not influence each other, and equal words of the texts are looked up once.
    """
    words = _encoders.get(path)
    if words is None:
        words = _encoders[path] = _Words(path)
    flat = pc.fill_null(texts, "")
    for blank in "\n\t\r":
        flat = pc.replace_substring(flat, blank, " ")
    split = pc.split_pattern(flat, " ")
    stops = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)
    found = split.flatten().dictionary_encode()
    ids, places = [], []
    for first in range(0, len(found.dictionary), WORDS_AT_ONCE):
        some, place = words.ids_of(found.dictionary.slice(first, WORDS_AT_ONCE))
        ids.append(some)
        places.append(place + first)
    own = np.frombuffer(b"".join([*ids, end_id.to_bytes(4, "little"), MARK]), "<u4")
    ends = np.flatnonzero(own == own[-1])
    starts = np.concatenate([[0], ends[:-1] + 1])
    # Every text's words and, after them, the end mark: the last of ``own``.
    which = np.insert(np.concatenate(places).astype(np.int32)[found.indices.to_numpy()], stops, len(ends) - 1)
    counts = (ends - starts)[which]
    after = np.cumsum(counts)
    kind = np.int32 if max(after[-1], len(own)) < 1 << 31 else np.int64
    at = np.repeat((starts[which] - (after - counts)).astype(kind), counts)
    at += np.arange(len(at), dtype=kind)
    return own[at], after[stops + np.arange(len(stops))]


def token_bytes(text: str | None, path: str, end_id: int = END_ID) -> bytes:
    """Ids of the whole text and the end mark, 4 bytes each."""
    return token_ids(pa.array([text], pa.string()), path, end_id)[0].tobytes()


def blocks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of about ``size`` bytes of ``text`` at most, one row at least."""
    for batch in batches:
        widths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        number = (np.cumsum(widths) - widths) // size
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
        for first, stop in zip(cuts, cuts[1:]):
            if first < stop:
                yield batch.slice(first, stop - first)


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document; ids are little-endian bytes."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids

    def cut(batches):
        try:
            for batch in blocks(batches, BLOCK_BYTES):
                flat, stops = token_ids(batch.column("text"), tokenizer, end_id)
                rows, first = [], 0
                for doc_id, stop in zip(batch.column("doc_id").to_pylist(), stops.tolist()):
                    for start in range(first, stop, capacity):
                        own = flat[start : min(start + capacity, stop)].tobytes()
                        row = (doc_id, (start - first) // capacity, start - first, len(own) // 4, zlib.crc32(own))
                        rows.append((*row, own) if with_ids else row)
                    first = stop
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        finally:
            # Idle workers stay beside the busy ones: they keep the tokenizer, not the words.
            if tokenizer in _encoders:
                _encoders[tokenizer].forget()

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), cut, schema)


def sweep(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rules (length, first rank, rows, rows per sequence, first sequence, offset), and the sequences used.

    Gaps are kept as runs of sequences with equal gap; one step places as many rows as one run holds.
    """
    gaps: list[int] = []
    runs: dict[int, deque[tuple[int, int]]] = {}
    rules, sequences = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if not gap or not n:
            return
        if gap not in runs:
            bisect.insort(gaps, gap)
            runs[gap] = deque()
        runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                gap, first = capacity, sequences
                n = -(-left // (capacity // length))
                sequences += n
            else:
                gap = gaps[at]
                first, n = runs[gap].popleft()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            per = gap // length
            full = min(n, left // per)
            if full:
                rules.append((length, rank, full * per, per, first, capacity - gap))
                put(gap - per * length, first, full)
                rank += full * per
                left -= full * per
            if full < n:
                some = min(left, per - 1)
                if some:
                    rules.append((length, rank, some, some, first + full, capacity - gap))
                    rank += some
                    left -= some
                    put(gap - some * length, first + full, 1)
                    full += 1
                put(gap, first + full, n - full)
    return rules, sequences


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` plus ``sequence_id`` and ``offset``; ``length`` lies between 1 and ``capacity``."""
    spark = pieces.sparkSession
    # The range sort reads its input twice; texts are tokenized once.
    pieces = materialise(pieces, "pieces")
    rank = unused(pieces.columns, "_rank")
    ranked = dense_rank_rows(pieces, ["length", "doc_id", "piece"], rank)
    # One row per length, at most the capacity.
    runs = ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first")).collect()
    if any(not 1 <= r["length"] <= capacity for r in runs):
        raise ValueError(f"pieces must have 1 to {capacity} tokens")
    first = {r["length"]: r["first"] for r in runs}
    rules, _ = sweep({r["length"]: r["n"] for r in runs}, capacity)
    rows = [(n, first[n] + rank, first[n] + rank + count, per, seq, offset) for n, rank, count, per, seq, offset in rules]
    held = spark.createDataFrame(rows, "length bigint, first bigint, stop bigint, per bigint, seq bigint, offset bigint")
    # Rules follow the lengths, not the rows; a common length is then not dealt to one task.
    held = F.broadcast(held) if len(rows) <= BROADCAST_RULES else held
    own = F.col(f"p.{rank}") - F.col("r.first")
    within = (F.col(f"p.{rank}") >= F.col("r.first")) & (F.col(f"p.{rank}") < F.col("r.stop"))
    place = F.col("r.offset") + own % F.col("r.per") * F.col("p.length")
    return (
        ranked.alias("p")
        .join(held.alias("r"), (F.col("p.length") == F.col("r.length")) & within)
        .select(
            *(F.col(f"p.{c}") for c in pieces.columns if c.lower() not in ("sequence_id", "offset")),
            (F.col("r.seq") + F.floor(own / F.col("r.per"))).cast("bigint").alias("sequence_id"),
            place.cast("bigint").alias("offset"),
        )
    )
