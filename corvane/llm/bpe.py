"""Byte-level BPE by prefix dynamic programming.

Every prefix of a piece has exactly one token that ends its encoding: the token whose start is a
prefix that ends in a compatible token. The table of these last tokens is filled from left to right,
in time linear in the piece, and read backwards for the encoding. As an entry depends on earlier
ones only, appended bytes extend the table exactly, and after an edit the table is refilled from the
edit until it runs in step with the old one again.

Two tokens are compatible if their joint bytes encode to just these two. That is so if no merge across
their border comes before the merges that made both: their merges are undone from the last on, and at
every step the two tokens at the border must not form one of lower rank. Verdicts are remembered.
Null and empty texts have no tokens. Ids decode by joining the tokens' bytes.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corvane.llm.common import arrow_map, utf8

#: Pieces, pairs and endings that a worker remembers of each kind; last bytes that tell which tokens may end a prefix.
REMEMBERED = 400_000
LONGEST_REMEMBERED = 64
TAIL = 4
#: Bytes of a piece's beginning.
HEAD = 6


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class _Tails(dict):
    """What may end a prefix with these last bytes: (length, token), longest first; of tokens over ``TAIL`` bytes the length only."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.longer: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > TAIL:
                self.longer.setdefault(token[-TAIL:], set()).add(len(token))

    def __missing__(self, last: bytes) -> tuple[tuple[int, int], ...]:
        own = [(n, -1) for n in sorted(self.longer.get(last, ()), reverse=True)]
        own += [(n, self.ranks[last[-n:]]) for n in range(len(last), 0, -1) if last[-n:] in self.ranks]
        if len(self) >= REMEMBERED:
            self.clear()
        self[last] = tuple(own)
        return self[last]


class PrefixEncoder:
    """Encodes byte strings with the ranks of a byte-level vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.tails = _Tails(ranks)
        self.heads: dict[bytes, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.made_of: dict[int, tuple[int, int] | None] = {}
        # All tokens' bytes in one row, for decoding by one gather.
        sizes = np.zeros(max(self.token) + 2, np.int64)
        sizes[np.array(list(self.token)) + 1] = [len(t) for t in self.token.values()]
        self.starts = np.cumsum(sizes)
        self.joined = np.frombuffer(b"".join(self.token[i] for i in sorted(self.token)), np.uint8)

    def merged(self, data: bytes, below: int = 1 << 62) -> list[bytes]:
        """Plain BPE of a few bytes by merges of rank under ``below``: the lowest rank first, leftmost on ties."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, 1 << 62) for a, b in zip(parts, parts[1:])]
            least = min(ranks)
            if least >= below:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made a token; None for a byte and for a token that no merges make."""
        found = self.made_of.get(token, 0)
        if found == 0:
            data = self.token[token]
            parts = self.merged(data, token) if len(data) > 1 else []
            found = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
            self.made_of[token] = found
        return found

    def reachable(self, token: int) -> bool:
        """Whether a token encodes to itself."""
        return len(self.token[token]) == 1 or self.halves(token) is not None

    def compatible(self, left: int, right: int) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            found = self.pairs[left, right] = self.reachable(left) and self.reachable(right) and self._apart(left, right)
        return found

    def _apart(self, left: int, right: int) -> bool:
        # Going back in time: the border tokens may merge only later than the merge undone last. A merge of
        # equal rank to the left comes first, to the right it comes after the border's.
        before = len(self.token) << 1
        while True:
            joint = self.ranks.get(self.token[left] + self.token[right])
            if joint is not None and joint << 1 | 1 < before:
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                before, left = left << 1 | 1, a[1]
            else:
                before, right = (right << 1) + 2, b[0]

    def _last(self, data: bytes, table: list[int], end: int) -> int:
        # A token that is compatible with one before it also encodes to itself.
        for length, token in self.tails[data[max(0, end - TAIL) : end]]:
            if length > TAIL:
                token = self.ranks.get(data[end - length : end]) if length <= end else None
                if token is None:
                    continue
            if length == end:
                if self.reachable(token):
                    return token
                continue
            left = table[end - length - 1]
            found = self.pairs.get((left, token))
            if found or found is None and self.compatible(left, token):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def table(self, data: bytes, known: list[int] | None = None) -> list[int]:
        """Last token of every prefix (entry i is for i + 1 bytes); ``known`` entries are taken over."""
        table = list(known or ())
        last = self._last
        for end in range(len(table) + 1, len(data) + 1):
            table.append(last(data, table, end))
        return table

    def append(self, data: bytes, table: list[int], more: bytes) -> list[int]:
        """The table of ``data + more``."""
        return self.table(data + more, table)

    def edit(self, data: bytes, table: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """Bytes and table after ``data[start:end]`` became ``new``.

        An entry looks back over the longest token at most: once so many entries in a row equal the
        old ones, all later ones do.
        """
        after = data[:start] + new + data[end:]
        out, shift, same = table[:start], len(new) - (end - start), 0
        for stop in range(start + 1, len(after) + 1):
            out.append(self._last(after, out, stop))
            old = stop - 1 - shift
            same = same + 1 if stop > start + len(new) and old >= end and table[old] == out[-1] else 0
            if same > self.longest:
                return after, out + table[old + 1 :]
        return after, out

    def read(self, table: list[int]) -> list[int]:
        """The encoding, from the last prefix backwards."""
        ids, at = [], len(table)
        while at:
            ids.append(table[at - 1])
            at -= len(self.token[ids[-1]])
        return ids[::-1]

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) <= HEAD:
            return self.read(self.table(data))
        # Words begin alike: the table of a beginning is remembered, and the rest appended.
        head = data[:HEAD]
        known = self.heads.get(head)
        if known is None:
            if len(self.heads) >= REMEMBERED:
                self.heads.clear()
            known = self.heads[head] = self.table(head)
        return self.read(self.table(data, known))

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        ids = np.asarray(ids, np.int64)
        first = self.starts[ids]
        sizes = self.starts[ids + 1] - first
        ends = np.cumsum(sizes)
        return self.joined[np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ids) else 0)].tobytes()


class _Pieces(dict):
    """Little-endian 32-bit ids of pieces, remembered while they are short.

    When it is full, what it holds becomes the older half: pieces that occur again come back from there.
    """

    def __init__(self, encoder: PrefixEncoder):
        super().__init__()
        self.encoder, self.older = encoder, {}

    def __missing__(self, piece: str) -> bytes:
        own = self.older.get(piece)
        if own is None:
            own = np.array(self.encoder.encode(utf8(piece)), "<u4").tobytes()
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = own
        return own


_loaded: dict[tuple[str, str], tuple] = {}


def text_encoder(path: str, pattern: str):
    """(encode, decode): a text to its ids as bytes, and back; loaded once per worker."""
    if (path, pattern) not in _loaded:
        import regex

        encoder = PrefixEncoder(load_ranks(path))
        _loaded[path, pattern] = (regex.compile(pattern).findall, _Pieces(encoder), encoder)
    split, pieces, encoder = _loaded[path, pattern]

    def encode(text: str | None) -> bytes:
        return b"".join(map(pieces.__getitem__, split(text or "")))

    def decode(ids: bytes) -> bytes:
        return encoder.decode(np.frombuffer(ids, "<u4"))

    return encode, decode


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: str = "ids") -> DataFrame:
    """``docs`` without ``text``, plus ``ids`` (array of int) or, with ``keep='digest'``, digests.

    Digests are n_tokens, ids_sha256 (ids as little-endian 32-bit) and decoded_sha256 of the bytes that
    the ids decode to. A map over batches; a worker loads the vocabulary once.
    """
    own = [f for f in docs.schema.fields if f.name not in ("text", "ids", "n_tokens", "ids_sha256", "decoded_sha256")]
    names = [f.name for f in own]

    def run(batches):
        encode, decode = text_encoder(path, pattern)
        for batch in batches:
            ids = [encode(t) for t in batch.column("text").to_pylist()]
            arrays = [batch.column(c) for c in names]
            if keep == "ids":
                values = [np.frombuffer(i, "<u4").astype(np.int32) for i in ids]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(values, pa.list_(pa.int32()))], [*names, "ids"])
                continue
            arrays.append(pa.array([len(i) // 4 for i in ids], pa.int64()))
            arrays.append(pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()))
            arrays.append(pa.array([hashlib.sha256(decode(i)).hexdigest() for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, [*names, "n_tokens", "ids_sha256", "decoded_sha256"])

    if keep == "ids":
        extra = [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    else:
        extra = [T.StructField("n_tokens", T.LongType())]
        extra += [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")]
    return arrow_map(docs.select(*names, "text"), run, T.StructType([*own, *extra]))
