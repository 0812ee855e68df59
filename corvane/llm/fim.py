"""Fill-in-middle transformation, cut by a learned rank index.

A text is cut into units (code points, words or lines). The byte offsets of all unit boundaries are
learned as line segments: each segment predicts the offset of a rank within ``EPSILON`` bytes, and the
difference is stored as one signed byte per boundary (none where a segment predicts all of its
boundaries). A cut is predicted from its rank and corrected by the stored residual, so it is exact, and
a stored index answers new cuts of the same text without reading it again.

Two numbers drawn from the document's id place the cuts, a third decides whether the document is
transformed, a fourth the order of the parts: prefix-suffix-middle or suffix-prefix-middle.

Null and empty texts have no units and stay as they are (form ``plain``, output empty), and so do texts
that hold one of the three marks. A null doc_id draws as the empty string. Equal rows give equal rows.
Only ``doc_id`` and ``text`` are read: other columns, whatever their names, are left out. Texts of any
length are indexed a megabyte at a time.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import arrow_map, text_buffers

#: Bytes that a prediction may be off (a residual is one signed byte), and bytes indexed at a time.
EPSILON = 127
CHUNK = 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT, SPM_PERCENT = 10, 20
UNITS = ("char", "word", "line")
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def fit_segments(offsets: np.ndarray, epsilon: int = EPSILON) -> list[tuple[int, int, float, np.ndarray]]:
    """(first rank, first offset, slope, residuals) of lines that are off by at most ``epsilon``.

    A segment starts as long as twice the last one and is halved until its line, drawn through both
    ends, keeps within the bound; two boundaries always do. Residuals are empty where all are zero.
    """
    found, low, size = [], 0, len(offsets)
    while low < len(offsets):
        size = min(size, len(offsets) - low)
        while True:
            own = offsets[low : low + size]
            slope = (own[-1] - own[0]) / (size - 1) if size > 1 else 0.0
            off = own - predicted(own[0], slope, np.arange(size))
            if np.abs(off).max() <= epsilon:
                break
            size = (size + 1) // 2
        found.append((low, int(own[0]), float(slope), off.astype(np.int8) if off.any() else np.zeros(0, np.int8)))
        low, size = low + size, 2 * size
    return found


def predicted(base, slope, steps: np.ndarray) -> np.ndarray:
    return base + np.floor(slope * steps + 0.5).astype(np.int64)


@dataclass
class RankIndex:
    """Byte offsets of ``n`` + 1 boundaries (rank ``n`` is the end)."""

    n: int
    starts: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    at: np.ndarray
    residuals: np.ndarray

    def offset(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offset of every rank: predicted, then corrected by its residual."""
        ranks = np.asarray(ranks, np.int64)
        s = np.searchsorted(self.starts, ranks, "right") - 1
        steps = ranks - self.starts[s]
        out = predicted(self.base[s], self.slope[s], steps)
        off = self.at[s] >= 0
        out[off] += self.residuals[(self.at[s] + steps)[off]]
        return out

    def tobytes(self) -> bytes:
        heads = struct.pack("<3q", self.n, len(self.starts), len(self.residuals))
        arrays = (self.starts, self.base, self.slope, self.at, self.residuals)
        return heads + b"".join(a.tobytes() for a in arrays)

    @staticmethod
    def frombytes(data: bytes) -> RankIndex:
        n, segments, _ = struct.unpack_from("<3q", data)
        arrays = [np.frombuffer(data, kind, segments, 24 + 8 * segments * i) for i, kind in enumerate("<i8 <i8 <f8 <i8".split())]
        return RankIndex(n, *arrays, np.frombuffer(data, np.int8, offset=24 + 32 * segments))


def _starts(data: np.ndarray, low: int, high: int, unit: str) -> np.ndarray:
    """Whether a unit starts at each byte of a chunk, as far as its own and the byte before tell."""
    b = data[low:high]
    before = data[low - 1 : high - 1] if low else np.concatenate([[10], b[:-1]])
    if unit == "char":
        return (b & 0xC0) != 0x80
    if unit == "word":
        return ~_SPACE[b] & _SPACE[before]
    return before == 10


def build_index(data: np.ndarray, offsets: np.ndarray, unit: str = "char", epsilon: int = EPSILON) -> tuple[RankIndex, np.ndarray]:
    """The index of texts that lie one after another, and the rank of each text's first boundary (one more than texts).

    A unit starts where the text does; blanks after a word belong to it, a line ends after its line feed.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    ranks, parts, held, n = np.zeros(len(offsets), np.int64), [], 0, 0
    for low in range(0, len(data), CHUNK):
        high = min(low + CHUNK, len(data))
        starts = _starts(data, low, high, unit)
        inside = np.flatnonzero((offsets >= low) & (offsets < high))
        starts[offsets[inside] - low] = True
        places = np.flatnonzero(starts)
        ranks[inside] = n + np.searchsorted(places, offsets[inside] - low)
        for first, base, slope, off in fit_segments(places + low, epsilon):
            parts.append((n + first, base, slope, held if len(off) else -1, off))
            held += len(off)
        n += len(places)
    parts.append((n, len(data), 0.0, -1, np.zeros(0, np.int8)))
    ranks[offsets == len(data)] = n
    starts, base, slope, at, off = zip(*parts)
    index = RankIndex(n, np.array(starts), np.array(base), np.array(slope), np.array(at), np.concatenate(off))
    return index, ranks


def rank_indexes(docs: DataFrame, unit: str = "char", epsilon: int = EPSILON) -> DataFrame:
    """(doc_id, n, rank_index) of every text, to be stored: ``RankIndex.frombytes`` reads it again."""

    def build(batches):
        for batch in batches:
            data, at = text_buffers(batch.column("text"))
            built = [build_index(data[a:b], np.zeros(min(1, b - a), np.int64), unit, epsilon)[0] for a, b in zip(at[:-1], at[1:])]
            arrays = [batch.column("doc_id"), pa.array([x.n for x in built], pa.int64()), pa.array([x.tobytes() for x in built], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "rank_index"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return arrow_map(rows, build, "doc_id bigint, n bigint, rank_index binary")


def draws(doc_id: int | None, salt: str) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).digest()
    return struct.unpack(">4I", digest[:16])


ROWS = "doc_id bigint, n bigint, form string, prefix_units bigint, middle_units bigint, output string"


def fill_in_middle(
    docs: DataFrame,
    unit: str = "char",
    salt: str = "1:",
    plain_percent: int = PLAIN_PERCENT,
    spm_percent: int = SPM_PERCENT,
    epsilon: int = EPSILON,
) -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, output) of every row of ``docs`` (doc_id, text).

    The prefix ends after the smaller of two drawn numbers of units, the middle after the larger.
    ``salt`` gives another draw, for example one for each epoch.
    """
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def cut(batches):
        p, s, m = marks
        for batch in batches:
            data, at = text_buffers(batch.column("text"))
            index, ranks = build_index(data, at[:-1], unit, epsilon)
            ids, n = batch.column("doc_id").to_pylist(), np.diff(np.append(ranks, index.n))
            drawn = np.array([draws(i, salt) for i in ids], np.int64).reshape(-1, 4)
            ends = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1)
            # Texts with a mark in them stay whole; every other cut is one lookup.
            places = index.offset((ends + ranks[:, None]).ravel()).reshape(-1, 2)
            forms, outputs = [], []
            rest = zip(at[:-1].tolist(), places.tolist(), at[1:].tolist(), drawn[:, 2:].tolist())
            for start, (first, second), end, (h3, h4) in rest:
                own = data[start:end].tobytes()
                if not own or h3 % 100 >= 100 - plain_percent or any(x in own for x in marks):
                    forms.append("plain")
                    outputs.append(own)
                    continue
                prefix, middle, suffix = own[: first - start], own[first - start : second - start], own[second - start :]
                spm = h4 % 100 < spm_percent
                forms.append("spm" if spm else "psm")
                outputs.append(b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle)))
            plain = np.array([f == "plain" for f in forms], bool)
            lengths = [ends[:, 0], ends[:, 1] - ends[:, 0]]
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(forms, pa.string())]
            arrays += [pa.array(x, pa.int64(), mask=plain) for x in lengths]
            arrays.append(pa.array(outputs, pa.binary()).view(pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in ROWS.split(", ")])

    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return arrow_map(rows, cut, ROWS)


def restored(output: Column, form: Column) -> Column:
    """The text that an output stands for. Marks cannot occur in the parts, so the first of each kind parts them."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(first) + 1))
        head = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.char_length(head) + len(second) + 1)
        mid = F.substring_index(rest, MIDDLE, 1)
        return head, mid, F.substr(rest, F.char_length(mid) + len(MIDDLE) + 1)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix_s, prefix_s, middle_s = parts(SUFFIX, PREFIX)
    whole = F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_s, middle_s, suffix_s))
    return whole.otherwise(output)
