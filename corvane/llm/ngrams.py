"""Hashed word shingles of whole texts, in numpy over Arrow buffers.

A word is a run of bytes other than 0x20 and 0x09-0x0D with A-Z lower-cased. Words and shingles are
64-bit hashes; a document's set is sorted and distinct.
"""

from __future__ import annotations

import hashlib

import numpy as np

from corvane.llm.common import U64, mix, text_buffers

WORDS_PER_SHINGLE = 5
#: Bytes hashed at a time; a longer text is cut at white space, so memory follows this number.
CHUNK = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240229))
_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_CODES[65:91] = _CODES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = U64(0xD6E8FEB86659FD93)
_BASE_INVERSE = U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_STEP = 0xA24BAED4963EE407
_FACTORS = [U64(pow(_STEP, i, 1 << 64)) for i in reversed(range(WORDS_PER_SHINGLE))]
_powers: dict[str, np.ndarray] = {}


def _power(n: int, base: np.uint64, name: str) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < n:
        held = np.full(max(n, CHUNK), base, U64)
        held[0] = 1
        held = np.cumprod(held, dtype=U64)
        if n <= 2 * CHUNK:
            _powers[name] = held
    return held[:n]


def _cut(data: np.ndarray, offsets: np.ndarray, start: int) -> int:
    """Where a chunk from ``start`` ends: between documents, or after white space of a long one."""
    end = start + CHUNK
    if end >= len(data):
        return len(data)
    k = int(np.searchsorted(offsets, end, "right")) - 1
    if offsets[k] > start:
        return int(offsets[k])
    spaces = np.flatnonzero(_SPACE[data[start:end]])
    if len(spaces):
        return start + int(spaces[-1]) + 1
    rest = np.flatnonzero(_SPACE[data[end : offsets[k + 1]]])
    return end + int(rest[0]) + 1 if len(rest) else int(offsets[k + 1])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each document."""
    hashes, places = [], []
    start = 0
    while start < len(data):
        end = _cut(data, offsets, start)
        b = data[start:end]
        solid = ~_SPACE[b]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        inner = offsets[(offsets > start) & (offsets < end)] - start
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
        begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(begin):
            sums = np.zeros(len(b) + 1, U64)
            np.cumsum(_CODES[b] * _power(len(b), _BASE, "up"), out=sums[1:])
            own = (sums[stop] - sums[begin]) * _power(len(b), _BASE_INVERSE, "down")[begin]
            hashes.append(mix(own + (stop - begin).astype(U64)))
            places.append(begin + start)
        start = end
    if not hashes:
        return np.zeros(0, U64), np.zeros(len(offsets) - 1, np.int64)
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(places), offsets))


def all_shingles(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes by start word (garbage across documents), and every document's first word and shingles."""
    words, counts = word_hashes(*text_buffers(column))
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    k = WORDS_PER_SHINGLE
    joined = np.zeros(len(words), U64)
    if len(words) >= k:
        full = joined[: len(words) - k + 1]
        for i, factor in enumerate(_FACTORS):
            full += words[i : len(words) - k + 1 + i] * factor
    joined = mix(joined)
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        own = words[starts[d] : starts[d] + counts[d]]
        whole = sum((int(w) * pow(_STEP, i + 8, 1 << 64) for i, w in enumerate(own)), int(counts[d]))
        joined[starts[d]] = mix(np.array([whole & ((1 << 64) - 1)], U64))[0]
    return joined, starts, np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))


def shingle_sets(column) -> list[np.ndarray]:
    """Each document's sorted distinct shingle hashes."""
    joined, starts, n = all_shingles(column)
    return [np.unique(joined[s : s + c]) for s, c in zip(starts.tolist(), n.tolist())]


def set_id(shingles: np.ndarray) -> bytes:
    """128 bits that name a shingle set; documents with equal sets share it."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
