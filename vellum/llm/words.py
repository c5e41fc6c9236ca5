"""Words and shingles as 64-bit hashes, vectorised over slices of documents.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. Its hash is a polynomial over its bytes modulo 2^64, read off
a running sum for all words of a slice at once, so that no Python code runs for each word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .common import SLICE_BYTES, mix64

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15
STEP = 0xD6E8FEB86659FD93
FACTORS = [np.uint64(pow(STEP, k, 1 << 64)) for k in range(16)]


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for b in (BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _bytes_table() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


TABLE = _bytes_table()


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = SPACE[data]
    change = np.flatnonzero(gap[1:] != gap[:-1])
    return change[::2], change[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = 1 << max(20, int(len(data)).bit_length())
    up, down = _powers(n)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * up[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _pieces(raw: bytes) -> list[bytes]:
    """A long text cut at white space, so that memory stays bounded by a piece and not by the text."""
    out, at = [], 0
    while len(raw) - at > 2 * SLICE_BYTES:
        cut = at + SLICE_BYTES
        while cut < len(raw) and not SPACE[raw[cut]]:
            cut += 1
        out.append(raw[at:cut])
        at = cut
    out.append(raw[at:])
    return out


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the lower-cased (A-Z) texts, one after the other, and the number of words of each text."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    if len(texts) == 1 and len(texts[0]) > 2 * SLICE_BYTES:
        for piece in _pieces(texts[0]):
            data = np.frombuffer(piece.lower(), np.uint8)
            s, e = spans(data)
            hashes.append(word_hashes(data, s, e))
        counts[0] = sum(map(len, hashes))
        return np.concatenate(hashes), counts
    joined = b" ".join(texts).lower()
    data = np.frombuffer(joined, np.uint8)
    s, e = spans(data)
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(s, ends), prepend=0)
    return word_hashes(data, s, e), counts


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``width`` words; fewer words make one shingle; none, an empty set."""
    hashes, counts = words_of(texts)
    n = len(hashes)
    full = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        full += hashes[k : k + len(full)] * FACTORS[k]
    full = mix64(full + np.uint64(width))
    out, at = [], 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(full[at : at + c - width + 1]))
        elif c:
            few = hashes[at : at + c] * np.array(FACTORS[:c])
            out.append(mix64(few.sum(keepdims=True) + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out
