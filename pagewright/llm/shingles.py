"""Vectorised words and word shingles of Arrow string columns.

A slice of texts is handled as one byte array: words are runs between separators, a word's hash is a polynomial
over its bytes taken from a running sum, and a shingle's hash combines the hashes of consecutive words. All hashes
are 64 bits wide, so two different shingles among a billion agree with a chance below one in ten.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the result."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spread(seed: int, n: int) -> np.ndarray:
    """`n` fixed pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * BASE)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PUNCT = SPACE.copy()
PUNCT[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
LOWER = np.arange(256)
LOWER[0x41:0x5B] += 32
LETTER = spread(1, 256)[LOWER]
PLACE = spread(2, 64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least `n` of each."""
    if len(_powers[0]) < n:
        n = max(n, SLICE_BYTES * 2)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for i, b in enumerate((BASE, inverse)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


class Words(NamedTuple):
    """Words of a slice of texts: hashes, byte spans in the slice, and where each text's words begin (one more than texts)."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of about SLICE_BYTES: (first row, end row, bytes, text offsets). A null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, "right")) - 1)
        j = min(j, len(texts))
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(raw: np.ndarray, off: np.ndarray, separator: np.ndarray = SPACE) -> Words:
    inside = ~separator[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(LETTER[raw] * power[: len(raw)], out=total[1:])
    return Words(mix((total[end] - total[start]) * inverse[start]), start, end, np.searchsorted(start, off))


def shingles(w: Words, k: int = 5, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first word of each, where each text's shingles begin). A text of 1 to k-1 words gives its whole sequence if `short`."""
    n, texts = len(w.hashes), len(w.offsets) - 1
    lengths = np.diff(w.offsets)
    counts = np.maximum(lengths - k + 1, 0)
    if n >= k:
        at = np.arange(n - k + 1)
        owner_end = np.repeat(w.offsets[1:], lengths)[: n - k + 1]
        at = at[at + k <= owner_end]
        acc = np.zeros(len(at), np.uint64)
        for i in range(k):
            acc += w.hashes[at + i] * PLACE[i]
        out = mix(acc)
    else:
        at, out = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    few = np.flatnonzero((lengths > 0) & (lengths < k)) if short else []
    if len(few):
        base = np.concatenate([[0], np.cumsum(counts)])
        more = []
        for t in few:
            s = w.hashes[w.offsets[t] : w.offsets[t + 1]]
            more.append(mix(np.array([(s * PLACE[: len(s)]).sum(dtype=np.uint64) + np.uint64(len(s))]))[0])
        out = np.insert(out, base[few], np.array(more, np.uint64))
        at = np.insert(at, base[few], w.offsets[few])
        counts[few] = 1
    return out, at, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)[: texts + 1]
