"""Words and word shingles of a batch of texts as 64-bit hashes, in numpy.

A word is a run of `[^\\x20\\x09-\\x0D]+`; A-Z count as a-z. Two texts with equal
words have equal hashes; different words share one with a chance of 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATED = SPACE.copy()  # white space and ASCII punctuation
PUNCTUATED[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_SHIFTS, _FACTORS = (_U(30), _U(27), _U(31)), (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=False)
    y = x >> _SHIFTS[0]
    y ^= x
    y *= _FACTORS[0]
    z = y >> _SHIFTS[1]
    y ^= z
    y *= _FACTORS[1]
    np.right_shift(y, _SHIFTS[2], out=z)
    y ^= z
    return y


def mixed(x: int) -> int:
    """mix of one number."""
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return x ^ x >> 31


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_LOWERED = _BYTE[LOWER]
_STEP = 0xD6E8FEB86659FD93
_POWERS = np.ones((2, 1), np.uint64)


def _powers(n: int) -> np.ndarray:
    """[2, n + 1 at least] powers of the words' factor, from the first on, and of its inverse, from 1 on."""
    global _POWERS
    if n >= _POWERS.shape[1]:
        steps = np.empty((2, (1 << int(n).bit_length()) + 1), np.uint64)
        steps[:] = np.array([[_STEP], [pow(_STEP, -1, 1 << 64)]], np.uint64)
        steps[1, 0] = 1
        _POWERS = np.multiply.accumulate(steps, axis=1)
    return _POWERS


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    a = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = a.buffers()
    off = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def word_spans(raw: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and one past the last)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~space[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = off[:-1][off[:-1] < off[1:]]
    begins[at] = inside[at]
    stops = np.zeros(len(raw) + 1, bool)
    stops[1:] = inside
    stops[1:-1] &= ~inside[1:]
    stops[at[at > 0]] = inside[at[at > 0] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # running totals over about 32 KB at a time, what a core's cache holds
        low = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, low + (1 << 15), "right")))
        n = int(ends[stop - 1]) - low
        up, down = _powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_LOWERED[raw[low : low + n]] * up[:n], out=total[1:])
        s = starts[at:stop] - low
        out[at:stop] = (total[ends[at:stop] - low] - total[s]) * down[s]
        at = stop
    return mix(out ^ mix((ends - starts).astype(np.uint64)))


_PLACE = np.multiply.accumulate(np.full(64, _U(0x9FB21C651E98DF25), np.uint64))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows that begin at each word; len(words) - k + 1 of them."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += words[j : j + n] * _PLACE[j]
    return mix(total)


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct k-word shingles; of fewer words the whole sequence is one."""
    if not len(words):
        return words
    if len(words) < k:
        return grams(words, len(words)) ^ _U(0x5851F42D4C957F2D + len(words))
    return np.unique(grams(words, k))


def doc_words(column: pa.Array, space: np.ndarray = SPACE):
    """Yields, text by text, its word hashes. Spans are not kept."""
    raw, off = utf8(column)
    starts, ends, first = word_spans(raw, off, space)
    h = word_hashes(raw, starts, ends)
    for i in range(len(column)):
        yield h[first[i] : first[i + 1]]


def fingerprint(members: np.ndarray) -> int:
    """A set's own 64-bit hash, as a signed number; 0 for the empty set."""
    if not len(members):
        return 0
    x = mixed(int(np.add.reduce(mix(members))) ^ mixed(len(members))) | 1
    return x - (1 << 64) if x >> 63 else x


def segment_sets(words: np.ndarray, a: np.ndarray, b: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """shingle_set of each segment words[a:b], all in one array: (members, first of each set and one past the last)."""
    size = b - a
    m = np.where(size >= k, size - k + 1, (size > 0).astype(size.dtype))
    total = int(m.sum())
    first = np.concatenate(([0], np.cumsum(m)))
    if not total:
        return words[:0], first
    at = np.repeat(a - first[:-1], m) + np.arange(total)
    g = grams(words, k)
    value = g[np.minimum(at, max(0, len(g) - 1))] if len(g) else np.zeros(total, np.uint64)
    for i in np.flatnonzero((size > 0) & (size < k)):
        value[first[i]] = shingle_set(words[a[i] : b[i]], k)[0]
    ends = first.tolist()
    for x, y in zip(ends, ends[1:]):
        value[x:y].sort()
    new = np.ones(total, bool)
    new[1:] = value[1:] != value[:-1]
    new[first[:-1][m > 0]] = True
    kept = np.concatenate(([0], np.cumsum(new)))
    return value[new], kept[first]


def fingerprints(members: np.ndarray, first: np.ndarray) -> np.ndarray:
    """fingerprint of each set."""
    n = np.diff(first)
    out = np.zeros(len(n), np.int64)
    some = np.flatnonzero(n)
    if len(some):
        total = np.add.reduceat(mix(members), first[:-1][some])
        out[some] = (mix(total ^ mix(n[some].astype(np.uint64))) | _U(1)).view(np.int64)
    return out


def text_words(column: pa.Array, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts, first word of each text and one past the last)."""
    raw, off = utf8(column)
    starts, ends, first = word_spans(raw, off, space)
    return word_hashes(raw, starts, ends), first


def blobs(members: np.ndarray, first: np.ndarray) -> pa.Array:
    """Each set's members as bytes."""
    width = members.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(members))])
