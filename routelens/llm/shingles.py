"""Vectorised word and shingle hashing over Arrow text buffers.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, taken on UTF-8 bytes. A word's hash is a polynomial
over its bytes modulo 2**64 (prefix sums give every word at once), then mixed; a shingle combines the hashes
of its words. 64-bit hashes stand for shingles: two different ones in a pair of documents collide with a
probability of about (set size)**2 / 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from routelens.llm.common import chunks

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word of the texts data[offsets[i]:offsets[i+1]], in order."""
    first = int(offsets[0])
    buf = data[first : int(offsets[-1])]
    n = len(buf)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    size = 1 << max(20, n.bit_length())
    power, inverse = _powers(size)
    inside = ~_SPACE[buf]
    starts_row = np.zeros(n + 1, bool)
    starts_row[offsets - first] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | starts_row[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | starts_row[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_LOWER[buf] * power[:n], out=total[1:])
    h = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    rows = np.searchsorted(offsets - first, s, "right") - 1
    return mix(h), rows


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: k words each; fewer words are one shingle; no words: empty."""
    for i, j in chunks(offsets):
        h, rows = word_hashes(data, offsets[i : j + 1])
        count = np.bincount(rows, minlength=j - i)
        at = np.concatenate(([0], np.cumsum(count)))
        whole = np.full(max(0, len(h) - k + 1), np.uint64(k) * np.uint64(0x165667B19E3779F9), np.uint64)
        for x in range(k):
            whole = mix((whole ^ h[x : len(h) - k + 1 + x]) * np.uint64(0x9FB21C651E98DF25 + 2 * x) + np.uint64(x + 1))
        for r in range(j - i):
            if count[r] >= k:
                yield np.unique(whole[at[r] : at[r + 1] - k + 1])
            elif count[r]:
                g = np.full(1, np.uint64(count[r]) * np.uint64(0x165667B19E3779F9), np.uint64)
                for x in range(count[r]):
                    g = mix((g ^ h[at[r] + x]) * np.uint64(0x9FB21C651E98DF25 + 2 * x) + np.uint64(x + 1))
                yield g
            else:
                yield np.empty(0, np.uint64)
