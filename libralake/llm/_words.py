"""Word and shingle hashes of many texts at once, from their UTF-8 bytes.

Words are maximal runs of bytes other than space and the controls 9 to 13, with
A-Z lower-cased.  A word's hash is a polynomial over random byte values modulo
2**64; a shingle's hash mixes the hashes of its words in order.  64 bits keep
accidental equality out of reach for the sets compared here (a clash would have
to fall into one pair of documents that lies exactly on the threshold).
"""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240517))
BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C13)
PLACE = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
TOKEN = np.ones(256, bool)
TOKEN[[32, 9, 10, 11, 12, 13]] = False
_LOWER_BYTE = BYTE[LOWER]


def _powers(n: int, known: list[np.ndarray] = [np.ones(1, np.uint64)]) -> np.ndarray:  # noqa: B006
    if len(known[0]) < n:
        size = max(n, 2 * len(known[0]), 256)
        known[0] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, STEP, np.uint64))])
    return known[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and for each text the index of its first word (one more entry at the end)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    tok = TOKEN[raw]
    first = tok.copy()
    first[1:] &= ~tok[:-1]
    heads = offs[:-1][offs[:-1] < n]
    first[heads] = tok[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    count = np.cumsum(tok, dtype=np.int32 if n < 2**31 else np.int64)
    at = (count[starts] - 1).astype(np.int64)
    own = raw[tok]
    length = np.diff(at, append=len(own))
    pos = np.arange(len(own), dtype=np.int64) - np.repeat(at, length)
    h = _LOWER_BYTE[own]
    h *= _powers(int(length.max()) + 1)[pos]
    out = mix(np.add.reduceat(h, at) + length.astype(np.uint64))
    return out, np.searchsorted(starts, offs).astype(np.int64)


def shingles(raw: np.ndarray, offs: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle with repeats, and for each text the index of its first one.

    A text of 1 to ``width - 1`` words has one shingle, its whole sequence; a text without words has none.
    """
    words, at = word_hashes(raw, offs)
    n_words = np.diff(at)
    n = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(int(out_at[-1]), np.uint64)
    if not len(out):
        return out, out_at
    if len(words) >= width:
        s = np.zeros(len(words) - width + 1, np.uint64)
        for j in range(width):
            s += words[j : len(s) + j] * PLACE[j]
        full = n_words >= width
        src = np.repeat(at[:-1][full] - out_at[:-1][full], n[full])
        dst = np.flatnonzero(np.repeat(full, n))
        out[dst] = mix(s[src + dst] + np.uint64(width))
    for i in np.flatnonzero((n_words > 0) & (n_words < width)):
        k = int(n_words[i])
        part = words[at[i] : at[i + 1]]
        out[out_at[i]] = mix(np.array([int(np.sum(part * PLACE[:k], dtype=np.uint64))], np.uint64) + np.uint64(k))[0]
    return out, out_at
