"""Content-defined chunking: a gear rolling hash over UTF-8 bytes, with normalised boundaries.

The hash of a position covers the 16 bytes that end there.  From the smallest
length on a boundary needs a rare value; past the normal length a more frequent
one does; at the largest length the chunk ends anyway.  Boundaries depend on near
bytes alone, so an insertion moves the chunks around it and no others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ._words import BYTE, _powers, mix

_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 2**16, 256, dtype=np.uint16)
WINDOW = 16


@dataclass(frozen=True)
class Sizes:
    """Bytes of the smallest, normal and largest chunk; bits that a boundary's hash has zero before and after the normal size."""

    least: int = 16
    normal: int = 24
    most: int = 64
    rare_bits: int = 5
    often_bits: int = 3


#: Fine chunks, for fingerprints of short texts too; coarser ones, for passages of many words.
FINE = Sizes()
COARSE = Sizes(16, 32, 96, 6, 4)


def rolling(raw: np.ndarray) -> np.ndarray:
    """Gear hash of the 16 bytes that end at each position, modulo 2**16."""
    h = _GEAR[raw]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint16(step))
    return h


def boundaries(raw: np.ndarray, offs: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks, and for each text the index of its first chunk (one more entry at the end).

    The smallest size is at least the window, so no hash that decides reaches into another text.
    """
    h = rolling(raw)
    often = np.flatnonzero(h < (1 << (16 - sizes.often_bits))) + 1
    rare = often[h[often - 1] < (1 << (16 - sizes.rare_bits))].tolist()
    often = often.tolist()
    far = len(raw) + sizes.most + 1
    rare.append(far)
    often.append(far)
    least, normal, most = sizes.least, sizes.normal, sizes.most
    i = j = 0
    ends: list[int] = []
    first = [0]
    for at, stop in zip(offs[:-1].tolist(), offs[1:].tolist()):
        while stop - at > least:
            low, mid, high = at + least, at + normal, at + most
            while rare[i] < low:
                i += 1
            if rare[i] < mid:
                at = rare[i]
            else:
                while often[j] < mid:
                    j += 1
                at = often[j] if often[j] < high else high
            if at >= stop:
                at = stop
            ends.append(at)
        if at < stop:
            ends.append(stop)
        first.append(len(ends))
    return np.array(ends, np.int64), np.array(first, np.int64)


def digests(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit digest and start of every chunk; the chunks cover the bytes without gaps."""
    if not len(ends):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    length = ends - starts
    pos = np.arange(len(raw), dtype=np.int64) - np.repeat(starts, length)
    h = BYTE[raw]
    h *= _powers(int(length.max()) + 1)[pos]
    return mix(np.add.reduceat(h, starts) + length.astype(np.uint64)), starts
