"""Words of many texts at once, as numpy arrays over UTF-8 bytes, with 64-bit hashes.

Both word patterns exclude ASCII bytes only, so a byte table decides for every byte of a
character alike. A word's hash is a polynomial in an odd base modulo 2**64 over random values
of its bytes, mixed with its length; the base has an inverse, so sums over absolute positions are
brought to the word's start by one product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z.
ALNUM = np.array([chr(b).isdigit() or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: [^\x20\x09-\x0D]
SOLID = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])

_rng = np.random.Generator(np.random.PCG64(20240607))
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
TILE = 1 << 19


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length() if n > 1 else 1)
        step = np.full(size, base & (2**64 - 1), np.uint64)
        step[0] = 1
        _powers[base] = have = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise hashes so that every bit depends on every other."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span start:end; spans stand in order and don't overlap.

    Spans are taken in tiles of at most ``TILE`` bytes, so tables and sums follow the tile and not the text; a longer span is summed up in pieces.
    """
    sums = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(ends, lo + TILE, "right"))
        if j > i:
            piece = data[lo : ends[j - 1]]
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_VALUE[piece] * powers(_BASE, len(piece)), out=total[1:])
            a = starts[i:j] - lo
            sums[i:j] = (total[ends[i:j] - lo] - total[a]) * powers(_UNBASE, len(piece) + 1)[a]
        else:
            j, own = i + 1, 0
            for at in range(lo, int(ends[i]), TILE):
                piece = data[at : min(at + TILE, int(ends[i]))]
                own += int((_VALUE[piece] * powers(_BASE, len(piece))).sum(dtype=np.uint64)) * pow(_BASE, at - lo, 1 << 64)
            sums[i] = np.uint64(own % (1 << 64))
        i = j
    return mix(sums + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray  # of each word
    first: np.ndarray  # of each row its first word's index, then the number of words

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def split(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> Words:
    """The runs of bytes that ``kind`` accepts; none goes on into the next row."""
    n = len(at) - 1
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    change = inside[1:] & (~inside[:-1] | cut)
    starts = np.flatnonzero(change[:-1]) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    row = np.searchsorted(at, starts, "right") - 1
    first = np.searchsorted(row, np.arange(n + 1), "left")
    return Words(starts, ends, row, first)


def grams(hashes: np.ndarray, n: int, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of n words within one row begin, and their hashes."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    where = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
    total = np.zeros(len(where), np.uint64)
    base, weight = 0x2545F4914F6CDD1D, 1
    for k in range(n):
        total += hashes[where + k] * np.uint64(weight)
        weight = weight * base % (1 << 64)
    return where, mix(total + np.uint64(n))
