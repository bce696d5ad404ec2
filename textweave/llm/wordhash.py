"""64-bit hashes of many words of a byte array at once, in numpy.

A word is read eight bytes at a time. Each step multiplies by an odd number and folds the upper half into the lower one, so
words of up to eight bytes and equal length never meet, and patterns that repeat inside a word have no structure left.
"""

from __future__ import annotations

import hashlib

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32  # A-Z count as a-z
LONG = 4096  # bytes from which a word is hashed by itself
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # masks of a word's last bytes
HALF = np.uint64(32)


class WordHash:
    """One hash function; ``fold_case`` counts A-Z as a-z, ``bare`` gives words of up to eight bytes as they are."""

    def __init__(self, seed: int, fold_case: bool = False, bare: bool = False):
        self.key = seed.to_bytes(8, "little")
        self.odd, self.start, self.size = np.random.default_rng(seed).integers(0, 1 << 63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.fold_case, self.bare = fold_case, bare

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words data[start:end]."""
        size = end - start
        if self.fold_case:
            data = LOWER.take(data)
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
        out = size.astype(np.uint64) * self.size ^ self.start
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=self.key).digest(), "little")
        own, at = np.flatnonzero((size <= LONG) & (size > 8)) if self.bare else np.flatnonzero(size <= LONG), 0
        while len(own):
            left = size[own] - at
            h = (out[own] ^ eight[start[own] + at] & FIRST[np.minimum(left, 8)]) * self.odd
            out[own] = h ^ h >> HALF
            at += 8
            own = own[left > 8]
        out *= self.odd
        out ^= out >> HALF
        if self.bare:
            few = np.flatnonzero(size <= 8)
            out[few] = eight[start[few]] & FIRST[size[few]]
        return out


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte, and byte after the last, of each run without white space."""
    edge = np.flatnonzero(np.diff(np.r_[True, SPACE[data], True].astype(np.int8)))
    return edge[::2], edge[1::2]
