"""A minimal perfect hash over 64-bit keys, in numpy.

Level by level, each key that is alone in its place of a bit array keeps that place and the others go on to the next
level with another hash. The slot of a key is the number of set bits before its place, so n keys get the slots 0 to
n - 1. A lookup reads a few bits: constant time. A key that isn't in the set gets some slot as well, or none; the
fingerprint kept for each slot tells.
"""

from __future__ import annotations

import numpy as np

#: Places of a level for each key that is left.
ROOM = 2.0
MAX_LEVELS = 64


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer: xor-shifts and odd multiplications."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 977) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """sizes: places of each level; bits: one byte for each place; ranks: set bits before each block of 64 places."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct uint64."""
        left, sizes, levels = keys, [], []
        while len(left):
            if len(sizes) >= MAX_LEVELS:
                raise ValueError("the keys aren't distinct")
            size = int(len(left) * ROOM) + 1
            place = (mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[place]]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, bool))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for a key that has none."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            place = self.begins[level] + (mix(keys[left], level) % np.uint64(size)).astype(np.int64)
            here = self.bits[place]
            out[left[here]] = self.ranks[place[here]]
            left = left[~here]
        return out
