"""Minimal perfect hash over distinct 64-bit keys, by levels of bit arrays.

Each level hashes the keys left into a bit array of twice their number; bits hit once keep their key, keys that collide go
on.  A key's slot is the rank of its bit, so n keys fill slots 0 to n - 1.  Both building and look-up are whole-array work.
"""

from __future__ import annotations

import numpy as np

LEVELS = 40
SPACE = 2


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over keys and a seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """``levels``: packed bits of all levels one after another; ``sizes``: bits of each; ``ranks``: bits set before each byte."""

    def __init__(self, bits: np.ndarray, sizes: list[int]):
        self.bits, self.sizes = bits, sizes
        self.starts = np.cumsum([0, *sizes])
        self.ranks = np.r_[0, np.cumsum(np.bitwise_count(bits), dtype=np.int64)]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        keys, parts, sizes = keys.astype(np.int64).view(np.uint64), [], []
        for level in range(LEVELS):
            if not len(keys):
                break
            size = (SPACE * len(keys) + 7) // 8 * 8
            at = (mix(keys, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little"))
            sizes.append(size)
            keys = keys[~alone[at]]
        if len(keys):
            raise ValueError("keys must be distinct")
        return cls(np.concatenate([np.zeros(0, np.uint8), *parts]), sizes)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are surely absent; an absent key may also get another key's slot."""
        keys = keys.astype(np.int64).view(np.uint64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = (mix(keys[open_], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            hit = (self.bits[byte] >> bit) & 1 == 1
            below = np.bitwise_count(self.bits[byte] & ((np.uint8(1) << bit) - np.uint8(1)))
            out[open_[hit]] = (self.ranks[byte] + below)[hit]
            open_ = open_[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64), 1000) >> np.uint64(32)).astype(np.uint32)
