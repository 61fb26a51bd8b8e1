"""Minimal perfect hash functions by levels of bit arrays, over numpy arrays of 64-bit keys."""

from __future__ import annotations

import numpy as np

from repertoire.llm._text import mix64

#: Bits of a level for each key that it is offered.
ROOM = 2.0


class PerfectHash:
    """A bijection of n distinct keys to 0 .. n - 1.

    Every level hashes the keys that are left into its bit array; those that have a bit to themselves stay,
    the others go to the next level. A key's number is the rank of its bit in all levels.
    """

    __slots__ = ("sizes", "bits", "rank")

    def __init__(self, sizes: list[int], bits: list[np.ndarray]):
        self.sizes, self.bits, self.rank = sizes, bits, []
        below = 0
        for b in bits:
            ones = np.cumsum(np.bitwise_count(b), dtype=np.int64)
            self.rank.append(below + ones - np.bitwise_count(b))
            below += int(ones[-1]) if len(ones) else 0

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """The function of ``keys``, which must be distinct."""
        sizes, bits, level = [], [], 0
        while len(keys):
            size = int(-(-len(keys) * ROOM // 64) * 64)
            at = cls._place(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys, level = keys[~alone[at]], level + 1
        return cls(sizes, bits)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of ``keys``; one that was not built in gets any number, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self._place(keys[left], level, size)
            word, bit = self.bits[level][at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[here]] = (self.rank[level][at >> 6] + below)[here]
            left = left[~here]
        return out

    def tobytes(self) -> bytes:
        head = np.array([len(self.sizes), *self.sizes], np.int64)
        return head.tobytes() + b"".join(b.tobytes() for b in self.bits)

    @classmethod
    def frombytes(cls, raw: bytes) -> PerfectHash:
        levels = int(np.frombuffer(raw, np.int64, 1)[0])
        sizes = np.frombuffer(raw, np.int64, levels, 8).tolist()
        at, bits = 8 * (levels + 1), []
        for size in sizes:
            bits.append(np.frombuffer(raw, np.uint64, size // 64, at))
            at += size // 8
        return cls(sizes, bits)
