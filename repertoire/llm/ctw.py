r"""Context-tree weighting over bytes: the arithmetic of one block of contexts (used inside tasks).

A byte is eight binary decisions; a node is (context bytes, bits decided so far). At each node the
Krichevsky-Trofimov estimate of the next bit is weighted, half and half a priori, against the nodes
whose context is one byte longer: P_w = (P_kt + prod P_w(children)) / 2, and P_w = P_kt at full depth.
The probability of a bit is the posterior mixture over all depths along its context's path; where a
longer context was never seen, the path ends and the estimate there stands.

A gram is an unsigned 64-bit key: the context bytes, oldest first, then the byte itself. All nodes of
a gram at depth two or more depend only on grams with the same last two context bytes, so grams are
dealt in blocks by those. Depths zero and one (``Top``) join the blocks and have at most 65,535 nodes.
"""

from __future__ import annotations

import numpy as np

DEPTH = 5
_U = np.uint64
_HALF = np.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, shifted by eight so that it is exact to 1e-12 for x >= 0.5."""
    y = x + 8.0
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    z = 1.0 / (y * y)
    series = (1.0 / 12 - z * (1.0 / 360 - z * (1.0 / 1260 - z * (1.0 / 1680)))) / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability that the estimator gives to a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


def grams(stream: np.ndarray, first: np.ndarray, depth: int) -> np.ndarray:
    """The keys of every byte of the texts that start at ``first``; before a text come line ends."""
    s = stream.astype(np.uint64)
    key = s.copy()
    at = np.arange(len(s)) - np.repeat(first[:-1], np.diff(first))
    for j in range(1, depth + 1):
        before = np.full(len(s), 10, np.uint64)
        before[j:] = s[: max(0, len(s) - j)]
        before[at < j] = 10
        key |= before << _U(8 * j)
    return key


def merge_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[edge], np.add.reduceat(counts, edge) if len(keys) else counts


def _nodes(keys: np.ndarray, counts: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node ids, zeros, ones) of sorted keys at a bit level."""
    ident = keys >> _U(8 - level)
    if not len(keys):
        return ident, counts, counts
    edge = np.flatnonzero(np.concatenate(([True], ident[1:] != ident[:-1])))
    one = ((keys >> _U(7 - level)) & _U(1)).astype(np.float64)
    total = np.add.reduceat(counts, edge)
    ones = np.add.reduceat(counts * one, edge)
    return ident[edge], total - ones, ones


class Block:
    """All nodes of depth >= 2 of one block of grams; nodes are made one bit level at a time."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH):
        self.keys, self.counts, self.depth = keys, counts.astype(np.float64), depth
        self.at = {depth: (self.keys, self.counts)}
        for d in range(depth - 1, 1, -1):
            short = self.keys & _U((1 << (8 * (d + 1))) - 1)
            uniq, number = np.unique(short, return_inverse=True)
            self.at[d] = (uniq, np.bincount(number, self.counts, len(uniq)))

    def level(self, b: int) -> tuple[dict, tuple]:
        """({depth: (node ids, probability of a one, weight of the own estimate)}, roots at depth two)."""
        out, below = {}, None
        for d in range(self.depth, 1, -1):
            ident, zeros, ones = _nodes(*self.at[d], b)
            estimate = log_kt(zeros, ones)
            if below is None:
                weighted, keep = estimate, np.ones(len(ident))
            else:
                parent = np.searchsorted(ident, below[0] & _U((1 << (8 * d + b)) - 1))
                split = np.bincount(parent, below[1], len(ident))
                weighted = np.logaddexp(_HALF + estimate, _HALF + split)
                keep = np.exp(_HALF + estimate - weighted)
            out[d] = (ident, (ones + 0.5) / (zeros + ones + 1.0), keep)
            below = (ident, weighted)
        return out, (ident, weighted, zeros, ones)

    def roots(self) -> list[tuple[int, int, float, float, float]]:
        """(level, node id, log weighted probability, zeros, ones) at depth two."""
        return [(b, int(i), float(w), float(z), float(o)) for b in range(8) for i, w, z, o in zip(*self.level(b)[1], strict=True)]

    def log_probabilities(self, keys: np.ndarray, top: Top) -> np.ndarray:
        """Natural log of P(byte | context) of any grams, seen in training or not, of this block."""
        total = np.zeros(len(keys))
        for b in range(8):
            nodes = self.level(b)[0]
            q, known = np.full(len(keys), 0.5), np.zeros(len(keys), bool)
            for d in range(self.depth, 1, -1):
                ident, one, keep = nodes[d]
                if not len(ident):
                    continue
                mine = (keys & _U((1 << (8 * (d + 1))) - 1)) >> _U(8 - b)
                row = np.minimum(np.searchsorted(ident, mine), len(ident) - 1)
                here = ident[row] == mine
                q = np.where(here, np.where(known, keep[row] * one[row] + (1 - keep[row]) * q, one[row]), q)
                known |= here
            q = top.mix(keys, b, q, known)
            total += np.log(np.where(((keys >> _U(7 - b)) & _U(1)).astype(bool), q, 1 - q))
        return total


class Top:
    """Depths zero and one: ``one[d][level][id]`` and ``keep[d][level][id]`` over all possible ids."""

    def __init__(self, roots):
        """roots: (level, depth-one node id, sum of log weighted probabilities, zeros, ones)."""
        self.one, self.keep = {}, {}
        for b in range(8):
            size1, size0 = 256 << b, 1 << b
            split, zeros, ones = np.zeros(size1), np.zeros(size1), np.zeros(size1)
            for level, ident, w, z, o in roots:
                if level == b:
                    split[ident] += w
                    zeros[ident] += z
                    ones[ident] += o
            estimate = log_kt(zeros, ones)
            weighted = np.logaddexp(_HALF + estimate, _HALF + split)
            self.one[1, b], self.keep[1, b] = (ones + 0.5) / (zeros + ones + 1), np.exp(_HALF + estimate - weighted)
            self.keep[1, b][zeros + ones == 0] = -1.0  # never seen
            prefix = np.arange(size1) & (size0 - 1)
            z0, o0 = np.bincount(prefix, zeros, size0), np.bincount(prefix, ones, size0)
            estimate0 = log_kt(z0, o0)
            split0 = np.bincount(prefix, np.where(zeros + ones > 0, weighted, 0.0), size0)
            self.one[0, b] = (o0 + 0.5) / (z0 + o0 + 1)
            self.keep[0, b] = np.exp(_HALF + estimate0 - np.logaddexp(_HALF + estimate0, _HALF + split0))

    def mix(self, keys: np.ndarray, level: int, q: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Mixes depths one and zero into q (probabilities of a one from depth two on, where known)."""
        i1 = ((keys & _U(0xFFFF)) >> _U(8 - level)).astype(np.int64)
        i0 = i1 & ((1 << level) - 1)
        p1, k1, p0, k0 = self.one[1, level][i1], self.keep[1, level][i1], self.one[0, level][i0], self.keep[0, level][i0]
        q1 = k1 * p1 + (1 - k1) * np.where(known, q, p1)
        return np.where(k1 < 0, p0, k0 * p0 + (1 - k0) * np.where(k1 < 0, p0, q1))


class Table:
    """A read-only open-addressed map from non-zero 64-bit keys to row numbers."""

    def __init__(self, keys: np.ndarray):
        size = 1 << max(10, (2 * len(keys)).bit_length())
        self.mask = size - 1
        self.slot = np.full(size, -1, np.int32)
        self.keys = keys
        todo = np.arange(len(keys))
        at = self._home(keys)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]  # of several for one slot, the last is in
            lost = self.slot[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        x = keys * _U(0x9E3779B97F4A7C15)
        return ((x ^ (x >> _U(32))) & _U(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where absent."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            row = self.slot[at]
            there = row >= 0
            hit = there & (self.keys[np.maximum(row, 0)] == keys[todo])
            out[todo[hit]] = row[hit]
            on = there & ~hit
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out
