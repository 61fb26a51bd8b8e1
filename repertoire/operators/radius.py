"""Pairs of loops within a radius, without comparing all of them.

The compared residues of the references are a tree of prefixes. Queries go down it together, residue by residue, and a
branch is left as soon as its distance is above the limit, so the work follows the pairs that are near and not the product
of both sides. Memory is bounded: a front that would grow beyond ``MOST`` is cut and gone through part after part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from repertoire.functions.sequences import DistanceParams
from repertoire.operators.tally import CODE, TABLE, core, gap_place

#: Branches that are looked at, or pairs that are listed, at once.
MOST = 1 << 21
#: Sides of one unit; a query meets that many references at once.
QUERIES, REFERENCES = 16_384, 262_144


def selective(radius: float | None, p: DistanceParams) -> bool:
    """Whether a radius leaves out most pairs: it allows two residues of any kind to differ, or less."""
    if radius is None or p.align_cdr3s or p.scale_factor <= 0 or p.gap_penalty_cdr3_region <= 0 or p.weight_cdr3_region <= 0:
        return False
    return radius / p.scale_factor / p.weight_cdr3_region <= 2 * float(TABLE.max())


def _sorted_cores(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by residues, and the first column in which each differs from the row before (all: the width)."""
    order = np.lexsort(x.T[::-1]) if x.shape[1] else np.arange(len(x))
    y = x[order]
    first = np.zeros(len(x), np.intp)
    if len(x) > 1:
        differs = y[1:] != y[:-1]
        first[1:] = np.where(differs.any(1), differs.argmax(1), x.shape[1]) if x.shape[1] else 0
    if not x.shape[1] and len(x):
        first[1:] = 1  # rows without residues are all equal
    return order, first


def runs(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of its range, place) for every place of ranges."""
    size = stop - start
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) + np.repeat(start - (np.cumsum(size) - size), size)


def _in_parts(size: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows of which each has a total size of ``most``, or one row."""
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield slice(at, to)
        at = to


def near_cores(q: np.ndarray, r: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of q, rows of r, distances) of pairs of rows whose residues' distances add up to the limit at most."""
    width = q.shape[1]
    if not len(q) or not len(r) or limit < 0:
        return
    q_order, q_first = _sorted_cores(q)
    r_order, r_first = _sorted_cores(r)
    heads = lambda first, k: np.flatnonzero((first < k) | (np.arange(len(first)) == 0))
    q_at = heads(q_first, max(width, 1))
    queries, q_ends = q[q_order[q_at]] % 20, np.append(q_at, len(q))
    rows = r[r_order] % 20
    level = [np.zeros(1, np.intp)]  # first row of every prefix, by its length
    letters, starts = [], []
    for k in range(width):
        at = heads(r_first, k + 1)
        letters.append(rows[at, k])
        starts.append(np.append(np.searchsorted(at, level[-1]), len(at)))
        level.append(at)
    r_ends = np.append(level[-1], len(r))
    front = [(0, np.arange(len(queries)), np.zeros(len(queries), np.intp), np.zeros(len(queries), np.float32))]
    while front:
        k, i, node, cost = front.pop()
        if not len(i):
            continue
        if k == width:
            for some in _in_parts((q_ends[i + 1] - q_ends[i]) * (r_ends[node + 1] - r_ends[node]), MOST):
                a, x = runs(q_ends[i[some]], q_ends[i[some] + 1])
                b, y = runs(r_ends[node[some]][a], r_ends[node[some] + 1][a])
                yield q_order[x[b]], r_order[y], cost[some][a[b]]
            continue
        size = starts[k][node + 1] - starts[k][node]
        parts = list(_in_parts(size, MOST))
        if len(parts) > 1:
            front += [(k, i[some], node[some], cost[some]) for some in parts]
            continue
        row, child = runs(starts[k][node], starts[k][node + 1])
        total = cost[row] + TABLE[queries[i[row], k], letters[k][child]]
        kept = total <= limit
        front.append((k + 1, i[row[kept]], child[kept], total[kept]))


def _letters(loops: pa.Array, n: int) -> np.ndarray:
    """Codes of loops of one length."""
    return CODE[np.frombuffer("".join(loops.to_pylist()).encode("ascii"), np.uint8)].reshape(len(loops), n)


def near_loops(q: pa.Array, r: pa.Array, radius: float, p: DistanceParams) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of q, rows of r, distances) of loops within a radius, before scaling and V genes; each side has loops of one
    length, those of ``q`` not the longer ones."""
    if not len(q) or not len(r):
        return
    n, longer = len(q[0].as_py()), len(r[0].as_py())
    gaps = p.gap_penalty_cdr3_region * (longer - n)
    side = lambda x, size: core(_letters(x, size), n, gap_place(n), p.trim_cdr3s)
    limit = (radius - gaps) / p.weight_cdr3_region
    # a little more than the limit, as the caller tests the whole distance
    for i, j, d in near_cores(side(q, n), side(r, longer), limit + 1e-4 if limit >= 0 else limit):
        yield i, j, np.float32(p.weight_cdr3_region) * d + np.float32(gaps)


def _bytes(loops: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all letters, and where each loop starts and ends; a blank follows the last."""
    loops = loops.cast(pa.large_string())
    ends = np.frombuffer(loops.buffers()[1], np.int64, len(loops) + 1, loops.offset * 8)
    text = np.frombuffer(loops.buffers()[2] or b"", np.uint8)
    return np.append(CODE[text] % 20, 0), ends[:-1], ends[1:]


def listed_loops(a: pa.Array, b: pa.Array, p: DistanceParams) -> np.ndarray:
    """Distances of loops side by side, before scaling and V genes; NaN where one is too short."""
    (x, a0, a1), (y, b0, b1) = _bytes(a), _bytes(b)
    la, lb = a1 - a0, b1 - b0
    n = np.minimum(la, lb)
    out = np.zeros(len(n), np.float32)
    if not len(n):
        return out
    head, tail = (3, 2) if p.trim_cdr3s else (0, 0)
    gap = np.minimum(6, 3 + (n - 5) // 2)

    def add(some: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        out[some] += TABLE[x[i[some]], y[j[some]]]

    for k in range(head, 6):
        add(np.flatnonzero(k < np.maximum(gap, 0)), a0 + k, b0 + k)
    for k in range(tail + 1, int((n - gap).max(initial=0)) + 1):
        add(np.flatnonzero(k <= n - gap), a1 - k, b1 - k)
    out = np.float32(p.weight_cdr3_region) * out + np.float32(p.gap_penalty_cdr3_region) * np.abs(la - lb).astype(np.float32)
    out[n < (6 if p.trim_cdr3s else 2)] = np.nan
    return out
