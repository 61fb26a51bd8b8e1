"""Counts of distances between two blocks of clones, for distances that are whole numbers.

A query meets all references of a block in a few passes: three residues at a time are looked up in one table, gaps
and V genes by class, and the pairs of its two chains' distances are counted. The counts give chains A, B and AB,
so no matrix of distances is kept and a block of references can be large.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from repertoire.functions.sequences import DistanceParams
from repertoire.functions.tables import AMINO_ACIDS, substitution_distance

CODE = np.full(128, -1, np.int8)
CODE[[ord(a) for a in AMINO_ACIDS]] = np.arange(20)
TABLE = np.array([[substitution_distance()[a + b] for b in AMINO_ACIDS] for a in AMINO_ACIDS], np.float32)
#: Counts that a query may need; distances that spread wider are compared as matrices.
MOST_CELLS = 1 << 21


def core(codes: np.ndarray, n: int, gap: int, trim: bool) -> np.ndarray:
    """The residues compared where the shorter loop has length ``n``."""
    head, tail = (3, 2) if trim else (0, 0)
    length = codes.shape[1]
    return np.concatenate((codes[:, head : max(head, gap)], codes[:, length - (n - gap) : length - tail if n - gap > tail else length - (n - gap)]), 1)


def letters(seqs: list[str], n: int) -> np.ndarray:
    """Codes of sequences of length ``n``, one row each."""
    return CODE[np.frombuffer("".join(seqs).encode("ascii"), np.uint8)].reshape(-1, n)


def gap_place(n: int) -> int:
    return min(6, 3 + (n - 5) // 2)


def triples(x: np.ndarray) -> np.ndarray:
    """(slots, rows): residues of a core three at a time, a blank in places left over."""
    columns = [*(x % 20).T.astype(np.intp), *(np.full(len(x), 20),) * (-x.shape[1] % 3)]
    return np.array([columns[i] * 441 + columns[i + 1] * 21 + columns[i + 2] for i in range(0, len(columns), 3)]).reshape(-1, len(x))


@lru_cache(1)
def triple_table(weight: float) -> np.ndarray:
    """Weighted distances between any three residues and any three others; blanks count nothing."""
    one = np.zeros((21, 21), np.uint8 if 3 * weight * TABLE.max() < 256 else np.uint16)
    one[:20, :20] = weight * TABLE
    two = (one[:, None, :, None] + one[None, :, None, :]).reshape(441, 441)
    return (two[:, None, :, None] + one[None, :, None, :]).reshape(9261, 9261)


def whole(p: DistanceParams, vdist: dict[str, dict]) -> bool:
    """Whether all distances are whole numbers that tables of small integers hold."""
    steps = [p.weight_cdr3_region * float(TABLE.max()), p.gap_penalty_cdr3_region, *(x for t in vdist.values() for x in t.values())]
    steps += [p.weight_cdr3_region * float(x) for x in np.unique(TABLE)]
    return p.scale_factor == 1 and not p.align_cdr3s and all(0 <= x < 1000 and x == int(x) for x in steps)


class Chain:
    """One chain of a block of clones: rows by length, letters and V gene sets."""

    def __init__(self, seqs: list[str], sets: list, p: DistanceParams):
        lengths = np.fromiter(map(len, seqs), np.intp, len(seqs))
        self.p, self.order = p, np.argsort(lengths, kind="stable")
        self.place = np.argsort(self.order)
        self.lengths, at = np.unique(lengths[self.order], return_index=True)
        self.bounds = dict(zip(self.lengths.tolist(), zip(at.tolist(), [*at[1:].tolist(), len(seqs)], strict=True), strict=True))
        self.codes = {n: letters([seqs[i] for i in self.order[a:b]], n) for n, (a, b) in self.bounds.items() if n}
        keys = [tuple(x) for x in sets]
        self.sets = sorted(set(keys))
        number = {x: i for i, x in enumerate(self.sets)}
        self.set_of = np.fromiter((number[keys[i]] for i in self.order), np.intp, len(keys))
        self.length_of = lengths[self.order]
        self.least = 6 if p.trim_cdr3s else 2

    def part(self, n1: int, n: int) -> np.ndarray:
        """Triples of the rows of length ``n1`` where the shorter loop has length ``n``."""
        return triples(core(self.codes[n1], n, gap_place(n), self.p.trim_cdr3s))


class References(Chain):
    """A chain of the references, asked by one query after another."""

    def __init__(self, queries: Chain, seqs: list[str], sets: list, vdist: dict | None, p: DistanceParams):
        super().__init__(seqs, sets if vdist is not None else [()] * len(seqs), p)
        self.queries, self.vdist, self.table = queries, vdist, triple_table(p.weight_cdr3_region)
        self.class_of = np.searchsorted(self.lengths, self.length_of) * len(self.sets) + self.set_of
        empty = np.array([vdist is not None and not x for x in self.sets])
        self.bad = np.flatnonzero((self.length_of < self.least) | (empty[self.set_of] if len(self.sets) else False))
        widest, v = float(TABLE.max()) * p.weight_cdr3_region, max(vdist.values(), default=0) if vdist else 0
        compared = lambda n: max(0, n - 5 if p.trim_cdr3s else n)
        spans = [widest * compared(min(a, b)) + p.gap_penalty_cdr3_region * abs(a - b) for a in queries.lengths.tolist() for b in self.lengths.tolist()]
        self.cells = int(max(spans, default=0) + v) + 2
        self.kind = np.uint8 if self.cells <= 255 and self.table.dtype == np.uint8 else np.uint16
        self.segments, self.parts, self.classes = {}, {}, {}
        self.small = np.empty(len(seqs), self.table.dtype)

    def _segments(self, n1: int) -> list[tuple[int, int, int, np.ndarray]]:
        """(start, stop, n, triples) of references whose comparison with loops of length ``n1`` is alike."""
        if n1 not in self.segments:
            out, longer = [], []
            for n2, (a, b) in self.bounds.items():
                if n2 >= self.least:
                    (longer if n2 >= n1 else out).append((a, b, min(n1, n2), self.part(n2, min(n1, n2))))
            if longer:
                out.append((longer[0][0], longer[-1][1], n1, np.concatenate([x[3] for x in longer], 1)))
            self.segments[n1] = out
            self.parts[n1] = {n: self.queries.part(n1, n) for _, _, n, _ in out}
        return self.segments[n1]

    def _class_distances(self, n1: int, number: int) -> np.ndarray:
        """Gaps and V distances of a query to each (length, gene set) of the references."""
        if (n1, number) not in self.classes:
            v = np.zeros(len(self.sets))
            if self.vdist is not None:
                own = self.queries.sets[number]
                v = np.array([min((self.vdist[g, h] for g in own for h in x), default=0) for x in self.sets])
            self.classes[n1, number] = (self.p.gap_penalty_cdr3_region * np.abs(self.lengths - n1)[:, None] + v[None, :]).ravel().astype(self.kind)
        return self.classes[n1, number]

    def distances(self, row: int, out: np.ndarray) -> None:
        """Distances of the query at place ``row`` of its chain to all references by length; the last cell where there is none."""
        n1, number = int(self.queries.length_of[row]), int(self.queries.set_of[row])
        if n1 < self.least or (self.vdist is not None and not self.queries.sets[number]):
            out[:] = self.cells - 1
            return
        np.take(self._class_distances(n1, number), self.class_of, out=out, mode="wrap")
        i = row - self.queries.bounds[n1][0]
        for a, b, n, codes in self._segments(n1):
            own = self.parts[n1][n][:, i]
            for k, slot in enumerate(codes):
                np.take(self.table[own[k]], slot, out=self.small[a:b], mode="wrap")
                out[a:b] += self.small[a:b]
        if len(self.bad):
            out[self.bad] = self.cells - 1


def counted(q: dict, r: dict, vdist: dict[str, dict], p: DistanceParams, *, other_subjects: bool, batch: int = 512, both_only: bool = False):
    """Yields (rows, chains, counts): how many references have each distance 0, 1, .. to each query of a batch, or nothing
    if the distances spread too wide.

    ``q`` and ``r`` hold ``clone_id``, ``subject``, ``cdr3a``, ``cdr3b`` and the sets ``va_genes``, ``vb_genes``. A query does not meet
    rows of its own id, nor those of its subject if ``other_subjects``. With ``both_only`` chains A and B are not counted by themselves.
    """
    ask, refs = {}, {}
    for c in "ab":
        ask[c] = Chain(q[f"cdr3{c}"], q[f"v{c}_genes"] if vdist else [()] * len(q["clone_id"]), p)
        refs[c] = References(ask[c], r[f"cdr3{c}"], r[f"v{c}_genes"], vdist[c.upper()] if vdist else None, p)
    a, b = refs["a"], refs["b"]
    bytes_ = a.kind == b.kind == np.uint8
    width = 256 if bytes_ else b.cells
    if a.cells * width > MOST_CELLS:
        return
    # all is counted in the order of chain A
    b_place = b.place[a.order]
    ids, subjects = np.asarray(r["clone_id"])[a.order], np.asarray(r["subject"])[a.order]
    by_id = np.argsort(ids, kind="stable")
    first, last = (np.searchsorted(ids[by_id], q["clone_id"], side) for side in ("left", "right"))
    own: dict = {}
    n, none = len(ids), a.cells * width  # the last cell is for rows that a query does not meet
    da, db, turned = np.empty(n, a.kind), np.empty(n, b.kind), np.empty(n, b.kind)
    cell = np.empty(n, "<u2" if bytes_ else np.intp)
    # both distances as the bytes of one number, where they fit
    low, high = (cell.view(np.uint8)[0::2], cell.view(np.uint8)[1::2]) if bytes_ else (None, None)
    slanted = np.zeros((a.cells, width + a.cells), np.int64)
    # sums of both, a cell more for rows that a query does not meet
    sums, most = np.empty(n, np.uint16), a.cells + b.cells
    lacking = np.union1d(a.bad, np.argsort(b_place)[b.bad])
    known = np.ones(len(q["clone_id"]), bool)
    for x in ask.values():
        known &= ((x.length_of >= x.least) & (np.array([bool(y) for y in x.sets])[x.set_of] if vdist else True))[x.place]
    # queries of like loops follow each other
    order = np.lexsort((ask["b"].place, ask["a"].length_of[ask["a"].place]))
    for start in range(0, len(order), batch):
        rows = order[start : start + batch]
        out = {} if both_only else {"A": np.empty((len(rows), a.cells - 1), np.int64), "B": np.empty((len(rows), b.cells - 1), np.int64)}
        out["AB"] = np.empty((len(rows), a.cells + b.cells - 3), np.int64)
        for k, i in enumerate(rows.tolist()):
            a.distances(ask["a"].place[i], da)
            b.distances(ask["b"].place[i], db)
            np.take(db, b_place, out=turned, mode="wrap")
            if both_only:
                np.add(da, turned, out=sums, dtype=np.uint16)
                if other_subjects:
                    s = q["subject"][i]
                    if s not in own:
                        own[s] = np.flatnonzero(subjects == s)
                    sums[own[s]] = most
                sums[by_id[first[i] : last[i]]] = most
                sums[lacking] = most
                out["AB"][k] = np.bincount(sums, minlength=most + 1)[: most - 3] if known[i] else 0
                continue
            if bytes_:
                high[:], low[:] = da, turned
            else:
                np.multiply(da, width, out=cell, casting="unsafe", dtype=np.intp)
                cell += turned
            if other_subjects:
                s = q["subject"][i]
                if s not in own:
                    own[s] = np.flatnonzero(subjects == s)
                cell[own[s]] = none
            cell[by_id[first[i] : last[i]]] = none
            table = np.bincount(cell, minlength=none + 1)[: a.cells * width].reshape(a.cells, width)
            out["A"][k] = table.sum(1)[:-1]
            out["B"][k] = table.sum(0)[: b.cells - 1]
            # rows moved on by one each, so that a column holds one sum of both
            slanted[:-1, : b.cells - 1] = table[:-1, : b.cells - 1]
            out["AB"][k] = slanted.ravel()[: a.cells * (slanted.shape[1] - 1)].reshape(a.cells, -1).sum(0)[: a.cells + b.cells - 3]
        yield from ((rows, c, x) for c, x in out.items())
