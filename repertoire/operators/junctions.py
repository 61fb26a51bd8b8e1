"""Junctions between germline segments: analysis, generation probability, sampling.

Each function is row-wise: Arrow batches of (V germline, J germline, sequence) meet small probability
tables that travel with the task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from repertoire.functions import tables
from repertoire.operators.broadcasts import bounded

MISS_JUNCTION = -4
ERROR_SHARE = 0.05


@dataclass(frozen=True)
class TrimTables:
    """Probabilities of trims and insertions: lists by length, D trims by (d0, d1) for each D gene."""

    v_trim: list[float]
    j_trim: list[float]
    vj_insert: list[float] = field(default_factory=list)
    vd_insert: list[float] = field(default_factory=list)
    dj_insert: list[float] = field(default_factory=list)
    d_trim: dict[int, dict[tuple[int, int], float]] = field(default_factory=dict)
    d_genes: dict[int, str] = field(default_factory=dict)
    d_prob: dict[int, float] = field(default_factory=dict)

    @staticmethod
    def at(table: list[float], i: int) -> float:
        return table[i] if 0 <= i < len(table) else 0.0


def prefix_matches(a: str, b: str, miss: float) -> int:
    """Length of the best-scoring common prefix, the longest of equal ones."""
    n = min(len(a), len(b))
    if not n:
        return 0
    step = np.array([1.0 if x == y or tables.base_overlap(x, y) else miss for x, y in zip(a[:n], b[:n], strict=True)])
    score = np.concatenate(([0.0], np.cumsum(step)))
    return int(np.flatnonzero(score == max(0.0, score.max()))[-1])


def split_junction(v: str, j: str, nuc: str, d_genes: dict[int, str] | None = None) -> dict:
    """Parts of a junction: kept germline at both ends, the longest D substring between, insertions."""
    keep_v = prefix_matches(v, nuc, MISS_JUNCTION)
    keep_j = prefix_matches(j[::-1], nuc[::-1], MISS_JUNCTION)
    extra = max(0, keep_v + keep_j - len(nuc))
    keep_v, keep_j = keep_v - extra // 2, keep_j - (extra - extra // 2)
    middle = nuc[keep_v : len(nuc) - keep_j]
    source = "V" * keep_v + "N" * len(middle) + "J" * keep_j
    out = {"v_trim": len(v) - keep_v, "j_trim": len(j) - keep_j, "insert": len(middle), "d_id": 0, "d0_trim": 0, "d1_trim": 0, "vd_insert": 0, "dj_insert": 0}
    best = (0, 0, 0, 0, 0)
    for d_id, d in sorted((d_genes or {}).items()):
        for length in range(min(len(d), len(middle)), best[0], -1):
            hit = next(((s, middle.find(d[s : s + length])) for s in range(len(d) - length + 1) if d[s : s + length] in middle), None)
            if hit:
                best = (length, d_id, hit[0], len(d) - hit[0] - length, hit[1])
                break
    if best[0]:
        length, d_id, d0, d1, at = best
        out |= {"d_id": d_id, "d0_trim": d0, "d1_trim": d1, "vd_insert": at, "dj_insert": len(middle) - at - length}
        source = source[: keep_v + at] + "D" * length + source[keep_v + at + length :]
    out["source"] = source
    out["new_nuc"] = "".join("+" if s == "D" else c for c, s in zip(middle, source[keep_v : len(nuc) - keep_j], strict=True))
    return out


def split_n_regions(source: str) -> str:
    """N left of the first D becomes 1 (V-D), right of it 2 (D-J)."""
    at = source.find("D")
    return source if at < 0 else source[:at].replace("N", "1") + source[at:].replace("N", "2")


def masked_protein(protein: str, source: str) -> str:
    """Residues with two or three new bases in capitals, one in small, none as '-'."""
    new = [sum(s == "N" for s in source[3 * i : 3 * i + 3]) for i in range(len(protein))]
    return "".join(a if n > 1 else a.lower() if n == 1 else "-" for a, n in zip(protein, new, strict=True))


def analyze_junctions(rows: DataFrame, d_genes: dict[int, str] | None = None) -> DataFrame:
    """Adds the junction fields to rows with columns v_nuc, j_nuc, nuc and protein."""
    fields = ["v_trim", "j_trim", "insert", "d_id", "d0_trim", "d1_trim", "vd_insert", "dj_insert"]

    def run(batches):
        for b in batches:
            cols = {n: b.column(n).to_pylist() for n in ("v_nuc", "j_nuc", "nuc", "protein")}
            found = [split_junction(v, j, n, d_genes) for v, j, n in zip(cols["v_nuc"], cols["j_nuc"], cols["nuc"], strict=True)]
            more = [pa.array([f[k] for f in found], pa.int32()) for k in fields]
            more += [pa.array([f[k] for f in found], pa.string()) for k in ("source", "new_nuc")]
            more.append(pa.array([masked_protein(p, f["source"]) for p, f in zip(cols["protein"], found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *fields, "source", "new_nuc", "masked"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + "".join(f", {k} int" for k in fields) + ", source string, new_nuc string, masked string"
    return rows.mapInArrow(run, schema)


@lru_cache(maxsize=100_000)
def coding_share(pattern: str, residue: str) -> float:
    """Share of the readings of a codon with unknown bases 'n' that code for a residue."""
    code = tables.genetic_code()
    hits = sum(1 for c, aa in code.items() if aa == residue and set(c) <= set("acgt") and all(p == "n" or tables.base_overlap(x, p) for x, p in zip(c, pattern, strict=True)))
    return hits / 4 ** pattern.count("n")


def coding_probability(nuc: str, protein: str) -> float:
    out = 1.0
    for i, a in enumerate(protein):
        out *= coding_share(nuc[3 * i : 3 * i + 3], a)
        if not out:
            break
    return out


def _longest_coding_prefix(germline: str, protein: str, backwards: bool) -> int:
    """Germline bases that some coding of the protein can keep, from its start (or end)."""
    g = germline[::-1] if backwards else germline
    p = protein[::-1] if backwards else protein
    keep = 0
    while keep < min(len(g), 3 * len(p)):
        part = g[3 * (keep // 3) : keep + 1]
        pattern = ("n" * (3 - len(part)) + part[::-1]) if backwards else part + "n" * (3 - len(part))
        if not coding_share(pattern, p[keep // 3]):
            break
        keep += 1
    return keep


def generation_probability(v: str, j: str, protein: str, t: TrimTables, nuc: str | None = None) -> float:
    """Chance that trims and insertions at a V-J (or V-D-J) junction make a protein or an exact sequence.

    Layers of equal extra trimming are added until one adds less than ``ERROR_SHARE`` of the sum so far
    (not before the fourth).
    """
    n = 3 * len(protein) if nuc is None else len(nuc)
    if nuc is None:
        most_v, most_j = _longest_coding_prefix(v, protein, False), _longest_coding_prefix(j, protein, True)
    else:
        most_v, most_j = prefix_matches(v, nuc, MISS_JUNCTION), prefix_matches(j[::-1], nuc[::-1], MISS_JUNCTION)
    middle = n - most_v - most_j
    total = 0.0
    for extra in range(max(0, -middle), most_v + most_j + 1):
        layer = 0.0
        for cut in range(extra + 1):
            keep_v, keep_j = most_v - cut, most_j - (extra - cut)
            if keep_v < 0 or keep_j < 0:
                continue
            weight = t.at(t.v_trim, len(v) - keep_v) * t.at(t.j_trim, len(j) - keep_j)
            if weight:
                layer += weight * _middle(v[:keep_v], j[len(j) - keep_j :], middle + extra, protein, t, nuc)
        before, total = total, total + layer
        if extra - max(0, -middle) > 2 and layer < ERROR_SHARE * before:
            break
    return total


def _middle(left: str, right: str, size: int, protein: str, t: TrimTables, nuc: str | None) -> float:
    if not t.d_genes:
        share = 0.25**size if nuc is not None else coding_probability(left + "n" * size + right, protein)
        return t.at(t.vj_insert, size) * share
    total = 0.0
    for d_id, d in t.d_genes.items():
        for (d0, d1), p in t.d_trim.get(d_id, {}).items():
            kept = d[d0 : len(d) - d1] if d0 + d1 <= len(d) else None
            if kept is None or len(kept) > size or not p:
                continue
            for vd in range(size - len(kept) + 1):
                dj = size - len(kept) - vd
                weight = t.d_prob.get(d_id, 0.0) * p * t.at(t.vd_insert, vd) * t.at(t.dj_insert, dj)
                if not weight:
                    continue
                if nuc is not None:
                    share = 0.25 ** (vd + dj) * (nuc[len(left) + vd : len(left) + vd + len(kept)] == kept)
                else:
                    share = coding_probability(left + "n" * vd + kept + "n" * dj + right, protein)
                total += weight * share
    return total


def with_probability(rows: DataFrame, t: TrimTables, out: str = "probability") -> DataFrame:
    """Adds the generation probability of ``protein`` for rows with columns v_nuc, j_nuc and protein.
    Equal (v_nuc, j_nuc, protein) are worked out once."""
    keys = ["v_nuc", "j_nuc", "protein"]

    def run(batches):
        for b in batches:
            p = [generation_probability(v, j, a, t) for v, j, a in zip(*(b.column(k).to_pylist() for k in keys), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*keys, out])

    once = rows.select(*keys).distinct().mapInArrow(run, f"v_nuc string, j_nuc string, protein string, {out} double")
    return rows.join(once, keys)


#: A V or J gene loses at most so many bases, and keeps at least a codon; a junction gets at most so many D-J inserts.
MOST_TRIM, LEAST_KEPT, MOST_DJ_INSERT = 15, 3, 10
#: Draws of a wave, at least.
WAVE = 64
_BASES = np.frombuffer(b"acgt", np.uint8)


def _codes(seq: str) -> np.ndarray:
    return np.searchsorted(_BASES, np.frombuffer(seq.lower().encode(), np.uint8)).astype(np.int8)


def _residues() -> np.ndarray:
    code = tables.genetic_code()
    return np.frombuffer("".join(code[a + b + c] for a in "acgt" for b in "acgt" for c in "acgt").encode(), np.uint8)


def _drawn(g: np.random.Generator, table: list[float] | np.ndarray, n: int) -> np.ndarray:
    """n places of a table of probabilities, by its cumulated sums."""
    cumulated = np.cumsum(table)
    return np.searchsorted(cumulated, g.random(n) * cumulated[-1], "right")


class _Segments:
    """The parts of the junctions of one V and J gene, and draws of them in arrays."""

    def __init__(self, v: str, j: str, j_name: str, t: TrimTables):
        self.v, self.j, self.t = _codes(v), _codes(j), t
        # the first J cluster lies before the second D gene, which it cannot take
        first_only = re.match(r"TRBJ1", j_name) is not None and 1 in t.d_genes
        self.d_ids = [1] if first_only else sorted(t.d_genes)
        self.d = [_codes(t.d_genes[i]) for i in self.d_ids]

    def wave(self, g: np.random.Generator, n: int, aa_length: int | None, most_dj: int):
        """(codes, length, parts' ends) of those of n draws that are in frame, within the limits and without stops."""
        t = self.t
        vt, jt = _drawn(g, t.v_trim, n), _drawn(g, t.j_trim, n)
        ok = (vt <= min(MOST_TRIM, len(self.v) - LEAST_KEPT)) & (jt <= min(MOST_TRIM, len(self.j) - LEAST_KEPT))
        which = start = kept = dj = np.zeros(n, np.int64)
        if self.d_ids:
            which = _drawn(g, [t.d_prob[i] for i in self.d_ids], n)
            trims = [sorted(t.d_trim[i]) for i in self.d_ids]
            pick = np.stack([_drawn(g, [t.d_trim[i][x] for x in own], n) for i, own in zip(self.d_ids, trims, strict=True)])
            pairs = [np.array(own) for own in trims]
            start = np.choose(which, [p[k, 0] for p, k in zip(pairs, pick, strict=True)])
            end = np.choose(which, [p[k, 1] for p, k in zip(pairs, pick, strict=True)])
            kept = np.array([len(d) for d in self.d])[which] - start - end
            first, dj = _drawn(g, t.vd_insert, n), _drawn(g, t.dj_insert, n)
            ok &= (kept >= 0) & (dj <= most_dj)
        else:
            first = _drawn(g, t.vj_insert, n)
        kept = np.maximum(kept, 0)
        ends = np.cumsum([len(self.v) - vt, first, kept, dj, len(self.j) - jt], 0)
        ok &= (ends[-1] % 3 == 0) & (ends[-1] > 0) & ((ends[-1] == 3 * aa_length) if aa_length else True)
        widest = 3 * max(1, int(ends[-1][ok].max(initial=0)) // 3)
        free = g.integers(0, 4, (n, widest), dtype=np.int8)
        some = np.flatnonzero(ok)
        ends, at = ends[:, some, None], np.arange(widest)[None, :]
        take = lambda seq, i: seq[np.clip(i, 0, len(seq) - 1)]
        d = np.stack([np.pad(x, (0, max(map(len, self.d)) - len(x))) for x in self.d]) if self.d_ids else np.zeros((1, 1), np.int8)
        middle = d[which[some, None], np.clip(at - ends[1] + start[some, None], 0, d.shape[1] - 1)]
        codes = np.where(at < ends[0], take(self.v, at), np.where((at >= ends[1]) & (at < ends[2]), middle, free[some]))
        codes = np.where(at >= ends[3], take(self.j, at - ends[3] + jt[some, None]), codes)
        codons = codes.reshape(len(some), -1, 3).astype(np.int64)
        residues = _residues()[codons @ np.array([16, 4, 1])]
        stops = ((residues == ord("*")) & (np.arange(residues.shape[1]) < ends[-1] // 3)).any(1)
        clean = np.flatnonzero(~stops)
        return codes[clean], residues[clean], ends[:, clean, 0]


def sample_junctions(
    genes: DataFrame, t: TrimTables, per_pair: int, seed: int = 1, max_tries: int = 100_000, *, aa_length: int | None = None, most_dj_insert: int = MOST_DJ_INSERT
) -> DataFrame:
    """(v, j, n, nuc, protein, source): random in-frame junctions without stops for each (v, v_nuc, j, j_nuc), of ``aa_length``
    residues if it is given; ``source`` says V, N, D or J of each base.

    Trims are at most ``MOST_TRIM`` and leave a codon, D-J inserts at most ``most_dj_insert``; genes of the first
    J cluster (TRBJ1) take the first D gene only. Draws come in waves of arrays, and what is rejected is drawn again in
    the next one, until there are enough or ``max_tries`` draws. Each gene pair has a generator of its own, seeded by the
    pair's names: the same on any partitioning.
    """

    def run(batches):
        for b in batches:
            rows = []
            for v, vn, j, jn in zip(*(b.column(c).to_pylist() for c in ("v", "v_nuc", "j", "j_nuc")), strict=True):
                g, parts = np.random.default_rng([seed, *f"{v}|{j}".encode()]), _Segments(vn, jn, j, t)
                done, tries, taken = 0, 0, 0
                while done < per_pair and tries < max_tries:
                    n = int(min(max_tries - tries, max(WAVE, (per_pair - done) * 1.2 * (tries + 1) / (taken + 1))))
                    codes, residues, ends = parts.wave(g, n, aa_length, most_dj_insert)
                    tries, taken = tries + n, taken + len(codes)
                    for c, r, e in zip(codes[: per_pair - done], residues, ends.T, strict=False):
                        size = np.diff(e, prepend=0)
                        source = "".join(x * k for x, k in zip("VNDNJ", size.tolist(), strict=True))
                        rows.append((v, j, done, _BASES[c[: e[-1]]].tobytes().decode(), r[: e[-1] // 3].tobytes().decode(), source))
                        done += 1
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names=["v", "j", "n", "nuc", "protein", "source"])

    return genes.select("v", "v_nuc", "j", "j_nuc").mapInArrow(run, "v string, j string, n int, nuc string, protein string, source string")


def length_distribution(rows: DataFrame, tag: str, weight: str | None = None, cap: int = 20) -> DataFrame:
    """(length, p) of a trim or insertion column, optionally weighted, lengths capped."""
    w = F.col(weight) if weight else F.lit(1.0)
    counts = rows.groupBy(F.least(F.col(tag), F.lit(cap)).alias("length")).agg(F.sum(w).alias("n"))
    return counts.select("length", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("p"))


def tied_distribution(rows: DataFrame, ties: str, tag: str, weight: str | None = None, cap: int = 20) -> DataFrame:
    """(ties, length, p): the distribution of a trim or insertion for each D gene, where a row with n equally good D genes (array
    ``ties``) counts 1/n for each; optionally weighted, lengths capped."""
    w = F.col(weight) if weight else F.lit(1.0)
    each = rows.select(F.explode(ties).alias(ties), F.least(F.col(tag), F.lit(cap)).alias("length"), (w / F.size(ties)).alias("w"))
    counts = each.groupBy(ties, "length").agg(F.sum("w").alias("n"))
    return counts.select(ties, "length", (F.col("n") / F.sum("n").over(Window.partitionBy(ties))).alias("p"))


def average_distributions(files: DataFrame) -> DataFrame:
    """(tag, key, p) of (file, tag, key, p): sums over files, normalised by tag."""
    sums = files.groupBy("tag", "key").agg(F.sum("p").alias("p"))
    return sums.select("tag", "key", (F.col("p") / F.sum("p").over(Window.partitionBy("tag"))).alias("p"))


def pseudo_probabilities(files: DataFrame) -> DataFrame:
    """(rep, p) of (file, rep, p): the mean of two files, else the median, files without the gene as 0;
    divided by the total where that is below 1."""
    n = files.select("file").distinct()
    grid = files.select("rep").distinct().join(bounded(n)).join(files, ["file", "rep"], "left").fillna(0.0, ["p"])
    k = F.count(F.lit(1))
    each = grid.groupBy("rep").agg(F.when(k <= 2, F.avg("p")).otherwise(F.median("p")).alias("p"))
    return each.select("rep", (F.col("p") / F.least(F.lit(1.0), F.sum("p").over(Window.partitionBy(F.lit(0))))).alias("p"))


def protein_probability(rows: DataFrame, reps: DataFrame, genes: str, junction: str, out: str) -> DataFrame:
    """Adds the largest pseudo-probability of a row's ambiguous genes times its junction's probability.

    The largest is found once for each distinct set of genes; no row is exploded.
    """
    sets = rows.select(genes).distinct().select(genes, F.explode(genes).alias("rep"))
    best = sets.join(reps, "rep", "left").groupBy(genes).agg(F.max(F.coalesce("p", F.lit(0.0))).alias("__g"))
    return rows.join(best, genes, "left").withColumn(out, F.coalesce("__g", F.lit(0.0)) * F.col(junction)).drop("__g")


#: Share of the chance of keeping one base of a D gene that trimming it away gets.
TOTAL_TRIM = 0.75


def with_total_d_trims(trims: DataFrame, d_genes: DataFrame) -> DataFrame:
    """(d, d0, d1, p) of D trims with a chance of trimming a gene away: three quarters of the chance that one base
    is left, all of it at (0, length), then normalised. ``d_genes``: (d, length), a dimension."""
    rows = trims.join(bounded(d_genes), "d")
    one = F.sum(F.when(F.col("d0") + F.col("d1") == F.col("length") - 1, F.col("p")).otherwise(0.0))
    gone = rows.groupBy("d", "length").agg((one * TOTAL_TRIM).alias("p")).select("d", F.lit(0).alias("d0"), F.col("length").alias("d1"), "p")
    kept = rows.where(F.col("d0") + F.col("d1") != F.col("length")).select("d", F.col("d0").cast("int").alias("d0"), F.col("d1").cast("int").alias("d1"), "p")
    every = kept.unionByName(gone)
    return every.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("d")))


def average_over_d(trims: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p): the mean over D genes of a distribution (d, keys, p), 0 for a gene without the key."""
    n = trims.select("d").distinct().agg(F.count(F.lit(1)).alias("__n"))
    sums = trims.groupBy(*keys).agg(F.sum("p").alias("p"))
    return sums.join(bounded(n.withColumn("__k", F.lit(1))), F.lit(1) == F.col("__k")).select(*keys, (F.col("p") / F.col("__n")).alias("p"))


def _shuffled(seq: str | None, key: str | None, mark: str) -> str | None:
    if seq is None:
        return None
    start = "" if key is None else f"{key}:"
    pool = iter(sorted((md5(f"{start}{i}".encode()).hexdigest(), x) for i, x in enumerate(seq.replace(mark, ""))))
    return "".join(x if x == mark else next(pool)[1] for x in seq)


def shuffled_letters(seq: Column, key: Column, mark: str = "+") -> Column:
    """A sequence with its letters in an order that a hash of (key, place) gives; marks stay where they are."""

    @F.arrow_udf(StringType())
    def shuffle(s: pa.Array, k: pa.Array) -> pa.Array:
        return pa.array([_shuffled(x, y, mark) for x, y in zip(s.to_pylist(), k.to_pylist(), strict=True)], pa.string())

    return shuffle(seq, key.cast("string"))
