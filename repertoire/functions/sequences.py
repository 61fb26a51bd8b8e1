"""Scalar functions of sequences, as column expressions that stay in the JVM, but for translation and gaps, which are looked up in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from repertoire.functions import tables


@dataclass(frozen=True)
class DistanceParams:
    """Weights of the receptor distance; ``parse`` reads ``name:value,name:value``."""

    gap_penalty_v_region: float = 4
    gap_penalty_cdr3_region: float = 12
    weight_v_region: float = 1
    weight_cdr3_region: float = 3
    align_cdr3s: bool = False
    trim_cdr3s: bool = True
    scale_factor: float = 1.0

    @classmethod
    def parse(cls, text: str | None) -> DistanceParams:
        kinds = {k: type(getattr(cls, k)) for k in cls.__dataclass_fields__}
        given = dict(x.split(":", 1) for x in text.split(",")) if text else {}
        unknown = set(given) - set(kinds)
        if unknown:
            raise ValueError(f"unknown distance parameters: {sorted(unknown)}")
        return cls(**{k: v == "True" if kinds[k] is bool else float(v) for k, v in given.items()})


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct of ``values``, each of which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def letters(s: Column) -> Column:
    """The characters of a string as an array."""
    return F.filter(F.split(s, ""), lambda x: x != "")


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "acgtwskmyrnACGTWSKMYRN.", "tgcawsmkrynTGCAWSMKRYN."))


@lru_cache(1)
def _codons() -> tuple[np.ndarray, np.ndarray]:
    """Numbers of bytes, the last for those of no codon, and the residue of any three numbers."""
    code = tables.genetic_code()
    alphabet = sorted({x for codon in code for x in codon} | {"#"})
    n = len(alphabet) + 1
    number = np.full(256, n - 1, np.intp)
    number[[ord(x) for x in alphabet]] = np.arange(n - 1)
    residue = np.full((n, n, n), ord("X"), np.uint8)
    for codon, x in code.items():
        residue[tuple(number[ord(c)] for c in codon)] = ord(x)
    at = number[ord("#")]
    residue[at], residue[:, at], residue[:, :, at] = ord("#"), ord("#"), ord("#")
    return number, residue


def translated(texts: pa.Array) -> pa.Array:
    """Proteins of texts in small letters, codons from the first letter on; a batch is looked up at once."""
    number, residue = _codons()
    sizes = np.nan_to_num(pc.utf8_length(texts).to_numpy(zero_copy_only=False)).astype(np.int64)
    joined = pc.binary_join(pa.array([texts.drop_null()], pa.list_(pa.string())), "")[0].as_py() or ""
    codes = number[np.frombuffer(joined.encode("ascii", "replace"), np.uint8)]
    n = sizes // 3
    ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    first = np.repeat(np.cumsum(sizes) - sizes, n) + 3 * (np.arange(ends[-1]) - np.repeat(ends[:-1], n))
    letters = residue[codes[first], codes[first + 1], codes[first + 2]]
    out = pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(letters.tobytes()))
    return pc.if_else(texts.is_valid(), out, None) if texts.null_count else out


@F.arrow_udf(StringType())
def _protein(texts: pa.Array) -> pa.Array:
    return translated(texts)


def translate_frame(s: Column, frame: int) -> Column:
    """Protein of a reading frame (1..3 forward, -1..-3 on the reverse complement); '#' codons stay '#'."""
    strand = F.lower(reverse_complement(s) if frame < 0 else s)
    return _protein(F.substring(strand, abs(frame), 1 << 30))


def bases_match(a: Column, b: Column) -> Column:
    """Whether two nucleotide symbols can be the same base."""
    table = tables.as_map({x: "".join(y for y in tables.IUPAC if tables.base_overlap(x, y)) for x in tables.IUPAC})
    x, y = F.lower(a), F.lower(b)
    return (x == y) | F.coalesce(F.contains(F.try_element_at(table, x), y), F.lit(False))


def mismatches(a: Column, b: Column) -> Column:
    """Positions of two sequences of equal length whose symbols cannot be the same base; null if lengths differ."""
    hits = F.filter(F.zip_with(letters(a), letters(b), bases_match), lambda ok: ~ok)
    return F.when(F.length(a) == F.length(b), F.size(hits))


def prefix_match_length(a: Column, b: Column, miss: int = -3) -> Column:
    """Length of the best-scoring common prefix (+1 a match, ``miss`` a mismatch; the longest of equal ones)."""
    pairs = F.slice(F.arrays_zip(letters(a).alias("x"), letters(b).alias("y")), F.lit(1), F.least(F.length(a), F.length(b)))
    start = F.struct(*[F.lit(0).alias(k) for k in ("score", "best", "at", "i")])

    def step(s, p):
        score = s["score"] + F.when(bases_match(p["x"], p["y"]), 1).otherwise(miss)
        better = score >= s["best"]
        return F.struct(score.alias("score"), F.greatest(score, s["best"]).alias("best"), F.when(better, s["i"] + 1).otherwise(s["at"]).alias("at"), (s["i"] + 1).alias("i"))

    return F.aggregate(pairs, start, step, lambda s: s["at"])


def residue_sum(s: Column, table: dict[str, float], sign: float = 1.0) -> Column:
    """Sum of a residue table over a sequence; residues that it lacks count 0."""
    values = tables.as_map({k: sign * v for k, v in table.items()})
    return F.aggregate(letters(s), F.lit(0.0), lambda t, x: t + F.coalesce(F.try_element_at(values, x), F.lit(0.0)))


def character_distance(a: Column, b: Column, gap_penalty: float) -> Column:
    """Distance of two aligned characters: gaps '.', stops '*'."""
    blank = lambda x: x.isin(".", "*")
    table = tables.as_map({k: float(v) for k, v in tables.substitution_distance().items()})
    return F.when(a == b, 0.0).when(blank(a) | blank(b), float(gap_penalty)).otherwise(F.try_element_at(table, F.concat(a, b)))


def aligned_distance(a: Column, b: Column, gap_penalty: float) -> Column:
    """Sum of character distances of two aligned sequences."""
    each = F.zip_with(letters(a), letters(b), lambda x, y: character_distance(x, y, gap_penalty))
    return F.aggregate(each, F.lit(0.0), lambda t, x: t + x)


def _gapped(short: Column, long: Column, gap: Column, trim: bool) -> Column:
    """Substitution distance with ``gap`` residues before the gap, both ends trimmed."""
    head, tail = (3, 2) if trim else (0, 0)
    table = tables.as_map({k: float(v) for k, v in tables.substitution_distance().items()})
    n, m = F.length(short), F.length(long)
    first = F.sequence(F.lit(1), n)
    used = F.filter(first, lambda i: ((i > head) & (i <= gap)) | ((i > gap) & (i <= n - tail)))
    pair = lambda i: F.concat(F.substr(short, i, F.lit(1)), F.substr(long, F.when(i <= gap, i).otherwise(i + m - n), F.lit(1)))
    return F.aggregate(used, F.lit(0.0), lambda t, i: t + F.try_element_at(table, pair(i)))


def cdr3_distance(a: Column, b: Column, params: DistanceParams = DistanceParams()) -> Column:
    """Weighted distance of two CDR3 loops: one gap at a fixed place, or at the best place if aligning."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    n = F.length(short)
    if params.align_cdr3s:
        low, high = F.lit(5), n - 5
        back = F.greatest(F.lit(0), F.ceil((low - high) / 2)).cast("int")
        best = F.array_min(F.transform(F.sequence(low - back, high + back), lambda g: _gapped(short, long, g, params.trim_cdr3s)))
    else:
        best = _gapped(short, long, F.least(F.lit(6), F.lit(3) + F.floor((n - 5) / 2).cast("int")), params.trim_cdr3s)
    return params.weight_cdr3_region * best + params.gap_penalty_cdr3_region * F.abs(F.length(a) - F.length(b))


@lru_cache(1)
def _blosum() -> np.ndarray:
    """Scores of any two bytes, far below all others where a letter has none."""
    out = np.full((256, 256), -(1 << 20), np.int64)
    for k, v in tables.blosum62().items():
        out[ord(k[0]), ord(k[1])] = v
    return out


def gapped(a: list[str | None], b: list[str | None], gap: str) -> list[str | None]:
    """The shorter sequence of each pair with its run of gaps; pairs of like lengths are scored at once."""
    out: list[str | None] = [None] * len(a)
    alike: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x is not None and y is not None:
            alike.setdefault((len(x), len(y)), []).append(i)
    codes = lambda seqs, n: np.frombuffer("".join(seqs).encode("latin-1", "replace"), np.uint8).reshape(len(seqs), n)
    for (m, k), at in alike.items():
        pick = (lambda x, y: (x, y)) if m <= k else (lambda x, y: (y, x))
        pairs = [pick(a[i], b[i]) for i in at]
        n, d = min(m, k), abs(m - k)
        places = np.ones(len(at), np.int64)
        if n > 1 and d:
            short, long = codes([p[0] for p in pairs], n), codes([p[1] for p in pairs], n + d)
            before, behind = _blosum()[short, long[:, :n]].cumsum(1), _blosum()[short, long[:, d:]].cumsum(1)
            score = before[:, :-1] + behind[:, -1:] - behind[:, :-1]
            # a pair without a score counts for nothing else
            places = np.where(score < -(1 << 19), -(1 << 19), score).argmax(1) + 1
        for i, (s, _), g in zip(at, pairs, places.tolist(), strict=True):
            out[i] = s[:g] + gap * d + s[g:] if d else s
    return out


def align_with_gap(a: Column, b: Column, gap: str = ".") -> Column:
    """The shorter sequence with one run of gaps where the substitution score is best (the first of equal ones)."""

    @F.arrow_udf(StringType())
    def align(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(gapped(x.to_pylist(), y.to_pylist(), gap), pa.string())

    return align(a, b)


def gene_of_allele(gene: Column) -> Column:
    return F.substring_index(gene, "*", 1)


def gene_number(gene: Column) -> Column:
    """The first number in a gene name, 0 if none."""
    found = F.regexp_extract(gene, r"(\d+)", 1)
    return F.when(found == "", 0).otherwise(found.cast("int"))


def top_hits(hits: Column) -> Column:
    """Genes with the highest score of a ``gene:score;gene:score`` string, sorted, once each; entries without a score are left out."""
    each = F.transform(F.split(hits, ";"), lambda x: F.struct(F.substring_index(x, ":", 1).alias("gene"), F.get(F.split(x, ":"), F.lit(1)).try_cast("int").alias("score")))
    best = F.array_max(F.transform(each, lambda x: x["score"]))
    return F.array_sort(F.array_distinct(F.transform(F.filter(each, lambda x: x["score"] == best), lambda x: x["gene"])))


def least_quality(quals: Column) -> Column:
    """Smallest of '.'-joined qualities."""
    return F.array_min(F.transform(F.split(quals, r"\."), lambda q: q.cast("int")))


def safe_log10(p: Column, floor: float = -100.0) -> Column:
    return F.when(p > 0, F.log10(p)).otherwise(F.lit(floor))


def truncated_log10(p: Column, floor: int = -99) -> Column:
    return F.when(p > 0, F.log10(p).cast("int")).otherwise(F.lit(floor))


def z_score(x: Column, mean: Column, sdev: Column) -> Column:
    return F.when(sdev == 0, F.lit(0.0)).otherwise((x - mean) / sdev)


def safe_inverse(p: Column) -> Column:
    return F.when(p == 0, F.lit(0.0)).otherwise(1.0 / p)


def pad_middle(s: Column, width: int) -> Column:
    left = F.floor((F.lit(width) - F.length(s)) / 2).cast("int")
    return F.when(F.length(s) >= width, s).otherwise(F.rpad(F.concat(F.repeat(F.lit(" "), left), s), F.lit(width), F.lit(" ")))


def strip_line_end(s: Column) -> Column:
    return F.regexp_replace(s, r"[\r\n ]+$", "")
