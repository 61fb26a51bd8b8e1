"""Fixed biochemical tables, and Spark literals made from them."""

from __future__ import annotations

from functools import cache
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"

# fixed values: the BLOSUM62 substitution scores (lower triangle, in the usual order of residues)
_BLOSUM_ORDER = "ARNDCQEGHILKMFPSTWYV"
_BLOSUM62 = """
 4
-1  5
-2  0  6
-2 -2  1  6
 0 -3 -3 -3  9
-1  1  0  0 -3  5
-1  0  0  2 -4  2  5
 0 -2  0 -1 -3 -2 -2  6
-2  0  1 -1 -3  0  0 -2  8
-1 -3 -3 -3 -1 -3 -3 -4 -3  4
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""

# fixed values: the standard genetic code, codons in the order t, c, a, g of each base
_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

# fixed values: bases that a nucleotide symbol stands for
IUPAC = {"a": "a", "c": "c", "g": "g", "t": "t", "w": "at", "s": "cg", "k": "gt", "m": "ac", "y": "ct", "r": "ag", "n": "acgt"}

# fixed values: hydrophobicity scales and charges of residues
GES = {"F": -3.7, "M": -3.4, "I": -3.1, "L": -2.8, "V": -2.6, "C": -2.0, "W": -1.9, "A": -1.6, "T": -1.2, "G": -1.0,
       "S": -0.6, "P": 0.2, "Y": 0.7, "H": 3.0, "Q": 4.1, "N": 4.8, "E": 8.2, "K": 8.8, "D": 9.2, "R": 12.3}
HP = {"I": 0.73, "F": 0.61, "V": 0.54, "L": 0.53, "W": 0.37, "M": 0.26, "A": 0.25, "G": 0.16, "C": 0.04, "Y": 0.02,
      "P": -0.07, "T": -0.18, "S": -0.26, "H": -0.40, "E": -0.62, "N": -0.64, "Q": -0.69, "D": -0.72, "K": -1.10, "R": -1.76}
KD = {"A": 1.8, "C": 2.5, "E": -3.5, "D": -3.5, "G": -0.4, "F": 2.8, "I": 4.5, "H": -3.2, "K": -3.9, "M": 1.9,
      "L": 3.8, "N": -3.5, "Q": -3.5, "P": -1.6, "S": -0.8, "R": -4.5, "T": -0.7, "W": -0.9, "V": 4.2, "Y": -1.3}
CHARGE = {"K": 1.0, "R": 1.0, "D": -1.0, "E": -1.0}

# fixed values: residue groups of motif searches
RESIDUE_GROUPS = {"k": "[KR]", "d": "[DE]", "n": "[NQ]", "s": "[ST]", "f": "[FYWH]", "a": "[AGSP]", "v": "[VILM]"}


@cache
def blosum62() -> dict[str, int]:
    """Score of each two-letter pair."""
    out = {}
    for a, line in zip(_BLOSUM_ORDER, _BLOSUM62.strip("\n").split("\n"), strict=True):
        for b, v in zip(_BLOSUM_ORDER, line.split(), strict=False):
            out[a + b] = out[b + a] = int(v)
    return out


@cache
def substitution_distance() -> dict[str, int]:
    """0 for equal residues, else 4 less the score where that is positive."""
    return {k: 0 if k[0] == k[1] else 4 - max(0, v) for k, v in blosum62().items()}


@cache
def genetic_code() -> dict[str, str]:
    """Residue of each codon, ambiguous ones included: X unless all readings agree."""
    plain = dict(zip(map("".join, product("tcag", repeat=3)), _CODE, strict=True))
    out = {}
    for codon in map("".join, product(IUPAC, repeat=3)):
        found = {plain["".join(c)] for c in product(*(IUPAC[x] for x in codon))}
        out[codon] = found.pop() if len(found) == 1 else "X"
    return out


def base_overlap(a: str, b: str) -> bool:
    return not set(IUPAC.get(a, a)).isdisjoint(IUPAC.get(b, b))


def as_map(table: dict) -> Column:
    """A constant map column."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
