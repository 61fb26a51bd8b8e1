"""Hand-checked and brute-force cases of the scalar functions and distances."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from repertoire.functions import sequences as seq
from repertoire.functions import tables
from repertoire.operators import distance

rng = random.Random(1)


def one(spark, expr, **cells):
    return spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells)).select(expr.alias("x")).first().x


def brute_cdr3(a, b, align=False):
    short, long = sorted((a, b), key=len)
    n, d = len(short), len(long) - len(short)
    sub = tables.substitution_distance()

    def at(g):
        total = sum(sub[short[i] + long[i]] for i in range(3, g))
        return total + sum(sub[short[-1 - i] + long[-1 - i]] for i in range(2, n - g))

    if not align:
        best = at(min(6, 3 + (n - 5) // 2))
    else:
        low, high = 5, n - 5
        while low > high:
            low, high = low - 1, high + 1
        best = min(at(g) for g in range(low, high + 1))
    return 3 * best + 12 * d


def test_known_distances(spark):
    d = lambda a, b: one(spark, seq.cdr3_distance(F.col("a"), F.col("b")), a=a, b=b)
    assert d("CASSIRSSYEQYF", "CASSIRSSYEQYF") == 0
    assert d("CASSAAAYF", "CASSAAAAYF") == 12
    assert d("CASSIRSSYEQYF", "CASSARSSYEQYF") == 12


@pytest.mark.parametrize("align", [False, True])
def test_cdr3_distance_forms_agree(spark, align):
    words = ["C" + "".join(rng.choice(tables.AMINO_ACIDS) for _ in range(rng.randint(5, 16))) for _ in range(40)]
    pairs = [(a, b) for a in words[:20] for b in words[20:]]
    p = seq.DistanceParams(align_cdr3s=align)
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.d for r in df.select(seq.cdr3_distance(F.col("a"), F.col("b"), p).alias("d")).collect()]
    want = [brute_cdr3(a, b, align) for a, b in pairs]
    assert got == want
    block = distance._cdr3_block(words[:20], words[20:], p)
    assert block.ravel().tolist() == want


def test_params_parse():
    p = seq.DistanceParams.parse("gap_penalty_cdr3_region:8,align_cdr3s:True")
    assert p.gap_penalty_cdr3_region == 8 and p.align_cdr3s and seq.DistanceParams.parse(None) == seq.DistanceParams()
    with pytest.raises(ValueError):
        seq.DistanceParams.parse("nope:1")


def test_substitution_table_is_symmetric():
    b = tables.blosum62()
    assert len(b) == 400 and all(b[k] == b[k[::-1]] for k in b) and b["WW"] == 11 and b["IV"] == 3
    assert tables.substitution_distance()["IV"] == 1 and tables.substitution_distance()["AW"] == 4


def test_translation_and_bases(spark):
    assert one(spark, seq.translate_frame(F.col("a"), 1), a="atggcnntt#aatg") == "MAX#"
    assert one(spark, seq.translate_frame(F.col("a"), 1), a="at") == ""
    assert one(spark, seq.reverse_complement(F.col("a")), a="acgtnN") == "Nnacgt"
    assert one(spark, seq.mismatches(F.col("a"), F.col("b")), a="acgr", b="ttgg") == 2
    assert one(spark, seq.mismatches(F.col("a"), F.col("b")), a="acg", b="ac") is None
    assert one(spark, seq.prefix_match_length(F.col("a"), F.col("b")), a="acgtacgt", b="acgaacgt") == 8
    assert one(spark, seq.prefix_match_length(F.col("a"), F.col("b")), a="acgt", b="tttt") == 0


def test_text_helpers(spark):
    assert one(spark, seq.top_hits(F.col("a")), a="TRAV1:50;TRAV2:60;TRAV3:60") == ["TRAV2", "TRAV3"]
    assert one(spark, seq.gene_of_allele(F.col("a")), a="TRAV1-2*01") == "TRAV1-2"
    assert one(spark, seq.gene_number(F.col("a")), a="TRAV12-2") == 12
    assert one(spark, seq.pad_middle(F.col("a"), 7), a="abcd") == " abcd  "
    assert one(spark, seq.align_with_gap(F.col("a"), F.col("b")), a="CASF", b="CASSF").count(".") == 1
    assert one(spark, seq.least_quality(F.col("a")), a="40.7.33") == 7
    assert one(spark, seq.truncated_log10(F.col("a").cast("double")), a="0.005") == -2


def test_receptor_blocks_agree_with_expressions(spark):
    genes = spark.createDataFrame([("A", "VA1", "AC.D QW"), ("A", "VA2", "ACDD QY"), ("B", "VB1", "WW"), ("B", "VB2", "W.")], "chain string, gene string, loops string")
    rows = [(i, "e", i % 2, "CA" + "".join(rng.choice(tables.AMINO_ACIDS) for _ in range(5 + i % 3)), "CASSLGYF", ["VA1", "VA2"][: 1 + i % 2], ["VB2"]) for i in range(25)]
    clones = spark.createDataFrame(rows, "clone_id long, epitope string, subject int, cdr3a string, cdr3b string, va_genes array<string>, vb_genes array<string>")
    v = {(r.gene1, r.gene2): r.dist for r in distance.v_region_distances(genes).collect()}
    got = {(r.id1, r.id2): r.dist for r in distance.pairs_within(clones, genes, None).where("chains = 'AB'").collect()}
    for a in rows:
        for b in rows:
            if a[0] < b[0]:
                want = brute_cdr3(a[3], b[3]) + brute_cdr3(a[4], b[4]) + min(v[x, y] for x in a[5] for y in b[5]) + min(v[x, y] for x in a[6] for y in b[6])
                assert got[a[0], b[0]] == want
    small = distance.in_block_pairs(clones, clones.withColumn("x", F.lit(1)), "epitope", lambda q, r: pd.DataFrame({"n": [len(q) * len(r)]}), "n long", block=7)
    assert small.agg(F.sum("n")).first()[0] == 625 and np.all([r.n <= 400 for r in small.collect()])
