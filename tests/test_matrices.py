"""Distance matrices as files, and junction samples within their limits."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from repertoire.functions import tables
from repertoire.operators import clustering, distance, junctions, matrices
from repertoire.operators.junctions import TrimTables
from repertoire.plans.base import clones, genes

SMALL = "/root/testdata/sf0.001"


def test_matrix_is_written_and_read_in_order(spark, tmp_path):
    c, g = clones(spark, SMALL).cache(), genes(spark, SMALL)
    path = f"file://{tmp_path}/m"
    matrices.write_distances(c, g, path, block=13)
    back = matrices.read_distances(spark, path, c)
    assert max(len(r.distances) for r in back.collect()) <= 13
    got = {(r.chains, r.id1, r.id2): r.dist for r in matrices.matrix_pairs(back, c).collect()}
    want = {(r.chains, r.id1, r.id2): r.dist for r in distance.pairs_within(c, g, None).collect()}
    assert len(got) == 2 * len(want) and all(got[k, i, j] == got[k, j, i] == d for (k, i, j), d in want.items())
    for other in (c.where("clone_id <> 7"), c.withColumn("clone_id", F.when(F.col("clone_id") == 7, 100_007).otherwise(F.col("clone_id")))):
        with pytest.raises(ValueError):
            matrices.read_distances(spark, path, other)
    assert matrices.read_distances(spark, path, c.orderBy(F.desc("clone_id"))).count() == back.count()


def test_rounds_of_greedy_clusters_are_those_of_one_after_another(spark):
    c, g = clones(spark, SMALL).cache(), genes(spark, SMALL)
    pairs = distance.pairs_within(c, g, None, chains=("A",)).select(F.col("epitope1").alias("g"), "id1", "id2", "dist").cache()
    nodes = c.select(F.col("epitope").alias("g"), F.col("clone_id").alias("id"))
    for radius in (10.0, 60.0, 90.0, 1000.0):
        want = {(r.g, r.id): r.center for r in clustering.greedy_clusters(pairs, "g", radius).collect()}
        got = clustering.greedy_rounds(pairs.where(F.col("dist") <= radius), nodes, "g").collect()
        assert len(got) == len(want) == c.count() and {(r.g, r.id): r.center for r in got} == want


def residues(nuc):
    code = tables.genetic_code()
    return "".join(code[nuc[i : i + 3]] for i in range(0, len(nuc), 3))


V, J = "tgtgccagcagcgaa", "aacactgaagctttcttt"
ALPHA = TrimTables([0.3, 0.2, 0.2, 0.1, 0.1, 0.1], [0.25, 0.25, 0.2, 0.1, 0.1, 0.05, 0.05], [0.1] * 10)
BETA = TrimTables([0.4, 0.3, 0.2, 0.1], [0.4, 0.3, 0.3], [], [0.3, 0.3, 0.2, 0.2], [0.05] * 20, {1: {(0, 0): 0.5, (2, 3): 0.5}, 2: {(1, 1): 1.0}}, {1: "gggacagggggc", 2: "gggactagcggg"}, {1: 0.5, 2: 0.5})


def test_samples_keep_their_limits(spark):
    pairs = spark.createDataFrame([("TRBV1", V, "TRBJ1-1", J), ("TRBV1", V, "TRBJ2-1", J), ("TRBV9", V[:6], "TRBJ2-9", J[:5])], "v string, v_nuc string, j string, j_nuc string")
    for t, seen in ((ALPHA, "VNJ"), (BETA, "VNDNJ")):
        rows = junctions.sample_junctions(pairs, t, 300, seed=5).collect()
        again = junctions.sample_junctions(pairs.repartition(3), t, 300, seed=5).collect()
        assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
        assert set(collections.Counter((r.v, r.j) for r in rows).values()) == {300}
        for r in rows:
            assert len(r.nuc) == 3 * len(r.protein) == len(r.source) and residues(r.nuc) == r.protein and "*" not in r.protein
            v, j = (V[:6], J[:5]) if r.v == "TRBV9" else (V, J)
            n_v, n_j = r.source.count("V"), r.source.count("J")
            assert 3 <= n_v <= len(v) and 3 <= n_j <= len(j) and len(v) - n_v <= 15
            assert r.nuc[:n_v] == v[:n_v] and r.nuc[len(r.nuc) - n_j :] == j[len(j) - n_j :] and re.fullmatch("V+N*D*N*J+", r.source)
            if "D" in seen and "D" in r.source:
                a, b = r.source.index("D"), r.source.rindex("D") + 1
                own = [d for i, d in BETA.d_genes.items() if r.nuc[a:b] in d]
                assert own and b - a in (12, 10, 7) and (r.j != "TRBJ1-1" or r.nuc[a:b] in BETA.d_genes[1])
                assert len(r.source) - n_j - b <= junctions.MOST_DJ_INSERT
    fixed = junctions.sample_junctions(pairs.where("v = 'TRBV1'"), ALPHA, 200, aa_length=11).collect()
    assert len(fixed) == 400 and {len(r.protein) for r in fixed} == {11}


def test_trims_follow_their_tables(spark):
    """Without stops in reach and with frames forced by the insert, trims have the distribution of their table."""
    v, j = "gccgccgccgcc", "gccgccgccgccgcc"
    t = TrimTables([0.4, 0.3, 0.2, 0.1], [0.5, 0.25, 0.25], [1 / 3] * 3)
    pairs = spark.createDataFrame([("v", v, "j", j)], "v string, v_nuc string, j string, j_nuc string")
    rows = junctions.sample_junctions(pairs, t, 6000).collect()
    # each pair of trims leaves one insert of three in frame, so both keep their shares but for rare stops
    for table, counts in ((t.v_trim, collections.Counter(len(v) - r.source.count("V") for r in rows)), (t.j_trim, collections.Counter(len(j) - r.source.count("J") for r in rows))):
        chi = sum((counts[i] - 6000 * p) ** 2 / (6000 * p) for i, p in enumerate(table))
        assert chi < 22
