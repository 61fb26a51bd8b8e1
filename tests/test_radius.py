"""Pairs within a radius: found by prefixes, the same as by comparing all."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from repertoire.functions.sequences import DistanceParams
from repertoire.operators import distance, diversity, motifs, radius
from repertoire.plans import registry
from repertoire.plans.base import clones, genes
from tests.conftest import MID, SMALL

NAMES = ["chains", "id1", "id2", "subject1", "subject2", "epitope1", "epitope2", "dist"]


def _loops(n, k, seed):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("ACDEFGHK"), n)) for _ in range(k)]


def test_near_loops_are_those_of_the_matrix(monkeypatch):
    monkeypatch.setattr(radius, "MOST", 50)  # fronts are cut
    for p in (DistanceParams(), DistanceParams(trim_cdr3s=False)):
        for n in (6, 7, 8, 11, 13):
            for more in (0, 1, 2):
                q, r = _loops(n, 40, n), _loops(n + more, 50, 99 + more)
                d = distance._cdr3_block(q, r, p)
                found = [x for part in radius.near_loops(pa.array(q), pa.array(r), 24.0, p) for x in zip(*(y.tolist() for y in part), strict=True)]
                got = {(i, j): x for i, j, x in found if x <= 24}
                assert len(got) == sum(x <= 24 for _, _, x in found)
                assert got == {(i, j): d[i, j] for i, j in zip(*(y.tolist() for y in np.nonzero(d <= 24)), strict=True)}


def test_few_branches_are_looked_at(monkeypatch):
    seen = []
    real = radius.runs
    monkeypatch.setattr(radius, "runs", lambda a, b: (seen.append(int((b - a).sum())), real(a, b))[1])
    codes = np.random.default_rng(1).integers(0, 20, (20_000, 9))
    for _ in radius.near_cores(codes, codes, 19 / 3):
        pass
    assert sum(seen) < 0.2 * len(codes) ** 2


def test_listed_loops_are_those_of_the_matrix():
    a, b = ([x for n in range(15) for x in _loops(n, 12, seed + n)] for seed in (1, 50))
    b = b[40:] + b[:40]
    for p in (DistanceParams(), DistanceParams(trim_cdr3s=False)):
        want = np.array([distance._cdr3_block([x], [y], p)[0, 0] for x, y in zip(a, b, strict=True)])
        np.testing.assert_array_equal(radius.listed_loops(pa.array(a), pa.array(b), p), want)
        np.testing.assert_array_equal(radius.listed_loops(pa.array(a)[30:], pa.array(b)[30:], p), want[30:])


def test_pairs_within_a_radius_are_those_of_the_blocks(spark, monkeypatch):
    """Equal receptors, loops too short, sets without a gene, and members in several rows."""
    monkeypatch.setattr(distance, "_MEMBERS", 2)
    c = clones(spark, SMALL).withColumns({"cdr3a": F.concat(F.lit("CAV"), F.substring("cdr3a", 4, 2), F.lit("LF")), "cdr3b": F.when(F.col("clone_id") % 9 == 0, "CASSF").otherwise(F.concat(F.lit("CAS"), F.substring("cdr3b", 4, 3), F.lit("YF")))})
    c = c.withColumn("va_genes", F.when(F.col("clone_id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.col("va_genes")))
    rows = lambda df: sorted(tuple(r[k] for k in NAMES) for r in df.collect())
    for g in (genes(spark, SMALL), None):
        for chains in (("A", "B", "AB"), ("AB",), ("B",)):
            want = rows(distance._compared_pairs(c, g, diversity.THRESHOLD, chains=chains))
            assert want and rows(distance.pairs_within(c, g, diversity.THRESHOLD, chains=chains)) == want
    pairs = distance._compared_pairs(c, genes(spark, SMALL), diversity.THRESHOLD, chains=("B",))
    counts = lambda df: sorted((r.epitope, r.subject1, r.subject2, r.overlap) for r in df.collect())
    assert counts(distance.near_subjects(c, genes(spark, SMALL), diversity.THRESHOLD, "B")) == counts(diversity.match_counts(pairs))


def test_blocks_of_clones_are_not_compared(spark, monkeypatch):
    """Queries with a radius make no matrix of two blocks of clones."""
    monkeypatch.setattr(distance, "in_own_blocks", None)
    for name in ("receptor_pairs_within", "cdr3_pairs_in_band", "threshold_sharing", "motif_match_plus"):
        assert registry.queries()[name](spark, SMALL).columns


def test_first_matchers_of_equal_loops(spark):
    c = clones(spark, MID).withColumn("cdr3a", F.concat(F.lit("CAV"), F.substring("cdr3a", 4, 3), F.lit("LF")))
    found = c.where("cdr3a rlike 'A[A-Z][KR]'").select("epitope", F.lit("x").alias("shown"), "clone_id")
    near = lambda x: distance.length_band_pairs(x, "A", 19.0).select("id1", "id2")
    pairs = near(c)
    want = motifs.match_plus(found, pairs.unionAll(pairs.select(F.col("id2").alias("id1"), F.col("id1").alias("id2"))), ["epitope"])
    rows = lambda df: sorted((r.epitope, r.shown, r.clone_id, r.matcher) for r in df.collect())
    assert rows(motifs.match_plus_equal(found, c, near, ["epitope"], "cdr3a")) == rows(want)
