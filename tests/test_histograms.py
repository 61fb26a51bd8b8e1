"""Permuted and Gaussian sums come from counts, not from matrices of pairs."""

import numpy as np

from repertoire.functions.sequences import DistanceParams
from repertoire.operators import distance, diversity, permutation, tally
from repertoire.plans.base import clones, genes
from tests.conftest import SMALL


def test_permuted_sums_make_no_pairs(spark, monkeypatch):
    c, g = permutation.subject_labels(clones(spark, SMALL), 3), genes(spark, SMALL)
    one = {r.clone_id: r for r in c.collect()}
    want = {}
    for x in distance.pairs_within(c, g, None).collect():
        for rep in range(4):
            a, b = sorted(one[i].labels[rep] for i in (x.id1, x.id2))
            n, total = want.get((x.epitope1, rep, a, b, x.chains), (0, 0.0))
            want[x.epitope1, rep, a, b, x.chains] = n + 1, total + x.dist
    monkeypatch.setattr(distance, "in_own_blocks", None)
    got = {(r.unit, r.rep, r.group1, r.group2, r.chains): (r.n, r.total) for r in distance.permuted_sums(c, g, "labels", 4).collect()}
    assert got == want


def test_gaussian_sums_are_those_of_pairs(spark, monkeypatch):
    c, g = clones(spark, SMALL), genes(spark, SMALL)
    want = {}
    for x in distance.pairs_within(c, g, None).collect():
        for same in (True, False) if x.subject1 != x.subject2 else (True,):
            n, total = want.get((x.epitope1, x.chains, same), (0, 0.0))
            want[x.epitope1, x.chains, same] = n + 1, total + np.exp(-((x.dist / (diversity.THRESHOLD * len(x.chains))) ** 2))
    rows = lambda: {(r.epitope, r.chains, r.same_subject): (r.pairs, round(r.overlap, 8)) for r in diversity.gaussian_diversity(c, g).collect()}
    want = {k: (n, round(t, 8)) for k, (n, t) in want.items()}
    monkeypatch.setattr(distance, "in_own_blocks", None)
    assert rows() == want


def test_distances_that_spread_wide_are_counted(spark):
    c, g = clones(spark, SMALL), genes(spark, SMALL)
    p = DistanceParams(weight_cdr3_region=900)
    assert not tally.whole(p, {}) and distance.distance_counts(c, g, params=p) is None
    p = DistanceParams(weight_cdr3_region=200, gap_penalty_cdr3_region=500)
    pairs = distance.pairs_within(c, g, None, params=p).groupBy("epitope1", "chains", "dist").count().collect()
    got = {(r.unit, r.chains, r.d): r.n for r in distance.distance_counts(c, g, params=p).collect()}
    assert got == {(r.epitope1, r.chains, r.dist): 2 * r["count"] for r in pairs}
