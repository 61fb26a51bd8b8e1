"""Sums of a kernel by clone come from counts of distances, not from matrices."""

import pytest

from repertoire.operators import distance, diversity
from repertoire.plans.base import clones, genes
from tests.conftest import SMALL


def test_sums_are_those_of_pairs(spark, monkeypatch):
    c, g, kernel = clones(spark, SMALL), genes(spark, SMALL), distance.gaussian(diversity.THRESHOLD)
    want = {(r.unit, r.clone_id, r.chains): (r.n, r.total) for r in distance.pair_sums(c, g, kernel, by_clone=True).collect()}
    monkeypatch.setattr(distance, "pair_sums", None)
    got = {(r.unit, r.clone_id, r.chains): (r.n, r.total) for r in distance.kernel_sums(c, g, kernel).collect()}
    assert got.keys() == want.keys() and want
    for k, (n, total) in want.items():
        assert got[k] == (n, pytest.approx(total))
