"""Scores made where distances are counted are those of lists of distances."""

import pytest
from pyspark.sql import functions as F

from repertoire.operators import distance, neighbors
from repertoire.plans.base import clones, genes
from tests.conftest import SMALL


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("chains", [distance.CHAINS, ("AB",)])
def test_scores_are_those_of_lists(spark, own, chains, monkeypatch):
    c = clones(spark, SMALL).withColumns({"cdr3a": F.when(F.col("clone_id") % 11 == 0, "CAF").otherwise(F.col("cdr3a")), "vb_genes": F.when(F.col("clone_id") % 13 == 0, F.array().cast("array<string>")).otherwise(F.col("vb_genes"))})
    near = distance.nearest_distances(c, genes(spark, SMALL), largest_percentile=10, own_epitope=own)
    want = sorted(map(tuple, neighbors.neighbor_scores(near.where(F.col("chains").isin(*chains)), (10,)).collect()))
    monkeypatch.setattr(neighbors, "neighbor_scores", None)
    monkeypatch.setattr(distance, "WIDE", 20)
    s = distance.nearest_scores(c, genes(spark, SMALL), 10, own_epitope=own, chains=chains)
    assert "collect_list" not in s._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, s.collect()))
    assert got == want and got
