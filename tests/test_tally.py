"""Counts of distances against matrices of them."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from repertoire.functions.sequences import DistanceParams
from repertoire.operators import distance, tally

_V = {c: {(f"V{c}{i}", f"V{c}{j}"): 5.0 * abs(i - j) for i in range(4) for j in range(4)} for c in "AB"}


def _block(rng, n, first):
    loop = lambda least, most: "".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), rng.integers(least, most)))
    sets = lambda c: [f"V{c}{i}" for i in rng.choice(4, rng.integers(0 if rng.random() < 0.1 else 1, 3), replace=False)]
    rows = [(first + i, "E", int(rng.integers(4)), loop(4, 15), loop(4, 18), sets("A"), sets("B")) for i in range(n)]
    return pd.DataFrame(rows, columns=["clone_id", "epitope", "subject", "cdr3a", "cdr3b", "va_genes", "vb_genes"])


def _side(x):
    return {c: x[c].to_numpy() if c in ("clone_id", "subject") else list(x[c]) for c in x.columns}


def test_counts_are_those_of_the_matrices():
    """With short loops, empty gene sets, rows of one id or subject, long loops and no V genes."""
    rng = np.random.default_rng(5)
    for p, v, longer in ((DistanceParams(), _V, 0), (DistanceParams(trim_cdr3s=False), {}, 0), (DistanceParams(), _V, 20)):
        q, r = _block(rng, 60, 0), _block(rng, 90, 30)
        q.loc[:9, "cdr3a"] += "K" * longer
        for others in (False, True):
            found = {(int(q["clone_id"][i]), c): n[k] for rows, c, n in tally.counted(_side(q), _side(r), v, p, other_subjects=others, batch=17) for k, i in enumerate(rows)}
            ok = distance._usable(q, r, False, not others)
            assert len(found) == 3 * len(q)
            for c, d in distance.chain_matrices(q, r, v, p).items():
                for i in range(len(q)):
                    value, n = np.unique(d[i][ok[i] & ~np.isnan(d[i])], return_counts=True)
                    mine = found[int(q["clone_id"][i]), c]
                    assert dict(zip(value.tolist(), n.tolist(), strict=True)) == {float(x): int(mine[x]) for x in np.flatnonzero(mine)}


def test_a_block_of_queries_meets_wide_blocks(spark):
    """References are sent once for each of 16 blocks of queries at most, not once for each 1,500 rows."""
    rows = spark.range(40_000).select(F.col("id").alias("clone_id"), F.lit("x").alias("epitope"))
    sizes = lambda q, r: pa.table({"q": [len(q)], "r": [len(r)]})
    got = distance.in_block_pairs(rows, rows, "epitope", sizes, "q long, r long", block=None, wide=True).toPandas()
    assert len(got) == 16 and set(got["r"]) == {40_000} and got["q"].sum() == 40_000
