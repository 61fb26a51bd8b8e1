"""Links of V genes connect what their neighbours connect, without a pair for each two equal genes."""

import random

from repertoire.operators import genes
from repertoire.operators.graph import components


def test_links_connect_what_neighbours_connect(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("ACDEFGHIKLMNPQRS", k=16)) for _ in range(3)]
    rows = []
    for k in range(400):
        s = list(base[k % 3])
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            s[rng.randrange(16)] = rng.choice("DEKRQNSILMVF.*")
        s = "".join(s)
        rows.append((f"V{k:03d}", "o", "AB"[k % 2], s + "C", [s[:6], s[6:11], s[11:], "C"], [(17, 17)]))
    g = spark.createDataFrame(rows, "gene string, organism string, chain string, aligned_protseq string, cdrs array<string>, cdr_columns array<struct<start int, stop int>>").cache()
    nodes = g.selectExpr("gene node")
    near, links = genes.v_neighbours(g).cache(), genes.v_links(g).cache()
    assert links.count() < near.count()
    found = [sorted((r.node, r.component) for r in components(x, nodes).collect()) for x in (near, links)]
    assert found[0] == found[1] and len({c for _, c in found[0]}) > 10
