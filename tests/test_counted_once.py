"""Tables that are read once, and motifs that are compared by the sets that clones match."""

import random
import re

from repertoire.operators import motifs
from repertoire.plans import registry


def test_rounds_of_an_allocation_do_not_read_the_table(spark):
    fg, bg = registry._tuple_tables(spark, "/root/testdata/sf0.001")
    assert fg.inputFiles() == [] and bg.inputFiles() == []
    assert fg.count() and bg.count()


def plain(ms, hits, expected):
    kept = []
    for s, _, chi in sorted(ms, key=lambda m: (-m[2], m[0])):
        near = [o for o in kept if len(hits[s] & hits[o]) >= 0.8 * max(len(hits[s]), len(hits[o])) - 1e-9 and not (expected[s] < 1 < expected[o])]
        if hits[s] and not near:
            kept.append(s)
    return {s: len(hits[s]) for s in kept}


def test_motifs_of_equal_sets_are_compared_once(spark):
    rng = random.Random(4)
    seqs = ["".join(rng.choice("ACD") for _ in range(6)) for _ in range(300)]
    ms = [(s, p, float(50 - i)) for i, (s, p) in enumerate([("A", "A"), ("AC", "A.?C"), ("C", "C"), ("D", "D"), ("^A", "^A"), ("n", "[AC]"), ("Z", "Z")])]
    expected = {s: (0.5 if i % 2 else 3.0) for i, (s, _, _) in enumerate(ms)}
    c = spark.createDataFrame([("e", i, s) for i, s in enumerate(seqs)], "epitope string, clone_id long, cdr3a string")
    m = spark.createDataFrame([("e", s, p, x, expected[s]) for s, p, x in ms], "epitope string, shown string, pattern string, chi_squared double, expected double")
    hits = {s: {i for i, q in enumerate(seqs) if re.search(p, q)} for s, p, _ in ms}
    sets = motifs.matched_sets(m, c, ["epitope"], "cdr3a")
    assert sets.count() < 40 and sum(r.n * len(r.shown) for r in sets.collect()) == sum(map(len, hits.values()))
    want = plain(ms, hits, expected)
    for got in (motifs.drop_redundant_sets(m, sets, ["epitope"], expected="expected"), motifs.drop_redundant(m, motifs.matches(m, c, ["epitope"], "cdr3a"), ["epitope"], expected="expected")):
        assert {r.shown: r.n for r in got.collect()} == want
