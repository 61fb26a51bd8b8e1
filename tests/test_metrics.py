"""Gene probabilities, contracts, random pairs, redundant motifs and tree edges against plain computations."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from repertoire.operators import clustering, motifs, reports, trees, usage
from repertoire.operators import reads as parsing
from repertoire.plans.base import for_each
from repertoire.sources import contracts, tables


def _distances(n, seed=3):
    rng = random.Random(seed)
    return {(i, j): float(rng.randint(1, 10**6)) for i, j in itertools.combinations(range(n), 2)}


def _plain_tree(d, n, mean):
    """Merges of a plain agglomeration in which a distance of two sets is ``mean`` of all distances between them."""
    sets, out = [frozenset([i]) for i in range(n)], []
    while len(sets) > 1:
        best = min(((mean([d[min(x, y), max(x, y)] for x in a for y in b]), a, b) for a, b in itertools.combinations(sets, 2)), key=lambda t: t[0])
        out.append((best[0], best[1] | best[2]))
        sets = [s for s in sets if s not in best[1:]] + [best[1] | best[2]]
    return out


MEANS = {"average": lambda v: sum(v) / len(v), "geometric": lambda v: math.exp(sum(map(math.log, v)) / len(v)), "single": min}


@pytest.mark.parametrize("linkage", sorted(MEANS))
def test_trees_are_those_of_all_distances_between_two_sets(spark, linkage):
    n, d = 12, _distances(12)
    rows = spark.createDataFrame([("g", i, j, x) for (i, j), x in d.items()], "g string, id1 long, id2 long, dist double")
    got = sorted((round(r.height, 3), tuple(sorted(r.leaves))) for r in clustering.trees(rows, "g", linkage).collect())
    assert got == sorted((round(h, 3), tuple(sorted(s))) for h, s in _plain_tree(d, n, MEANS[linkage]))


def test_edges_centres_and_meeting_heights(spark):
    n, d = 9, _distances(9, 5)
    rows = spark.createDataFrame([("g", i, j, x) for (i, j), x in d.items()] + [("h", 1, 2, 4.0)], "g string, id1 long, id2 long, dist double")
    t = clustering.trees(rows, "g").cache()
    merges = _plain_tree(d, n, MEANS["average"])
    meet = {(i, j): next(h for h, s in merges if i in s and j in s) for i, j in d}
    totals = {r.id: (r.n, round(r.total, 3)) for r in trees.meeting_totals(t, "g").where("g = 'g'").collect()}
    assert totals == {i: (n - 1, round(sum(meet[min(i, j), max(i, j)] for j in range(n) if j != i), 3)) for i in range(n)}
    places = spark.createDataFrame([("g", i, float(2 * i), i * 1.5, 1 + i % 3) for i in range(n)] + [("h", 1, 0.0, 1.0, 1), ("h", 2, 1.0, 3.0, 2)], "g string, id long, place double, score double, size long")
    edges = trees.tree_edges(t, "g").where("g = 'g'").collect()
    assert len(edges) == 2 * (n - 1) and sorted(e.leaves[0] for e in edges if e.size == 1) == list(range(n))
    below = {(e.parent, e.child): e.leaves for e in edges}
    for weighted in (False, True):
        drawn = trees.drawn_edges(t, places, "g", weighted=weighted).collect()
        assert len(drawn) == 2 * n
        for e in (e for e in drawn if e.g == "g"):
            leaves = below[e.parent, e.child]
            w = [1 + i % 3 if weighted else 1 for i in leaves]
            assert e.centre == pytest.approx(sum(2 * i * x for i, x in zip(leaves, w, strict=True)) / sum(w))
            assert e.score == pytest.approx(sum(i * 1.5 for i in leaves) / len(leaves))
            assert e.size == sum(1 + i % 3 for i in leaves) and e.cluster == (leaves[0] if len(leaves) == 1 else -1)
            assert e.parent_height >= e.child_height >= 0


def test_places_of_a_small_table_keep_near_items_together(spark):
    at = {"c": 0.0, "a": 1.0, "e": 10.0, "b": 11.5, "d": 30.0}
    rows = [(x, y, abs(at[x] - at[y])) for x, y in itertools.combinations(sorted(at), 2)]
    found = {r.name: r.place for r in clustering.leaf_places(spark.createDataFrame(rows, "x string, y string, dist double"), "x", "y", "dist").collect()}
    assert sorted(found.values()) == list(range(5))
    assert abs(found["a"] - found["c"]) == 1 and abs(found["e"] - found["b"]) == 1 and found["d"] in (0, 4)


def test_a_rarely_expected_motif_stays_beside_an_often_expected_one(spark):
    m = spark.createDataFrame([("e", "x", 9.0, 3.0), ("e", "y", 8.0, 0.5), ("e", "z", 7.0, 0.5), ("e", "w", 6.0, 2.0)], "e string, shown string, chi_squared double, expected double")
    found = spark.createDataFrame([("e", s, i) for s in "xyzw" for i in range(10)], "e string, shown string, clone_id long")
    kept = lambda **k: {r.shown for r in motifs.drop_redundant(m, found, ["e"], **k).collect()}
    assert kept() == {"x"}
    # y passes x; z passes x but not y; w does not pass x
    assert kept(expected="expected") == {"x", "y"}


def test_contracts_name_what_is_missing_and_keep_their_order(spark, tmp_path):
    df = spark.createDataFrame([("1", "e", None, "x"), ("2", "", ["b", "a"], "y")], "epitope string, id string, members array<string>, more string")
    with pytest.raises(ValueError, match="clone_size"):
        contracts.as_contract(df.withColumnRenamed("id", "clone_id"), ["clone_id", "clone_size"])
    path = str(tmp_path / "t")
    contracts.write_contract(df, path, ["id", "epitope", "members", "status"], extra=["more", "none"], optional=["status"])
    back = tables.read_tsv(spark, path)
    assert back.columns == ["id", "epitope", "members", "status", "more"]
    assert sorted(tuple(r) for r in back.fillna("-").collect()) == [("-", "2", "b;a", "-", "y"), ("e", "1", "-", "-", "x")]
    assert contracts.contract("clones", before=["id", "x"]) == ["clone_id", "x", "members", "clone_size"]
    assert len(contracts.contract("probs", masked=True)) == len(contracts.PARSED_SEQS) + 16
    with pytest.raises(KeyError):
        contracts.contract("others")


def test_derived_fields_of_rows_that_lack_all_or_have_them(spark):
    rows = [(1, "-", "-", "-"), (2, None, None, "A*01:5;B*01:5;C*01:3;A*01:5"), (3, "Q", None, None), (4, "B*01", "Z*09;B*01", "A*01:5"), (5, None, "", "")]
    df = spark.createDataFrame(rows, "id long, va_gene string, va_genes string, va_blast_hits string")
    classes = spark.createDataFrame([("A*01", "RA", "CX"), ("B*01", "RB", "CX")], "gene string, rep string, count_rep string")
    got = {r.id: r for r in contracts.derived_genes(df, "va", classes).collect()}
    assert len(got) == 5
    assert [got[2][f"va_{c}"] for c in ("genes", "gene", "rep", "reps", "countreps")] == ["A*01;B*01", "A*01", "RA", "RA;RB", "CX"]
    assert [got[3][f"va_{c}"] for c in ("genes", "gene", "rep", "reps", "countreps")] == ["Q"] * 5
    assert [got[4][f"va_{c}"] for c in ("genes", "gene", "rep", "reps", "countreps")] == ["Z*09;B*01", "B*01", "RB", "RB;Z*09", "CX;Z*09"]
    for k in (1, 5):
        assert got[k].va_genes is None and got[k].va_reps is None and got[k].va_rep is None
    assert contracts.derived_genes(df.limit(0), "va", classes).count() == 0


def test_pseudo_probabilities_of_rows_without_genes_and_empty_tables(spark):
    c = spark.createDataFrame([("e", ["a", "b", "a"], "a"), ("e", ["a"], "a"), ("e", None, None), ("f", [], None)], "epitope string, g array<string>, label string")
    back = spark.createDataFrame([("a", 0.5), ("c", 0.0)], "gene string, pseudoprob double")
    dim = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "gene string")
    got = {(r.epitope, r.gene): tuple(round(x, 6) for x in r[2:]) for r in usage.gene_probabilities(c, "g", "label", back, dim).collect()}
    assert got == {("e", "a"): (0.666667, 0.666667, 1.333333), ("e", "b"): (0.0, 0.333333, 1.0), ("e", "c"): (0.0, 0.0, 1.0), ("f", "a"): (0.0, 0.0, 0.0), ("f", "b"): (0.0, 0.0, 1.0), ("f", "c"): (0.0, 0.0, 1.0)}
    assert usage.gene_probabilities(c.limit(0), "g", "label", back, dim).count() == 0
    best = usage.best_gene_probability(c, "g", back, "p").orderBy(F.desc_nulls_last("p")).select("p").collect()
    assert [r.p for r in best] == [0.5, 0.5, None, None]


def test_random_pairs_join_places_of_the_shorter_table(spark):
    a = spark.range(50).withColumnRenamed("id", "i")
    b = spark.range(100, 120).withColumnRenamed("id", "j")
    one = sorted(map(tuple, tables.paired_random(a, b, ids=("i", "j")).select("place", "i", "j").collect()))
    assert [r[0] for r in one] == list(range(1, 21)) and len({r[1] for r in one}) == len({r[2] for r in one}) == 20
    assert one == sorted(map(tuple, tables.paired_random(a.repartition(7), b.repartition(3), ids=("i", "j")).select("place", "i", "j").collect()))
    assert one != sorted(map(tuple, tables.paired_random(a, b, seed=9, ids=("i", "j")).select("place", "i", "j").collect()))
    assert tables.paired_random(a, b, 6, ids=("i", "j")).count() == 6


def test_metric_table_fills_named_gaps_only(spark):
    base = spark.createDataFrame([("e",), ("f",)], "epitope string")
    v = spark.createDataFrame([("e", "A", 1.0), ("e", "AB", 2.0)], "epitope string, chains string, x double")
    got = reports.metric_table(base, [reports.by_chains(v, "x", "p"), v.where("chains = 'A'").select("epitope", F.col("x").alias("y"))], zero=("p_a", "p_b"))
    assert sorted(map(tuple, got.select("epitope", "p_a", "p_b", "p_ab", "y").collect())) == [("e", 1.0, 0.0, 2.0, 1.0), ("f", 0.0, 0.0, None, None)]


def _plain_qualities(read, quals, part):
    """By trying every place and every part."""
    flip = lambda s: s[::-1].translate(str.maketrans("acgt", "tgca"))
    read, part, n = read.lower(), part.lower(), len(part)
    strands = [(read, quals), (flip(read), quals[::-1])]
    for nuc, q in strands:
        at = [i for i in range(len(nuc) - n + 1) if nuc[i : i + n] == part]
        if at:
            return q[(i := max(at, key=lambda i: (min(q[i : i + n]), -i))) : i + n]
    parts = [(-(j - i), s, i, j) for s in (0, 1) for i in range(n) for j in range(i + 1, n + 1) if part[i:j] in strands[s][0]]
    if not parts:
        return [60] * n
    _, s, i, j = min(parts)
    nuc, q = strands[s]
    at = nuc.find(part[i:j])
    return [60] * i + q[at : at + j - i] + [60] * (n - j)


def test_junction_qualities_are_those_of_all_places_and_parts(spark):
    rng = random.Random(11)
    text = lambda n, letters="acgt": "".join(rng.choice(letters) for _ in range(n))
    rows = [(k, text(rng.randint(1, 40), "ac" if k % 3 else "acgt"), text(rng.randint(1, 9), "ac" if k % 3 else "acgt").upper()) for k in range(150)]
    rows = [(k, s, [rng.randint(0, 4) for _ in s], p) for k, s, p in rows] + [(150, "acgt", [1, 2, 3, 4], "")]
    df = spark.createDataFrame([*rows, (151, None, None, "acg"), (152, "ac", [1, 2], None)], "k long, read string, quals array<int>, part string")
    got = {r.k: r.q for r in df.select("k", parsing.junction_qualities(F.col("read"), F.col("quals"), F.col("part")).alias("q")).collect()}
    assert {k: got[k] for k, *_ in rows[:-1]} == {k: _plain_qualities(s, q, p) for k, s, q, p in rows[:-1]}
    assert got[150] is None and got[151] is None and got[152] is None


def test_rows_for_each_repertoire(spark):
    x = spark.createDataFrame([("a", 1)], "rep string, p int")
    groups = spark.createDataFrame([("f",), ("e",), ("e",), (None,)], "epitope string")
    assert sorted(map(tuple, for_each(x, groups, "epitope").collect())) == [("a", 1, "e"), ("a", 1, "f")]
    assert for_each(x, groups.limit(0), "epitope").count() == 0


def test_one_scale_for_all_groups_is_the_median_of_their_extents(spark):
    rows = [("g", 1, 2, 4.0), ("g", 1, 3, 9.0), ("h", 1, 2, 2.0), ("i", 5, 6, 30.0), ("j", 5, 6, 11.0)]
    pairs = spark.createDataFrame(rows, "g string, id1 long, id2 long, dist double")
    assert clustering.median_extent(pairs, "g") == 10.0
    assert clustering.median_extent(pairs.limit(0), "g") is None
