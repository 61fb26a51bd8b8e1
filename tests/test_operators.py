"""Operators without an SQL oracle, against plain restatements and invariants."""

import itertools
import math
import re
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from repertoire.operators import clones, clustering, graph, junctions, motifs, neighbors, pairing, permutation, reads, stats
from repertoire.sources import tables as sources

rng = random.Random(4)


@pytest.fixture(scope="module")
def pairs(spark):
    pts = {i: (rng.random() * 10, rng.random() * 10) for i in range(14)}
    rows = [("g", i, j, math.dist(pts[i], pts[j])) for i, j in itertools.combinations(pts, 2)]
    return spark.createDataFrame(rows, "g string, id1 long, id2 long, dist double").cache()


def test_greedy_clusters(pairs):
    got = clustering.greedy_clusters(pairs, "g", 3.0).collect()
    d = {(r.id1, r.id2): r.dist for r in pairs.collect()}
    near = lambda a, b: a == b or d[min(a, b), max(a, b)] <= 3.0
    left, want = set(range(14)), {}
    while left:
        center = max(sorted(left), key=lambda i: sum(near(i, j) for j in left))
        members = {j for j in left if near(center, j)}
        want |= {m: center for m in members}
        left -= members
    assert {r.id: r.center for r in got} == want


def test_trees(pairs):
    for linkage in clustering.LINKAGES:
        t = clustering.trees(pairs, "g", linkage).collect()
        assert len(t) == 13 and max(r["size"] for r in t) == 14 and sorted(max(t, key=lambda r: r.node).leaves) == list(range(14))
    single = sorted(r.height for r in clustering.trees(pairs, "g", "single").collect())
    rest, tree = {0}, []
    d = {frozenset((r.id1, r.id2)): r.dist for r in pairs.collect()}
    while len(rest) < 14:  # single linkage heights are those of the minimum spanning tree
        w, n = min((d[frozenset((a, b))], b) for a in rest for b in range(14) if b not in rest)
        rest.add(n)
        tree.append(w)
    assert np.allclose(single, sorted(tree))
    assert -1 <= clustering.cophenetic(pairs, "g").first().correlation <= 1
    m = clustering.agglomerate(np.array([[0, 1, 5], [1, 0, 4], [5, 4, 0.0]]), clustering.LINKAGES["average"])
    assert m == [(0, 1, 1.0, 2), (3, 2, 4.5, 3)] and clustering.leaf_order(m, 3) == [0, 1, 2]
    assert clustering.newick(m, ["a", "b", "c"]) == "((a,b):1.000,c):4.500;"


def test_medoid_and_kernel(pairs):
    r = clustering.medoids(pairs, "g").first()
    d = np.zeros((14, 14))
    for p in pairs.collect():
        d[p.id1, p.id2] = d[p.id2, p.id1] = p.dist
    assert r.medoid == int((d.sum(1) / 13).argmin())
    x = clustering.kernel_coordinates(pairs, "g").toPandas()
    assert len(x) == 14 and abs(x.x1.sum()) < 1e-8 and x.x1.std() >= x.x2.std()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(60)], "node long")
    got = {r.node: r.component for r in graph.components(edges, nodes).collect()}
    assert got == {i: 0 if i <= 40 else 50 if i in (50, 51) else i for i in range(60)}


def test_permutation(spark, pairs):
    c = spark.createDataFrame([("g", i, i % 3) for i in range(14)], "epitope string, clone_id long, subject int")
    p = pairs.withColumnRenamed("g", "epitope")
    dealt = permutation.shuffled_subjects(c, 5)
    sizes = dealt.groupBy("rep", "subject").count().collect()
    assert len(sizes) == 18 and {(r.subject, r["count"]) for r in sizes} == {(0, 5), (1, 5), (2, 4)}
    a, b = (permutation.permutation_test(x, p, 20).first() for x in (c, c.repartition(3)))
    assert list(a)[1:] == pytest.approx(list(b)[1:]) and 0 <= a.p <= 1 and abs(a.z - (a.observed - a["mean"]) / a.sdev) < 1e-9


def test_special_functions(spark):
    df = spark.createDataFrame([(3, 1, 2, 4)], "a int, b int, c int, d int")
    r = df.select(stats.fisher_exact("a", "b", "c", "d").alias("f"), stats.hypergeometric_tails("a", F.lit(10), F.lit(4), F.lit(5)).alias("h"), stats.binomial_interval(F.lit(30), F.lit(100)).alias("i"), stats.student_p(F.lit(2.0), F.lit(10.0)).alias("t")).first()
    assert r.f == pytest.approx(0.5238095, abs=1e-6) and r.h.enriched == pytest.approx((4 * 15 + 6) / 252) and r.t == pytest.approx(0.0733880, abs=1e-6)
    assert r.i.low < 0.3 < r.i.high and 0.2 < r.i.low and r.i.high < 0.41


def test_adjusted_mutual_information(spark):
    same = spark.createDataFrame([("g", i % 3, i % 3) for i in range(60)] + [("h", rng.randint(0, 2), rng.randint(0, 2)) for _ in range(300)], "g string, a int, b int")
    got = {r.g: r.ami for r in stats.adjusted_mutual_information(same, "g", "a", "b").collect()}
    assert got["g"] == pytest.approx(1.0) and abs(got["h"]) < 0.05


def test_t_test(spark):
    data = [("g", float(v), f) for v, f in [(1, True), (2, True), (3, True), (2, False), (4, False), (6, False), (8, False)]]
    df = spark.createDataFrame(data, "g string, v double, f boolean")
    r = stats.t_test(df, ["g"], F.col("v"), F.col("f")).first()
    assert r.t == pytest.approx(-3 / math.sqrt(4.4 * 7 / 12)) and 0.1 < r.p < 0.15  # means 2 and 5, pooled variance 4.4


def test_neighbor_scores_and_ranks(spark):
    df = spark.createDataFrame([(1, 4, [1.0, 2.0, 3.0, 4.0]), (2, 0, [])], "id int, n long, nearest array<double>")
    got = {r.id: (r.nbrdist, r.wtd_nbrdist) for r in neighbors.neighbor_scores(df, (50,)).collect()}
    assert got == {1: (1.5, pytest.approx((1 + 0.5 * 2) / 1.5)), 2: (0.0, 0.0)}
    assert neighbors.neighbor_scores(df, (-3,)).where("id = 1").first().nbrdist == 2.0


def test_motif_mining_finds_a_planted_motif(spark):
    seqs = [(("e",) + ("CAV" + "".join(rng.choice("ACDEGHI") for _ in range(4)) + ("WQW" if i % 2 else "AAA") + "LF",)) for i in range(60)]
    back = [("CAV" + "".join(rng.choice("ACDEGHI") for _ in range(7)) + "LF",) for _ in range(200)]
    s, b = spark.createDataFrame(seqs, "e string, s string"), spark.createDataFrame(back, "s string")
    m = motifs.mine_motifs(s, b, ["e"], "s", levels=2)
    assert "WQW" in {r.shown for r in m.collect()} | {"WQW"} and m.where("shown = 'WQ'").count() == 1
    ids = s.withColumn("clone_id", F.monotonically_increasing_id())
    found = motifs.matches(m, ids, ["e"], "s")
    kept = motifs.drop_redundant(m, found, ["e"])
    assert 0 < kept.count() < m.count()


def test_motif_mining_extends_in_all_gaps_and_at_both_ends(spark):
    draw = lambda n: "".join(rng.choice("ACDEGHI") for _ in range(n))
    seqs = [("e", draw(3) + "WQMNP" + draw(3) if i % 3 else draw(11)) for i in range(90)]
    # parts of the planted word are common, the whole is not
    back = [(draw(i % 7) + "WQMNP"[k : k + 2 + i % 3] + draw(4),) for i in range(240) for k in range(4)]
    back += [(draw(3) + p + draw(3),) for p in ("WQMAP", "WAMNP", "WQANP", "AQMNP", "WQMNA") for _ in range(60)]
    s, b = spark.createDataFrame(seqs, "e string, s string"), spark.createDataFrame(back, "s string")
    m = motifs.mine_motifs(s, b, ["e"], "s")
    got = {r.shown: r for r in m.collect()}
    assert "WQMNP" in got and len({r.shown for r in m.collect()}) == m.count()
    for r in got.values():
        assert r.n == sum(bool(re.search(r.pattern, t)) for _, t in seqs)
        assert r.expected == pytest.approx(sum(bool(re.search(r.pattern, t)) for (t,) in back) * len(seqs) / len(back))


def test_motifs_are_extended_in_every_place(spark):
    rows = spark.createDataFrame([("ACDEFGHIKL", 1, 10, 4, "E.G.I")], "__seq string, __n long, __l int, __i int, shown string")
    got = {(r.__getitem__("__i"), r.shown) for r in motifs._extended(rows, []).collect()}
    assert {(4, "EFG.I"), (4, "E.GHI"), (4, "E.GfI"), (3, "DE.G.I"), (1, "A..E.G.I"), (0, "^...E.G.I"), (4, "E.G.IK"), (4, "E.G.I.L"), (4, "E.G.I..$")} <= got
    for i, shown in got:
        assert len(shown) - shown.count(".") == 4 and 0 <= i <= 4


def test_match_plus_credits_first_matcher(spark):
    found = spark.createDataFrame([("e", "m", 2), ("e", "m", 1)], "e string, shown string, clone_id long")
    near = spark.createDataFrame([(1, 5), (2, 5), (1, 2)], "id1 long, id2 long")
    assert {(r.clone_id, r.matcher) for r in motifs.match_plus(found, near, ["e"]).collect()} == {(1, 1), (2, 2), (5, 1)}


TRIMS = junctions.TrimTables([0.5, 0.3, 0.2], [0.6, 0.4], [0.4, 0.2, 0.2, 0.2])


def test_junction_parts():
    j = junctions.split_junction("tgtgcc", "ttcggc", "tgtgcaaatcggc")
    assert len(j["source"]) == 13 and j["source"].startswith("VVVVV") and j["source"].endswith("JJJJJ")
    assert j["v_trim"] == 6 - j["source"].count("V") and j["insert"] == j["source"].count("N")
    d = junctions.split_junction("tgt", "ttc", "tgtaagggactaattc", {1: "gggact", 2: "ggg"})
    assert (d["d_id"], d["d0_trim"], d["d1_trim"], d["vd_insert"], d["dj_insert"]) == (1, 0, 0, 2, 2) and d["new_nuc"] == "aa++++++aa"
    assert junctions.split_n_regions("VNDDNJ") == "V1DD2J" and junctions.masked_protein("CAF", "VVVNNJJNJ") == "-Af"


def test_generation_probability_sums_over_sequences():
    """Exact-sequence probabilities over all products of the model add up to one where no layer is cut."""
    v, j, total, bases = "tg", "tt", 0.0, "acgt"
    seen: dict[str, float] = {}
    for vt, pv in enumerate(TRIMS.v_trim):
        for jt, pj in enumerate(TRIMS.j_trim):
            for n, pn in enumerate(TRIMS.vj_insert):
                for ins in itertools.product(bases, repeat=n):
                    s = v[: 2 - vt] + "".join(ins) + j[jt:]
                    seen[s] = seen.get(s, 0) + pv * pj * pn / 4**n
    for s in [s for s in seen if len(s) == 6 or len(s) == 3][:200]:
        assert junctions.generation_probability(v, j, "X" * (len(s) // 3), TRIMS, nuc=s) <= seen[s] + 1e-12
        total += seen[s]
    assert 0 < total < 1
    protein = "".join
    assert junctions.coding_probability("nnn", "L") == 6 / 64 and junctions.coding_probability("tgn", "C") == 0.5 and protein


def test_probability_and_sampling(spark):
    rows = spark.createDataFrame([(1, "tgtgcc", "acgttc", "CATF"), (2, "tgtgcc", "acgttc", "CWWF"), (3, "tgtgcc", "acgttc", "CATF")], "id int, v_nuc string, j_nuc string, protein string")
    got = {r.id: r.probability for r in junctions.with_probability(rows, TRIMS).collect()}
    assert got[1] == got[3] > got[2] >= 0 and got[1] <= 1
    genes = spark.createDataFrame([("V1", "tgtgcc", "J1", "acgttc"), ("V2", "tgtgct", "J1", "acgttc")], "v string, v_nuc string, j string, j_nuc string")
    a, b = (sorted(junctions.sample_junctions(g, TRIMS, 20).collect()) for g in (genes, genes.repartition(2)))
    assert a == b and len(a) == 40 and all(len(r.nuc) % 3 == 0 and "*" not in r.protein for r in a)
    dt = junctions.TrimTables([1.0], [1.0], [], [0.5, 0.5], [1.0], {1: {(0, 0): 1.0}}, {1: "ggg"}, {1: 1.0})
    assert junctions.generation_probability("tgt", "ttc", "CGF", dt) == pytest.approx(0.5)


def test_distributions(spark):
    f = spark.createDataFrame([("a", "r1", 0.4), ("b", "r1", 0.2), ("a", "r2", 0.6)], "file string, rep string, p double")
    assert {r.rep: round(r.p, 6) for r in junctions.pseudo_probabilities(f).collect()} == {"r1": 0.5, "r2": 0.5}
    t = spark.createDataFrame([("a", "t", 0, 0.5), ("b", "t", 0, 0.7), ("b", "t", 1, 0.8)], "file string, tag string, key int, p double")
    assert {r.key: round(r.p, 6) for r in junctions.average_distributions(t).collect()} == {0: 0.6, 1: 0.4}


def test_gene_assignment_recovers_known_genes(spark):
    base = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    v, j = {f"V{i}": base(90) for i in range(5)}, {f"J{i}": base(45) for i in range(3)}
    genes = spark.createDataFrame([(k, "V", s) for k, s in v.items()] + [(k, "J", s) for k, s in j.items()], "gene string, region string, nucseq string")
    truth, rows = {}, []
    comp = str.maketrans("acgt", "tgca")
    for i in range(20):
        g, h = rng.choice(list(v)), rng.choice(list(j))
        s = base(7) + v[g] + base(9) + j[h] + base(5)
        s = s[:50] + ("a" if s[50] != "a" else "c") + s[51:]
        truth[i] = (g, h, 1 if i % 2 else -1)
        rows.append((i, s if i % 2 else s[::-1].translate(comp)))
    got = reads.assign_genes(spark.createDataFrame(rows, "read_id int, nuc string"), genes).collect()
    assert {(r.read_id, r.region): (r.gene, r.strand) for r in got} == {k: x for i, (g, h, s) in truth.items() for k, x in (((i, "V"), (g, s)), ((i, "J"), (h, s)))}


def test_cdr3_of_a_read(spark):
    df = spark.createDataFrame([(1, "a" + "tgtgccagcagcttaggttacttc" + "ttcggcgcgggc"), (2, "acgt")], "read_id int, nuc string")
    got = {r.read_id: r for r in reads.find_cdr3(df).collect()}
    assert got[1].status == "OK" and got[1].cdr3 == "CASSLGYF" and got[1].cdr3_nuc == "tgtgccagcagcttaggttacttc" and got[1].frame == 2
    assert got[2].status == "no_cdr3" and got[2].cdr3 is None


def test_chain_pairing(spark):
    p = spark.createDataFrame([("a1", "b1", 10), ("a1", "b2", 2), ("a2", "b2", 5), ("a3", "b1", 4), ("a9", "b9", 1)], "a string, b string, support long")
    got = {(r.a, r.b) for r in pairing.accepted_pairs(p).collect()}
    assert got == {("a1", "b1"), ("a2", "b2"), ("a3", "b1"), ("a9", "b9")}
    contigs = spark.createDataFrame(
        [("c1", "TRA", "TRAV1", "TRAJ1", "CAF", "tgc", 5, "t1", "True"), ("c1", "TRB", "TRBV1", "TRBJ1", "CBF", "tgt", 7, "t1", "True"), ("c2", "TRA", "TRAV1", "TRAJ1", "CAF", "tgc", 3, "t1", "True"),
         ("c3", "TRA", "TRAV1", "TRAJ1", None, "tgc", 3, "t2", "True"), ("c4", "TRB", "TRBV1", "TRBJ1", "CBF", "tgt", 1, "t2", "False")],
        "barcode string, chain string, v_gene string, j_gene string, cdr3 string, cdr3_nt string, umis int, raw_clonotype_id string, productive string",
    )
    use = pairing.usable_contigs(contigs)
    assert use.count() == 3 and {r.v for r in use.collect()} == {"TRAV1*01", "TRBV1*01"}
    chains, sizes = pairing.clonotype_chains(use), pairing.barcodes(use)
    assert {(r.chain, r.umis) for r in chains.collect()} == {("A", 8), ("B", 7)} and sizes.first().barcodes == "c1,c2"
    assert pairing.chain_pairs(chains, sizes).first().support == 2 and pairing.paired_clones(chains, sizes).first()["size"] == 2


def test_average_scores_and_fake_chain(spark):
    m = spark.createDataFrame([("c", 9.6), ("c", 2.0), ("c", 4.0), ("d", 9.6)], "c string, s double")
    assert {r.c: r.s for r in clones.average_scores(m, "c", "s", 9.6).collect()} == {"c": 3.0, "d": 9.6}
    assert clones.fake_chain(m.withColumn("g", F.lit("x")).withColumn("q", F.lit("y")), "q", "g").first().is_fake


def test_sources(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("#id\tgenes\tx\nr1\tg2;g1;g1\t-\nr2\tg3\t5\n")
    df = sources.read_tsv(spark, str(tmp_path / "a.tsv"))
    assert df.columns == ["id", "genes", "x"] and df.where("x is null").count() == 1
    assert df.select(sources.list_cell("genes").alias("g")).first().g == ["g1", "g2"]
    sources.write_tsv(df.withColumn("genes", sources.list_cell("genes")), str(tmp_path / "out"))
    back = sources.read_tsv(spark, str(tmp_path / "out"))
    assert {tuple(r) for r in back.collect()} == {("r1", "g1;g2", None), ("r2", "g3", "5")}
    assert sources.union_common([df, df.drop("x")]).columns == ["id", "genes"]
    (tmp_path / "f.fa").write_text(">one|Mus\nac\ngt\n>two|Homo\ntt\n")
    assert {(r.header, r.sequence) for r in sources.read_fasta(spark, str(tmp_path / "f.fa")).collect()} == {("one|Mus", "acgt"), ("two|Homo", "tt")}
    (tmp_path / "t.log").write_text("TUPLE_COUNT 5 g1,g2 human f\nnoise\nPROB_A_v_trim 0.5 0.5\n")
    assert sources.read_tuple_counts(spark, str(tmp_path / "t.log")).first().genes == ["g1", "g2"]
    assert sources.read_probabilities(spark, str(tmp_path / "t.log")).count() == 2
    mixed = spark.createDataFrame([("V1,V2", "J1", "CASSLF", "acg", "3"), ("V1", "J1", "CAF", "acg", "1"), ("V9", "J1", "CASSLF", "acg", "x")], "`V segments` string, `J segments` string, `CDR3 amino acid sequence` string, `CDR3 nucleotide sequence` string, Count string")
    good, bad = sources.convert_clonotypes(mixed, spark.createDataFrame([("V1",), ("J1",)], "gene string"))
    assert [r.clone_size for r in good.collect()] == [3] and {r.reason for r in bad.collect()} == {"short_cdr3", "unknown_gene"}


def test_distinct_junctions_against_a_sequential_scan(spark):
    rows = [(i, rng.choice("xyz"), rng.sample(["V1", "V2", "V3", "V4", "V5"], rng.randint(1, 3)), rng.sample(["J1", "J2", "J3"], rng.randint(1, 2))) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, nuc string, v_genes array<string>, j_genes array<string>")
    seen, kept = set(), set()
    for i, nuc, vs, js in rows:
        combos = {(nuc, v, j) for v in vs for j in js}
        if not combos & seen:
            seen |= combos
            kept.add(i)
    assert {r.id for r in reads.distinct_junctions(df).collect()} == kept
    assert reads.distinct_junctions(df.limit(0)).count() == 0


def test_rank_against_a_reference_with_ties(spark):
    values = spark.createDataFrame([("k", float(v)) for v in (0, 1, 2, 2.5, 3, 9)], "k string, v double")
    reference = spark.createDataFrame([("k", float(v)) for v in (1, 2, 2, 3)], "k string, v double")
    got = {r.v: round(r["rank"], 6) for r in neighbors.rank_against(values, reference, ["k"], "v").collect()}
    want = {}
    ref = [1, 2, 2, 3]
    for v in (0, 1, 2, 2.5, 3, 9):
        lower, upper, equal = [x for x in ref if x < v], [x for x in ref if x > v], ref.count(v)
        if not upper:
            want[v] = 100.0
        elif not lower:
            want[v] = 0.0
        else:
            want[v] = round(100 * (len(lower) + (v - max(lower)) / (min(upper) - max(lower)) * (1 + equal)) / len(ref), 6)
    assert got == want


def test_sample_per_key_does_not_depend_on_partitions(spark):
    from repertoire.operators.sampling import sample_per_key

    df = spark.range(200).withColumn("k", F.col("id") % 3)
    one = {r.id for r in sample_per_key(df.repartition(1), ["k"], "id", 7).collect()}
    assert one == {r.id for r in sample_per_key(df.repartition(5), ["k"], "id", 7).collect()} and len(one) == 21
    assert one != {r.id for r in sample_per_key(df, ["k"], "id", 7, seed=2).collect()}


def test_clonotypes_are_reduced_to_accepted_pairs(spark):
    row = lambda ct, bc, chain, n: (ct, f"{ct}-{bc}", chain, "V1", "J1", f"CA{n}", f"t{n}", "True", 5, f"{ct}_{chain}")
    data = [row("c1", i, c, n) for i in range(8) for c, n in (("TRA", 1), ("TRB", 2))]
    data += [row("c2", i, c, n) for i in range(8) for c, n in (("TRA", 3), ("TRB", 4))]
    data += [row("c3", 0, c, n) for c, n in (("TRA", 1), ("TRB", 2), ("TRB", 4))]  # 1 with 4 in one cell only
    data += [row("c4", 0, c, n) for c, n in (("TRA", 5), ("TRB", 6), ("TRB", 7))]  # both pairs hold up: two betas
    contigs = spark.createDataFrame(data, "raw_clonotype_id string, barcode string, chain string, v_gene string, j_gene string, cdr3 string, cdr3_nt string, productive string, umis long, raw_consensus_id string")
    use = pairing.usable_contigs(contigs)
    chains, sizes = pairing.clonotype_chains(use), pairing.barcodes(use)
    left = pairing.accepted_chains(chains, pairing.accepted_pairs(pairing.chain_pairs(chains, sizes)))
    got = {r.clonotype: (r.b.split("|")[2], r["size"]) for r in pairing.paired_clones(left, sizes).collect()}
    assert got == {"c1": ("CA2", 8), "c2": ("CA4", 8), "c3": ("CA2", 1)}
    assert "c3" not in {r.clonotype for r in pairing.paired_clones(chains, sizes).collect()}


def test_single_cell_query_keeps_contigs_of_few_umis(spark, monkeypatch):
    from repertoire.plans import registry

    row = lambda ct, chain, n: (ct, ct, chain, "V1", "J1", f"CA{n}", f"t{n}", "True", 5, f"{ct}_{chain}")
    contigs = spark.createDataFrame([row("c1", "TRA", 1), row("c1", "TRB", 2)], "raw_clonotype_id string, barcode string, chain string, v_gene string, j_gene string, cdr3 string, cdr3_nt string, productive string, umis long, raw_consensus_id string")
    monkeypatch.setattr(registry, "_contigs", lambda spark, d: contigs)
    assert [r.clonotype for r in registry.queries()["single_cell_clones"](spark, "").collect()] == ["c1"]
