"""Filters, scans, trees and reports that SQL does not state, against brute force."""

import collections
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest

from repertoire.operators import clustering, distance, junctions, neighbors, ranks, reports, stats, trees
from repertoire.sources import matchlogs, paired
from repertoire.sources import tables as sources


def test_global_row_numbers_on_any_partitions(spark):
    df = spark.createDataFrame([(i * 7 % 101, f"x{i}") for i in range(101)], "k long, v string")
    for n in (1, 4, 9):
        got = {r.k: r.line for r in ranks.global_row_number(df.repartition(n), ["k"], "line", partitions=n).collect()}
        assert got == {k: k + 1 for k in range(101)}


def clones_of(spark, n, seed=1, epitopes="EF"):
    rng = random.Random(seed)
    seq = lambda k: "CA" + "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(k)) + "F"
    rows = [(i, rng.choice(epitopes), rng.randint(0, 3), seq(rng.randint(5, 9)), seq(rng.randint(5, 9)), [f"VA{rng.randint(0, 2)}"], ["VB1"]) for i in range(n)]
    return spark.createDataFrame(rows, "clone_id long, epitope string, subject long, cdr3a string, cdr3b string, va_genes array<string>, vb_genes array<string>")


def test_nearest_distances_do_not_depend_on_blocks_and_stay_bounded(spark):
    c = clones_of(spark, 120)
    whole = {(r.clone_id, r.chains): (r.n, r.nearest) for r in distance.nearest_distances(c, None, largest_percentile=100).collect()}
    cut = {(r.clone_id, r.chains): (r.n, r.nearest) for r in distance.nearest_distances(c, None, largest_percentile=100, block=17).collect()}
    assert whole == cut
    rows = c.collect()
    pairs = {(r.id1, r.id2): r.dist for r in distance.pairs_within(c, None, None, chains=("A",), block=13).collect()}
    for r in rows:
        d = sorted(pairs[tuple(sorted((r.clone_id, o.clone_id)))] for o in rows if o.clone_id != r.clone_id and o.epitope == r.epitope and o.subject != r.subject)
        n, nearest = whole[r.clone_id, "A"]
        assert n == len(d) and [x.d for x in nearest for _ in range(x.n)] == d and [x.d for x in nearest] == sorted(set(d))


@pytest.mark.parametrize("scale", [1.0, 0.37])
def test_smallest_counts_send_values_not_pairs(scale):
    rng = np.random.default_rng(3)
    d = rng.integers(0, 40, (50, 3000)).astype(np.float32) * np.float32(scale)
    good = rng.random(d.shape) > 0.3
    good[7] = False
    depth = np.full(50, 900)
    row, value, count = distance.smallest_counts(d, good, depth)
    assert len(row) <= 50 * 42
    for i in range(50):
        mine = [(v, n) for k, v, n in zip(row, value, count, strict=True) if k == i]
        assert sum(n for _, n in mine) == good[i].sum()
        want = sorted(d[i][good[i]].tolist())[:900]
        have = [v for v, n in mine if np.isfinite(v) for _ in range(n)]
        assert np.allclose(have[: len(want)], want)


def test_pair_sums_do_not_depend_on_blocks(spark):
    c = clones_of(spark, 60)
    key = lambda r: (r.epitope1, r.subject1, r.subject2, r.chains)
    a, b = ({key(r): (r.n, round(r.total, 3)) for r in distance.pair_sums(c, None, lambda d, _: d, block=k).collect()} for k in (1500, 7))
    assert a == b and all(a[e, s, t, x] == a[e, t, s, x] for e, s, t, x in a)


def test_score_of_counts_is_that_of_lists(spark):
    rng = random.Random(2)
    values = sorted(rng.randint(0, 9) for _ in range(57))
    listed = spark.createDataFrame([(1, 57, [float(v) for v in values])], "id long, n long, nearest array<double>")
    counted = spark.createDataFrame([(1, 57, [(float(v), n) for v, n in sorted(collections.Counter(values).items())])], "id long, n long, nearest array<struct<d:double,n:long>>")
    for p in (5, 10, 25, -4):
        k = max(1, min(57, -p) if p < 0 else 57 * p // 100)
        plain, top = sum(values[:k]) / k, sum(v * (1 - i / k) for i, v in enumerate(values[:k])) / ((k + 1) / 2)
        for df in (listed, counted):
            r = neighbors.neighbor_scores(df, (p,)).first()
            assert r.nbrdist == pytest.approx(plain) and r.wtd_nbrdist == pytest.approx(top)


def test_kendall_against_all_pairs(spark):
    rng = random.Random(6)
    rows = [(i, "E", float(rng.randint(0, 5)), float(rng.randint(0, 5))) for i in range(40)]
    s = nx = ny = 0
    for a, b in itertools.combinations(rows, 2):
        x, y = np.sign(a[2] - b[2]), np.sign(a[3] - b[3])
        s, nx, ny = s + x * y, nx + abs(x), ny + abs(y)
    got = stats.kendall(spark.createDataFrame(rows, "clone_id long, epitope string, x double, y double"), "epitope", "x", "y").first()
    assert got.tau == pytest.approx(s / math.sqrt(nx * ny))


def test_pair_weights_meet_their_targets():
    pairs = pd.DataFrame({"v": ["a", "a", "b", "b", "c"], "j": ["x", "y", "x", "y", "y"], "n": [5, 1, 3, 4, 2]})
    targets = [{"a": 2.0, "b": 7.0, "c": 1.0}, {"x": 3.0, "y": 7.0}]
    w = reports.fit_pair_weights(pairs, targets) * pairs["n"]
    for c, want in zip(("v", "j"), targets, strict=True):
        for g, share in want.items():
            assert w[pairs[c] == g].sum() / pairs["n"].sum() == pytest.approx(share / sum(want.values()), abs=1e-3)


def test_reweighted_positions(spark):
    rows = [(1, "a", "x", "AC")] * 5 + [(1, "a", "y", "AD")] + [(1, "b", "x", "CC")] * 3 + [(1, "b", "y", "DD")] * 4
    targets = [(1, "a", "x")] * 3 + [(1, "b", "y")] * 7
    got = reports.reweighted_positions(spark.createDataFrame(rows, "k long, v string, j string, s string"), spark.createDataFrame(targets, "k long, v string, j string"), ["k"], "s", "ACD")
    first = {r.letter: r.freq for r in got.where("pos = 0").collect()}
    assert first["A"] == pytest.approx(0.3, abs=0.01) and sum(first.values()) == pytest.approx(1)


def tree_of(spark, n=12):
    rng = random.Random(5)
    at = [rng.random() for _ in range(n)]
    pairs = [("g", i, j, abs(at[i] - at[j])) for i in range(n) for j in range(i + 1, n)]
    return clustering.trees(spark.createDataFrame(pairs, "g string, id1 long, id2 long, dist double"), "g")


def test_nodes_have_their_leaves(spark):
    t = tree_of(spark)
    leaves = collections.defaultdict(set)
    for r in trees.node_leaves(t, "g").collect():
        leaves[r.node].add(r.id)
    rows = t.collect()
    assert sorted(leaves) == list(range(23)) and all(len(leaves[i]) == 1 for i in range(12))
    assert all(leaves[r.left] | leaves[r.right] == set(r.leaves) == leaves[r.node] and not leaves[r.left] & leaves[r.right] for r in rows)


def test_splits_against_plain_tests(spark):
    t = tree_of(spark)
    score = {i: float(i * i % 7) for i in range(12)}
    got = {r.node: r for r in trees.split_tests(trees.node_leaves(t, "g"), spark.createDataFrame(list(score.items()), "id long, score double"), "g").collect()}
    assert got
    for node in t.collect():
        if node.node not in got:
            continue
        a, b = [score[i] for i in node.leaves], [score[i] for i in score if i not in node.leaves]
        u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
        va, vb = np.var(a, ddof=1), np.var(b, ddof=1)
        pooled = (np.mean(a) - np.mean(b)) / math.sqrt(((len(a) - 1) * va + (len(b) - 1) * vb) / (len(a) + len(b) - 2) * (1 / len(a) + 1 / len(b)))
        r = got[node.node]
        assert r.u == pytest.approx(u) and r.t == pytest.approx(pooled) and r.welch == pytest.approx((np.mean(a) - np.mean(b)) / math.sqrt(va / len(a) + vb / len(b)))
        assert r.max_p == max(r.p, r.p_welch, r.p_u) and 0 < r.p < 1


def test_chosen_subtrees_add_leaves(spark):
    t = tree_of(spark)
    got = trees.choose_subtrees(t, "g", max_height=0.6, least=2).orderBy("rank").collect()
    leaves = {r.node: set(r.leaves) for r in t.collect()}
    shown: set = set()
    for r in got:
        assert r.new == len(leaves[r.node] - shown) >= 1 and r.size == len(leaves[r.node]) and r.size - r.new <= 0.25 * r.size
        shown |= leaves[r.node]
    assert got and got[0].size >= 2


def test_total_trims_are_normalised(spark):
    trims = spark.createDataFrame([(1, 0, 2, 0.5), (1, 1, 1, 0.25), (1, 0, 0, 0.25)], "d long, d0 int, d1 int, p double")
    got = {(r.d0, r.d1): r.p for r in junctions.with_total_d_trims(trims, spark.createDataFrame([(1, 3)], "d long, length int")).collect()}
    assert got[0, 3] == pytest.approx(0.5625 / 1.5625) and sum(got.values()) == pytest.approx(1)


def test_beta_probability_sums_to_one_over_all_sequences():
    t = junctions.TrimTables([0.5, 0.5], [0.7, 0.3], vd_insert=[0.6, 0.4], dj_insert=[0.8, 0.2], d_trim={1: {(0, 0): 0.5, (1, 1): 0.5}}, d_genes={1: "gg"}, d_prob={1: 1.0})
    lengths = range(2, 9)
    total = 0.0
    for n in lengths:
        for s in map("".join, itertools.product("acgt", repeat=n)):
            total += _by_parts("ac", "ta", s, t)
    assert total == pytest.approx(1)
    for s in ("acggta", "aggt", "acta", "acgta", "aaggta"):
        got = junctions.generation_probability("ac", "ta", "", t, nuc=s)
        assert got == pytest.approx(_by_parts("ac", "ta", s, t), rel=0.2) or got <= _by_parts("ac", "ta", s, t)


def _by_parts(v, j, nuc, t):
    out = 0.0
    for a, b in itertools.product(range(len(t.v_trim)), range(len(t.j_trim))):
        left, right = v[: len(v) - a], j[b:]
        for (d0, d1), p in t.d_trim[1].items():
            d = t.d_genes[1][d0 : len(t.d_genes[1]) - d1]
            for x, y in itertools.product(range(len(t.vd_insert)), range(len(t.dj_insert))):
                if len(left) + x + len(d) + y + len(right) == len(nuc) and nuc.startswith(left) and nuc.endswith(right) and nuc[len(left) + x :].startswith(d):
                    out += t.v_trim[a] * t.j_trim[b] * p * t.vd_insert[x] * t.dj_insert[y] * 0.25 ** (x + y)
    return out


def test_match_logs(spark, tmp_path):
    match = "v_offset: x vseg: TRAV1 score: 50 offset: 3 start: 0 stop: 40 mm: 1 reversed: 1 jseg: TRAJ2 score: 20 offset: 1 start: 60 stop: 80 mm: 0 reversed: 1 all_v_hits: TRAV1,TRAV2 all_j_hits: TRAJ2 tsvfile_line_number: 17 a b c d e nucleic: ACGT filename: f.fq"
    (tmp_path / "raw.log").write_text(match + "\n" + match.replace("TRAJ2", "UNK") + "\nother\n")
    r = matchlogs.read_match_log(spark, str(tmp_path / "raw.log")).collect()
    assert len(r) == 1 and (r[0].id, r[0].v_gene, r[0].v_score, r[0].v_stop, r[0].j_start, r[0].v_reversed, r[0].v_genes, r[0].nuc, r[0].file) == ("L17", "TRAV1", 50, 40, 60, 1, ["TRAV1", "TRAV2"], "acgt", "f.fq")
    head = ["GENES", "V", "Vr", "x", "J", "Jr", "x", "CAF", "x", "x", "x", "x", "new", "C-F"]
    alpha = [*head, "-3", "-2", "4", "V,W", "J", "tgcgcc", "log:f.tsv:9"]
    one = ["D2", "5", "-1", "-2", "-3", "-4", "6", "7", "x", "x"]
    beta = [*head[:14], *one, "D0", *one[1:8], "V", "J", "tgc", "log:g.tsv:1"]
    bad = [*head[:14], "D0", *one[1:], *one[:8], "V", "J", "tgc", "log:g.tsv:1"]
    (tmp_path / "a.log").write_text("\n".join([" ".join(alpha), "GENES too short", "no"]))
    (tmp_path / "b.log").write_text("\n".join([" ".join(beta), " ".join(bad)]))
    rows, rest = matchlogs.read_genes_log(spark, str(tmp_path / "a.log"), "A")
    a = rows.first()
    assert (a.v_trim, a.j_trim, a.vj_insert, a.v_genes, a.cdr3_nuc, a.file) == (3, 2, 4, ["V", "W"], "tgcgcc", "f.tsv") and rest.count() == 1
    rows, rest = matchlogs.read_genes_log(spark, str(tmp_path / "b.log"), "B")
    b = rows.first()
    assert [d.asDict() for d in b.d] == [{"d_id": 2, "d_nucs": 5, "v_trim": 1, "d0_trim": 2, "d1_trim": 3, "j_trim": 4, "vd_insert": 6, "dj_insert": 7}] and rest.count() == 1


def test_paired_tables_and_catalog(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("id\ta_nucseq\ta_quals\tb_nucseq\tb_quals\ta_v_hits\n1\tTGTGCC\t30.20.40.5.9.9\tacg\t1.2.3\tV1:5;V2:9\n")
    paired.register("small", "p.tsv", "mouse")
    r = paired.load(spark, "small", str(tmp_path)).first()
    assert (r.a_frame1, r.a_least_quality, r.b_revcomp, r.va_genes, r.organism) == ("CA", 5, "cgt", ["V2"], "mouse")
    with pytest.raises(KeyError, match="small"):
        paired.load(spark, "none", str(tmp_path))


def test_frequency_lines(spark, tmp_path):
    (tmp_path / "f.log").write_text("AV_COUNTREP_FREQ:    12.500 TRAV1*01\nPROB_B_D1_d01_trim 0,0: 0.25 1,2: 0.75\nPROB_A_v_trim 0.5 0.5\n")
    r = sources.read_gene_frequencies(spark, str(tmp_path / "f.log")).collect()
    assert [(x.tag, x.gene, x.p) for x in r] == [("AV", "TRAV1*01", 0.125)]
    p = {(x.chain, x.tag, x.key): x.p for x in sources.read_probabilities(spark, str(tmp_path / "f.log")).collect()}
    assert p == {("B", "D1_d01_trim", "0,0"): 0.25, ("B", "D1_d01_trim", "1,2"): 0.75, ("A", "v_trim", "0"): 0.5, ("A", "v_trim", "1"): 0.5}


def test_listed_distances(spark):
    c = clones_of(spark, 12, epitopes="E")
    want = {(r.id1, r.id2): r.dist for r in distance.pairs_within(c, None, None, chains=("AB",)).collect()}
    asked = spark.createDataFrame([(0, 5), (3, 4), (11, 2)], "id1 long, id2 long")
    for r in distance.with_distance(asked, c, None).collect():
        assert r.dist == pytest.approx(want[min(r.id1, r.id2), max(r.id1, r.id2)])
