"""Gene tables from reference sequences, probability files, junction qualities."""

import random

import pytest
from pyspark.sql import functions as F

from repertoire.functions import tables
from repertoire.operators import background, genes, junctions, parsing
from repertoire.plans import germline
from repertoire.sources import genedb, probabilities
from repertoire.sources import tables as sources


def translated(nuc):
    code = tables.genetic_code()
    return "".join(code[nuc[i : i + 3]] for i in range(0, len(nuc) - 2, 3))


def fasta(path, rows):
    path.write_text("".join(f">acc|{g}|{s}|F|{r}|x\n{seq[:50]}\n{seq[50:]}\n" for g, s, r, seq in rows))
    return f"file://{path}"


def test_fasta_to_gene_table_and_back(spark, tmp_path):
    species = "Homo sapiens"
    aligned, nucs = [], []
    for gene, _, region, nuc, frame, protein, *_ in germline.germline_rows():
        aligned.append((gene, species, f"{region}-REGION", protein))
        nucs.append((gene, species, f"{region}-REGION", nuc))
    v = germline.germline_rows()[0]
    aligned += [("TRAV90*01", species, "V-REGION", v[5].replace("..", "") + "AA"), ("TRAJ90*01", species, "J-REGION", "AAAAAAKKKK"), ("TRGV1*01", species, "V-REGION", v[5]), ("TRAV91*01", species, "V-REGION", v[5])]
    nucs += [("TRAV90*01", species, "V-REGION", v[3]), ("TRAJ90*01", species, "J-REGION", "gc" * 15), ("TRGV1*01", species, "V-REGION", v[3]), ("TRBD1*01", species, "D-REGION", "gggacagggggc"), ("TRAV1*01", "Mus musculus", "V-REGION", "acg")]
    loops = ((26, 31), (49, 58), (75, 80))
    layouts = {"A": genedb.Layout("A", loops, germline.V_CODONS + 3), "B": genedb.Layout("B", loops, germline.V_CODONS + 3)}
    table, rejected = genedb.genes_from_fasta(spark, fasta(tmp_path / "aa.fa", aligned), fasta(tmp_path / "nt.fa", nucs), layouts, organism="human", species=species)
    assert {(r.gene, r.reason) for r in rejected.collect()} == {("TRAV90*01", "no_frame"), ("TRAJ90*01", "no_frame"), ("TRGV1*01", "no_layout"), ("TRAV91*01", "no_nucleotides")}
    sources.write_tsv(table.orderBy("gene"), f"file://{tmp_path}/genes")
    back = sources.read_genes(spark, f"file://{tmp_path}/genes")
    got = {r.gene: r for r in back.collect()}
    assert len(got) == 20 and got["TRBD1*01"].region == "D"
    for gene, chain, region, nuc, frame, protein, cdrs, spans in germline.germline_rows():
        r = got[gene]
        assert (r.organism, r.chain, r.region, r.nucseq, r.frame) == ("human", chain, region, nuc, frame)
        if region == "V":
            assert r.aligned_protseq == protein and r.cdrs == cdrs and [(s.start, s.stop) for s in r.cdr_columns] == spans
        else:  # up to the G-x-G, with the residue before it
            assert r.cdrs == [protein[: germline.J_LOOP + 1]] and [(s.start, s.stop) for s in r.cdr_columns] == [(1, germline.J_LOOP + 1)]
    good, bad = genedb.checked_genes(back.where("region <> 'D'"))
    assert good.count() == 19 and bad.count() == 0
    facts = {r.gene: r for r in parsing.gene_facts(good).collect()}
    assert facts["TRAV0*01"].c_place == germline.V_CODONS and facts["TRAJ0*01"].loop == germline.J_LOOP + 1 and facts["TRAJ0*01"].offset == 1


def test_inserted_columns_and_shifted_j_genes(spark):
    a, b = "gcc" * 6 + "ttt" + "ggcgccggc" + "gcc", "gcc" * 3 + "tgg" + "ggcgccggc" + "gcc" * 4
    v = "gcc" * 4 + "tgtgcc"
    rows = [("TRDV1*01", "V", "AA.AACA", v), ("TRAJ1*01", "J", translated(a), a), ("TRAJ2*01", "J", translated(b), b)]
    named = [(f"x|{g}|Homo sapiens|F|{r}-REGION|", s, n) for g, r, s, n in rows]
    frame = lambda i: spark.createDataFrame([(x[0], x[i]) for x in named], "header string, sequence string")
    layouts = {"D": genedb.Layout("A", ((1, 2),), 8, (2,)), "A": genedb.Layout("A", ((1, 2),), 8)}
    table, bad = genedb.build_genes(frame(1), frame(2), layouts, organism="o", species="Homo")
    got = {r.gene: r for r in table.collect()}
    assert bad.count() == 0
    assert got["TRDV1*01"].aligned_protseq == "A.A.AACA" and got["TRDV1*01"].cdrs == "A.;A"
    assert got["TRAJ1*01"].aligned_protseq == "AAAAAAFGAGA..." and got["TRAJ2*01"].aligned_protseq == "...AAAWGAGAAAA"
    assert got["TRAJ1*01"].cdrs == "AAAAAAF" and got["TRAJ2*01"].cdrs == "...AAAW"


def test_probability_files_round_trip(spark, tmp_path):
    rows = [("o", "A", "v_trim", str(i), p) for i, p in ((0, 0.5), (1, 0.25), (3, 0.25))] + [("o", "A", "vj_insert", "0", 1.0), ("o", "A", "j_trim", "0", 1.0)]
    rows += [("o", "B", "D1_d01_trim", f"{i},{j}", 0.125) for i in (0, 10) for j in (0, 2, 3, 11)]
    rows += [("o", "B", f"D{d}_{t}", str(i), p) for d in (1, 2) for t in probabilities.MEAN_TAGS for i, p in ((0, 0.75), (d, 0.25))]
    table = spark.createDataFrame(rows, "organism string, chain string, tag string, key string, p double")
    freq = spark.createDataFrame([("AV", "TRAV1", 0.4), ("AV", "TRAV2", 0.6)], "tag string, gene string, p double")
    for name in ("o", "q"):
        probabilities.write_probabilities(table, freq, f"file://{tmp_path}/{name}")
    lines = [r.value for r in spark.read.text(f"file://{tmp_path}/o").collect()]
    assert lines[:3] == ["AV_COUNTREP_FREQ: 40.000000 TRAV1", "AV_COUNTREP_FREQ: 60.000000 TRAV2", "AV_COUNTREP_TOTALFREQ: 100.000000"]
    assert lines[3] == "PROB_A_v_trim  0.500000000  0.250000000  0.000000000  0.250000000"
    assert lines[6].startswith("PROB_B_D1_d01_trim  0,0:  0.125000000 0,2:  0.125000000 0,3:") and lines[6].endswith("10,11:  0.125000000")
    back, frequencies = probabilities.read_tagged(spark, {"o": f"file://{tmp_path}/o", "q": f"file://{tmp_path}/q"})
    assert sorted(tuple(r) for r in frequencies.where("organism = 'q'").select("tag", "gene", "p").collect()) == [("AV", "TRAV1", 0.4), ("AV", "TRAV2", 0.6)]
    got = {(r.chain, r.tag, r.key): r.p for r in back.where("organism = 'o'").collect()}
    for _, chain, tag, key, p in rows:
        assert got[chain, tag, key] == pytest.approx(p)
    assert got["A", "v_trim", "2"] == 0 and got["B", "vd_insert", "1"] == pytest.approx(0.125) and got["B", "dj_insert", "0"] == pytest.approx(0.75)
    t = probabilities.trim_tables(back, "q", "A")
    assert t.v_trim == pytest.approx([0.5, 0.25, 0, 0.25]) and t.vj_insert == [1.0]
    b = probabilities.trim_tables(back, "q", "B", {1: "gggacagggggc"})
    assert b.vd_insert == pytest.approx([0.75, 0.125, 0.125]) and b.d_trim[1][10, 11] == pytest.approx(0.125)
    assert junctions.generation_probability("tgtgcc", "gcctt", "CAAF"[:3], t) >= 0
    x = spark.createDataFrame([("o", 0, 0, 0), ("o", 2, 0, 0), ("o", 9, 0, 0), ("z", 0, 0, 0)], "organism string, v_trim int, j_trim int, vj_insert int")
    assert [r.probability for r in probabilities.trim_probability(x, back, "A").collect()] == [0.5, 0.0, 0.0, 1.0]


def test_postings_and_draws(spark, monkeypatch):
    monkeypatch.setattr(background, "BUCKET", 7)
    rng = random.Random(4)
    rows = [(i, [rng.choice("VWX"), "V"], [rng.choice("JK")], f"c{i}") for i in range(300)]
    chains = spark.createDataFrame([*rows, rows[0]], "chain_id long, v_reps array<string>, j_reps array<string>, cdr3 string")
    index = background.postings(chains).cache()
    lists = {}
    for r in index.collect():
        lists.setdefault((r.v_rep, r.j_rep), []).append((r.place, r.chain_id, r.n))
    for (v, j), found in lists.items():
        want = {i for i, vs, js, _ in rows if v in vs and j in js}
        assert sorted(p for p, *_ in found) == list(range(len(want))) and {i for _, i, _ in found} == want and {n for *_, n in found} == {len(want)}
    few = spark.createDataFrame([(1, "V", "J"), (2, "W", "K"), (3, "V", "J"), (4, "Z", "J")], "clone_id long, v_rep string, j_rep string")
    drawn = background.sampled(few, index, 40).collect()
    for i, v, j in ((1, "V", "J"), (2, "W", "K"), (3, "V", "J")):
        own = [r.chain_id for r in drawn if r.clone_id == i]
        assert len(own) == len(set(own)) == min(40, len(lists[v, j])) and set(own) <= {c for _, c, _ in lists[v, j]}
    assert not [r for r in drawn if r.clone_id == 4]


def brute_qualities(read, quals, junction):
    read, junction = read.upper(), junction.upper()
    back = read[::-1].translate(str.maketrans("ACGT", "TGCA"))
    n = len(junction)
    for text, values in ((read, quals), (back, quals[::-1])):
        at = [i for i in range(len(text) - n + 1) if text[i : i + n] == junction]
        if at:
            best = max(at, key=lambda i: (min(values[i : i + n]), -i))
            return values[best : best + n]
    found = []
    for k, (text, values) in enumerate(((read, quals), (back, quals[::-1]))):
        parts = [(a + b, k, a, b) for a in range(n) for b in range(n - a) if junction[a : n - b] in text]
        if parts:
            found.append((*min(parts), text, values))
    if not found:
        return [60] * n
    _, _, a, b, text, values = min(found, key=lambda x: x[:3])
    i = text.find(junction[a : n - b])
    return [60] * a + values[i : i + n - a - b] + [60] * b


def test_junction_qualities(spark):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        read = "".join(rng.choice("acgt") for _ in range(60))
        k = rng.randrange(40)
        junction = read[k : k + rng.randint(1, 20)]
        junction = {0: junction, 1: junction + "".join(rng.choice("acgt") for _ in range(4)), 2: "gg" + junction, 3: "acac" * 3, 4: "n" * 5}[i % 5]
        if i % 2:
            read = read[::-1].translate(str.maketrans("acgt", "tgca"))
        rows.append((i, read, [rng.randint(2, 59) for _ in read], junction))
    df = spark.createDataFrame(rows, "i int, read string, quals array<int>, junction string")
    got = {r.i: r.q for r in df.select("i", parsing.junction_qualities(F.col("read"), F.col("quals"), F.col("junction")).alias("q")).collect()}
    assert got == {i: brute_qualities(read, quals, junction) for i, read, quals, junction in rows}


def test_classes_of_several_genes(spark):
    got = genes.gene_classes(germline.gene_rows(spark, "/root/testdata/sf0.01")).collect()
    assert len({r.mm1_rep for r in got}) < len({r.rep for r in got}) < len(got) and len({r.count_rep for r in got}) <= len({r.mm1_rep for r in got})
