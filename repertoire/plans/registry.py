"""Registry of the driver queries (name -> callable) and their SQL oracles.

Every query runs an operator over whole fixture tables (see ``fixtures``). Doubles are rounded where
sums may differ in their last digits between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repertoire.functions import sequences as seq
from repertoire.functions import tables
from repertoire.operators import clones as calls
from repertoire.operators import clustering, distance, diversity, junctions, motifs, neighbors, pairing, permutation, sampling, stats, usage
from repertoire.operators import genes as gene_dim
from repertoire.operators import reads as parsing
from repertoire.operators.graph import _ready
from repertoire.plans import fixtures, germline, metrics, reports
from repertoire.plans.base import clones, for_each, genes, r, reads, tuples
from repertoire.plans.oracles import ORACLES
from repertoire.sources import tables as sources

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_QUERIES, **reports.QUERIES, **germline.QUERIES, **metrics.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**{k: v for k, v in ORACLES.items() if k in _QUERIES}, **reports.SQL, **germline.SQL, **metrics.SQL}


def _scores(spark: SparkSession, d: str, **options) -> DataFrame:
    return distance.nearest_scores(clones(spark, d), genes(spark, d), 10, **options)


# scalars and filters


@query
def quality_min_filter(spark, d):
    """Least of '.'-joined qualities, reads below 20 dropped."""
    quals = F.concat_ws(".", F.col("qual").cast("string"), (F.col("qual") + 7).cast("string"), (F.col("qual") - 3).cast("string"))
    return reads(spark, d).select("read_id", seq.least_quality(quals).alias("least")).where("least >= 20")


@query
def cdr3_filter_status(spark, d):
    """Length window, residue alphabet, status text."""
    c = clones(spark, d)
    bad = F.array_compact(
        F.array(F.when(~F.length("cdr3a").between(9, 13), "a_length"), F.when(~F.length("cdr3b").between(9, 14), "b_length"), F.when(~F.col("cdr3a").rlike("^[ACDEFGHIKLMNPQRSTVWY]+$"), "a_residue"))
    )
    return c.select("clone_id", F.when(F.size(bad) == 0, "OK").otherwise(F.array_join(bad, ";")).alias("status"))


@query
def seq_revcomp_translate(spark, d):
    """Reverse complement and translation in two frames."""
    n = F.col("nuc_a")
    return reads(spark, d).select("read_id", seq.reverse_complement(n).alias("revcomp"), seq.translate_frame(n, 1).alias("p1"), seq.translate_frame(n, -2).alias("m2"))


@query
def seq_mismatch_iupac(spark, d):
    """Mismatches that respect ambiguous bases, and the best common prefix."""
    x = reads(spark, d)
    first = x.groupBy("subject", "epitope").agg(F.min_by("nuc_a", "read_id").alias("ref"))
    return x.join(first, ["subject", "epitope"]).select("read_id", seq.mismatches(F.col("nuc_a"), F.col("ref")).alias("mismatches"))


@query
def seq_property_sums(spark, d):
    """Charge and hydrophobicity of each CDR3."""
    c = clones(spark, d)
    s = F.col("cdr3b")
    return c.select("clone_id", r(seq.residue_sum(s, tables.CHARGE), 4).alias("charge"), r(seq.residue_sum(s, tables.GES, -1.0), 4).alias("ges"), r(seq.residue_sum(s, tables.HP), 4).alias("hp"))


@query
def cdr3_properties(spark, d):
    """Mean properties by epitope and chain."""
    return usage.property_means(clones(spark, d)).select("epitope", "chains", *[r(k, 5).alias(k) for k in ("length", "charge", "ges", "hp")])


@query
def cdr3_length_histogram(spark, d):
    """Histogram of CDR3 lengths."""
    return usage.property_histogram(clones(spark, d), F.length("cdr3b"))


# distances and neighbours


@query
def v_region_distance(spark, d):
    """Germline V distances."""
    return distance.v_region_distances(genes(spark, d))


@query
def cdr3_pairs_in_band(spark, d):
    """Pairs within one gap, joined on length bands."""
    c = clones(spark, d)
    return distance.length_band_pairs(c, "A", 19.0).select("id1", "id2", "dist")


@query
def receptor_pairs_within(spark, d):
    """Receptor pairs within the radius, chains A, B and AB."""
    return distance.pairs_within(clones(spark, d), genes(spark, d), diversity.THRESHOLD).select("chains", "id1", "id2", "dist")


@query
def receptor_distance_sums(spark, d):
    """All pairs of an epitope compared, mean distances within and between subjects."""
    s = distance.distance_sums(clones(spark, d), genes(spark, d))
    same = F.col("subject1") == F.col("subject2")
    rows = s.groupBy(F.col("unit").alias("epitope"), "chains", same.alias("same_subject")).agg(F.sum("n").alias("pairs"), F.sum("total").alias("total"))
    return rows.select("epitope", "chains", "same_subject", "pairs", r(F.col("total") / F.col("pairs"), 6).alias("mean_dist"))


@query
def nbrdist_10(spark, d):
    """Plain and weighted nearest-neighbour scores within each epitope."""
    s = _scores(spark, d)
    return s.select("clone_id", "chains", r("nbrdist", 4).alias("nbrdist"), r("wtd_nbrdist", 4).alias("wtd_nbrdist"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Neighbour scores of every clone and their ranks in the repertoire."""
    s = _scores(spark, d)
    # ranks read the scores twice
    _ready(spark)
    s = s.withColumn("wtd_nbrdist", r("wtd_nbrdist", 4)).checkpoint()
    ranked = neighbors.interpolated_rank(s, ["ref_epitope", "chains", "percentile"], "wtd_nbrdist")
    return ranked.select("clone_id", "chains", "wtd_nbrdist", r("rank", 4).alias("rank"))


@query
def nbrdist_rank(spark, d):
    return flagship(spark, d)


@query
def avg_nbrdist(spark, d):
    """Mean score by epitope and chain."""
    s = _scores(spark, d)
    return s.groupBy("epitope", "chains").agg(r(F.avg("nbrdist"), 4).alias("mean_nbrdist"))


@query
def auc_vs_others(spark, d):
    """How well scores against each repertoire tell its own clones from the others'."""
    s = _scores(spark, d, own_epitope=False)
    auc = neighbors.roc_area(s, ["chains", "ref_epitope"], r("wtd_nbrdist", 4), F.col("epitope") == F.col("ref_epitope"))
    return auc.select("chains", "ref_epitope", r("auc", 5).alias("auc"))


@query
def score_rank(spark, d):
    """E5, F2: interpolated rank of clone scores within the epitope."""
    return neighbors.interpolated_rank(clones(spark, d).select("clone_id", "epitope", "score"), ["epitope"], "score").select("clone_id", r("rank", 4).alias("rank"))


@query
def score_auc(spark, d):
    """Area under the curve of scores against shared clones."""
    c = clones(spark, d)
    return neighbors.roc_area(c, ["epitope"], F.round("score", -2), F.col("clone_size") > 2).select("epitope", r("auc", 6).alias("auc"))


@query
def repertoire_distance(spark, d):
    """Mean weighted neighbour score of a repertoire in another."""
    s = _scores(spark, d, own_epitope=False, intrasubject=True)
    return s.groupBy("epitope", "ref_epitope", "chains").agg(r(F.avg("wtd_nbrdist"), 4).alias("mean_wtd"))


# diversity and sharing


@query
def clonality_simpson(spark, d):
    """E13, J30."""
    x = diversity.clonality(clones(spark, d))
    return x.select("epitope", r("p", 9).alias("p"), r("diversity", 4).alias("diversity"), r("evenness", 9).alias("evenness"))


@query
def clonality_subjects(spark, d):
    """E13 by subject."""
    return diversity.clonality_by_subject(clones(spark, d)).select("epitope", "subject", "reads", r("p", 9).alias("p"))


@query
def tcrdiv_gaussian(spark, d):
    """E15."""
    x = diversity.gaussian_diversity(clones(spark, d), genes(spark, d))
    return x.select("epitope", "chains", "same_subject", r("overlap", 4).alias("overlap"), F.col("pairs").cast("double").alias("pairs"), r("diversity", 4).alias("diversity"))


@query
def gaussian_shannon(spark, d):
    """E16."""
    x = diversity.gaussian_shannon(clones(spark, d), genes(spark, d))
    return x.select("epitope", "chains", r("entropy", 5).alias("entropy"), r("diversity", 4).alias("diversity"), "n")


@query
def gene_sharing(spark, d):
    """Gene-only sharing between subjects."""
    c = clones(spark, d)
    x = diversity.sharing(diversity.gene_match_counts(c, "A"), c)
    return x.select("epitope", "overlap", "total", r("diversity", 5).alias("diversity"), "subject_pairs", "sharing_pairs", "top3")


@query
def threshold_sharing(spark, d):
    """Sharing by distance."""
    c = clones(spark, d)
    return diversity.sharing(distance.near_subjects(c, genes(spark, d), diversity.THRESHOLD, "B"), c).select("epitope", "overlap", "total", r("diversity", 5).alias("diversity"), "subject_pairs", "sharing_pairs", "top3")


def _receptors(spark, d):
    """Read groups as receptors with two V and two J genes a chain."""
    n = lambda c, k, m: F.concat(F.lit(c), ((F.col("read_id") * k + 1) % m).cast("string"))
    two = lambda a, b: F.array_sort(F.array_distinct(F.array(a, b)))
    return reads(spark, d).select(
        F.col("read_id").alias("clone_id"), "epitope", "subject", F.col("nuc_a").alias("cdr3a"), F.col("nuc_b").alias("cdr3b"),
        two("va", n("VA", 5, 7)).alias("va_genes"), two("ja", n("JA", 2, 3)).alias("ja_genes"), two("vb", n("VB", 3, 5)).alias("vb_genes"), two("jb", n("JB", 3, 4)).alias("jb_genes"),
    )


@query
def exact_sharing(spark, d):
    """Receptors that another subject of the epitope has too (equal CDR3s, V and J sets overlap)."""
    return diversity.shared_flags(_receptors(spark, d))


@query
def cross_reactivity(spark, d):
    """Where else a receptor is seen (equal CDR3, V sets overlap)."""
    return diversity.cross_reactivity(_receptors(spark, d), "A")


# gene usage and information


@query
def rep_counts(spark, d):
    """E1, E54, D1."""
    return usage.rep_counts(clones(spark, d), "epitope", F.col("va_genes"))


@query
def label_rep(spark, d):
    """E2, N8."""
    return usage.label_reps(clones(spark, d), "epitope", F.col("va_genes")).select("clone_id", "label")


@query
def label_ranks(spark, d):
    """Labels by rank."""
    return usage.label_ranks(usage.label_reps(clones(spark, d), "epitope", F.col("vb_genes")), "epitope")


@query
def rep_pair_counts(spark, d):
    """Pairs with zero fill."""
    return usage.pair_counts(clones(spark, d), "epitope", "va1", "jb")


@query
def usage_entropy(spark, d):
    """E19."""
    return usage.entropy(usage.rep_counts(clones(spark, d), "epitope", F.col("va_genes")), "epitope").select("epitope", r("entropy", 6).alias("entropy"), r("effective", 5).alias("effective"))


@query
def mutual_information(spark, d):
    """E20."""
    return usage.mutual_information(clones(spark, d), "epitope", "va1", "jb").select("epitope", r("mi", 8).alias("mi"))


def _usage(c: DataFrame, genes: str) -> DataFrame:
    n = usage.rep_counts(c, "epitope", F.col(genes))
    return n.select("epitope", F.col("rep"), (F.col("n") / F.sum("n").over(Window.partitionBy("epitope"))).alias("p"))


@query
def jsd_normed(spark, d):
    """Divergence of each epitope's usage from that of all clones."""
    c = clones(spark, d)
    p = _usage(c, "va_genes")
    every = usage.rep_counts(c.withColumn("all", F.lit("x")), "all", F.col("va_genes")).where("rep <> 'VA3'")
    q = for_each(every.select("rep", (F.col("n") / F.sum("n").over(Window.partitionBy("all"))).alias("p")), c, "epitope")
    return usage.js_divergence(p, q, ["epitope"], "rep").select("epitope", r("jsd", 8).alias("jsd"), r("jsd_normed", 8).alias("jsd_normed"))


@query
def gene_enrichment(spark, d):
    """Usage against all clones."""
    c = clones(spark, d)
    every = usage.rep_counts(c.withColumn("all", F.lit("x")), "all", F.col("va_genes"))
    q = for_each(every.select("rep", (F.col("n") / F.sum("n").over(Window.partitionBy("all"))).alias("p")), c, "epitope")
    x = usage.enrichment(_usage(c, "va_genes"), q, ["epitope"], "rep")
    return x.select("epitope", "rep", r("p", 8).alias("p"), r("background", 8).alias("background"), r("enrich", 7).alias("enrich"))


@query
def tuple_counts_distinct(spark, d):
    """Counts of ambiguous gene tuples over distinct sequences, the first of each in the order of the table."""
    at = F.struct("_metadata.file_path", "_metadata.row_index")
    t = tuples(spark, d).groupBy("seq_id").agg(F.min_by(F.struct("file", "genes"), at).alias("t")).select("t.*")
    return t.groupBy("file", F.array_join("genes", ",").alias("tuple")).agg(F.count(F.lit(1)).alias("n"))


def _tuple_tables(spark, d):
    # every round of an allocation reads these counts, the table once
    _ready(spark)
    n = tuples(spark, d).groupBy("epitope", "file", "genes").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    fg = n.groupBy("epitope", "genes").agg(F.sum("n").alias("n"))
    bg = for_each(n.where("file = 'FO'").groupBy("genes").agg(F.sum("n").alias("n")), n, "epitope").select("epitope", "genes", "n")
    return fg, bg


@query
def ambiguous_allocation(spark, d):
    """One allocation by a uniform bias."""
    fg, _ = _tuple_tables(spark, d)
    return usage.allocate(fg, usage.uniform_bias(fg, ["epitope"]), ["epitope"]).select("epitope", "rep", r("p", 8).alias("p"))


@query
def jsd_allocation_5iter(spark, d):
    """Five alternating rounds against the background."""
    fg, bg = _tuple_tables(spark, d)
    return usage.allocate_against(fg, bg, ["epitope"]).select("epitope", "round", r("jsd_normed", 7).alias("jsd_normed"))


@query
def freqs_unique_nonunique(spark, d):
    """E54."""
    return usage.frequencies(tuples(spark, d), F.col("genes"), "file")


@query
def vj_log_enrichment(spark, d):
    """E55."""
    return usage.log_enrichment(clones(spark, d), "va1", "jb").select("va1", "jb", "n", r("expected", 5).alias("expected"), r("log_enrich", 6).alias("log_enrich"))


@query
def kmer_topk(spark, d):
    """The ten most frequent 3-mers."""
    return usage.top_kmers(reads(spark, d), "nuc_a", 3, 10)


@query
def share_by_length(spark, d):
    """E71."""
    return usage.share_by_length(clones(spark, d), "cdr3b", "vb1").select("epitope", "length", F.col("vb1").alias("label"), "n", r("share", 7).alias("share"))


@query
def subject_epitope_cube(spark, d):
    """Clones and reads by subject and epitope with marginals."""
    return usage.subject_table(clones(spark, d))


@query
def summary_table(spark, d):
    """Totals, clonality and mean properties by epitope."""
    c = clones(spark, d)
    p = usage.property_means(c).where("chains = 'AB'").drop("chains")
    x = usage.totals(c).join(diversity.clonality(c), "epitope", "left").join(p, "epitope", "left")
    return x.select("epitope", "subjects", "clones", "reads", r("p", 9).alias("p"), r("length", 5).alias("length"), r("charge", 5).alias("charge"))


# clones


@query
def clone_calling(spark, d):
    """Reads to clones; V alpha and J beta calls are sets of two."""
    x = reads(spark, d)
    v, j = (F.concat(F.lit(c), (F.col("read_id") % m).cast("string")) for c, m in (("VA", 7), ("JB", 4)))
    x = x.withColumns({"va": F.concat_ws(";", "va", v), "jb": F.concat_ws(";", "jb", j), "new_a": F.substr("nuc_a", F.lit(13), F.lit(6)), "new_b": F.substr("nuc_b", F.lit(10), F.col("read_id") % 2 + 5)})
    x = calls.call_clones(x.withColumn("log10_p", -10.5 - F.col("read_id") % 8))
    return x.select("clone_id", "epitope", "subject", "clone_size", F.array_join(F.transform("members", lambda m: m.cast("string")), ";").alias("members"))


@query
def clone_gene_consensus(spark, d):
    """Shared or most frequent genes of the members."""
    m = tuples(spark, d).withColumn("order_id", F.expr("seq_id div 8"))
    return calls.consolidate_genes(m, "order_id", "genes").select("order_id", F.array_join("genes", ";").alias("genes"))


@query
def average_scores(spark, d):
    """Mean over members that have a score."""
    m = reads(spark, d).withColumn("score", F.when(F.col("read_id") % 3 == 0, 9.6).otherwise(F.col("qual").cast("double")))
    return calls.average_scores(m, "subject", "score", 9.6).select("subject", r("score", 6).alias("score"))


@query
def clonality_fraction(spark, d):
    """E65."""
    return calls.clonality_fraction(clones(spark, d)).select("clone_id", r("fraction", 8).alias("fraction"))


@query
def nonzero_probability(spark, d):
    """Smallest non-zero value instead of zero."""
    c = clones(spark, d).select("clone_id", "epitope", F.when(F.col("score") < 0, 0.0).otherwise(F.col("score")).alias("score"))
    return calls.nonzero_probability(c, "score", "epitope")


# statistics


@query
def score_correlations(spark, d):
    """Pearson, Spearman and regression by epitope."""
    x = clones(spark, d).withColumn("len", F.length("cdr3b").cast("double"))
    return stats.correlations(x, ["epitope"], "len", "score").select("epitope", *[r(k, 6).alias(k) for k in ("pearson", "spearman", "slope", "intercept")])


@query
def score_mean_sdev_median(spark, d):
    """E7, E8."""
    return clones(spark, d).groupBy("epitope").agg(r(F.avg("score"), 6).alias("mean"), r(F.stddev_pop("score"), 6).alias("sdev"), r(F.median("score"), 6).alias("median"))


@query
def empirical_cdf(spark, d):
    """E42."""
    x = clones(spark, d).withColumn("len", F.length("cdr3a"))
    return stats.empirical_cdf(x, ["epitope"], "len").select("epitope", "len", r("cdf", 8).alias("cdf"))


@query
def kde_grid(spark, d):
    """Density of ranks on 100 points."""
    x = clones(spark, d).withColumn("v", F.length("cdr3b").cast("double"))
    return stats.density(x, ["epitope"], "v", low=0.0, high=30.0).select("epitope", "i", r("density", 8).alias("density"))


@query
def rank_sum_test(spark, d):
    """Mann-Whitney statistic of scores by clonality."""
    x = stats.mann_whitney(clones(spark, d), ["epitope"], F.round("score", 0), F.col("clone_size") > 2)
    return x.select("epitope", r("u", 3).alias("u"), r("z", 6).alias("z"))


@query
def min_other_score(spark, d):
    """Each subject's lowest mean score in other epitopes, and which."""
    m = clones(spark, d).groupBy("subject", "epitope").agg(r(F.avg("score"), 5).alias("s"))
    o = m.select("subject", F.col("epitope").alias("other"), F.col("s").alias("os"))
    x = m.join(o, "subject").where("epitope <> other").groupBy("subject", "epitope").agg(F.min(F.struct("os", "other")).alias("b"))
    return x.select("subject", "epitope", F.col("b.os").alias("least"), F.col("b.other").alias("other"))


# motifs


@query
def motif_seed_support(spark, d):
    """Support of all two-atom seeds in foreground and background."""
    return motifs.seed_support(clones(spark, d), ["epitope"], "cdr3a").where("n >= 10").select("epitope", "shown", "n")


@query
def motif_scores(spark, d):
    """Seeds scored against the background."""
    c, b = clones(spark, d), fixtures.frame(spark, d, "background")
    sizes = c.groupBy("epitope").agg(F.count(F.lit(1)).alias("total"))
    x = motifs.score_motifs(motifs.seed_support(c, ["epitope"], "cdr3a"), motifs.seed_support(b, [], "cdr3"), ["epitope"], sizes, b.count(), min_chi=2.0)
    return x.select("epitope", "shown", "n", r("expected", 6).alias("expected"), r("chi_squared", 5).alias("chi_squared"))


@query
def motif_matches(spark, d):
    """Clones that match given motifs."""
    m = spark.createDataFrame([("A.K", "A[A-Z][KR]"), ("^CAVd", "^CAV[DE]"), ("n.LF$", "[NQ][A-Z]LF$")], "shown string, pattern string")
    c = clones(spark, d)
    return motifs.matches(for_each(m, c, "epitope"), c, ["epitope"], "cdr3a")


@query
def motif_overlap_distance(spark, d):
    """D20."""
    m = spark.createDataFrame([("A", "A[A-Z][KR]"), ("B", "^CAV[DE]"), ("C", "[NQ][A-Z]LF$"), ("D", "[KR]")], "shown string, pattern string")
    c = clones(spark, d)
    return motifs.overlap_distance(motifs.matches(for_each(m, c, "epitope"), c, ["epitope"], "cdr3a"), ["epitope"]).select("epitope", "shown1", "shown2", r("dist", 7).alias("dist"))


@query
def pwm(spark, d):
    """Position weights by epitope and length."""
    c = clones(spark, d).withColumn("length", F.length("cdr3a"))
    return motifs.position_weights(c, ["epitope", "length"], "cdr3a", tables.AMINO_ACIDS).select("epitope", "length", "pos", "letter", r("freq", 8).alias("freq"))


@query
def consensus(spark, d):
    """Consensus by epitope and length."""
    c = clones(spark, d).withColumn("length", F.length("cdr3b"))
    return motifs.consensus(c, ["epitope", "length"], "cdr3b")


# groups, trees, permutation, single cells, junctions


def _groups(spark: SparkSession, d: str) -> distance.Groups:
    """Distances of chain A within each subject of an epitope, made where they are needed."""
    return distance.Groups(clones(spark, d).withColumn("g", F.concat_ws(":", "epitope", F.col("subject").cast("string"))), genes(spark, d), "g")


@query
def medoids(spark, d):
    """The clone with the least mean distance of its subject's repertoire."""
    return clustering.medoids(_groups(spark, d), "g").select("g", "medoid", r("mean_dist", 5).alias("mean_dist"))


@query
def greedy_clusters(spark, d):
    """Greedy radius clusters."""
    return clustering.greedy_clusters(_groups(spark, d), "g", 60.0)


@query
def linkage_trees(spark, d):
    """Average-linkage trees."""
    return clustering.trees(_groups(spark, d), "g", leaves=False).select("g", "node", "left", "right", r("height", 6).alias("height"), "size")


@query
def cophenetic_correlation(spark, d):
    """How well the trees keep the distances."""
    return clustering.cophenetic(_groups(spark, d), "g").select("g", r("correlation", 6).alias("correlation"))


@query
def kernel_coordinates(spark, d):
    """Kernel PCA of 1 - d / d_max, d_max being the median of the groups' largest distances."""
    pairs = _groups(spark, d)
    return clustering.kernel_coordinates(pairs, "g", d_max=clustering.median_extent(pairs, "g")).select("g", "id", r("x1", 5).alias("x1"), r("x2", 5).alias("x2"))


@query
def permutation_within_subjects(spark, d):
    """Within-subject distance against ten seeded shuffles."""
    c = clones(spark, d)
    sums = distance.permuted_sums(permutation.subject_labels(c, 10), genes(spark, d), "labels", 11).where("chains = 'A' and group1 = group2")
    x = permutation.distance_tests(sums).where("level = 'within'")
    return x.select("epitope", *[r(k, 5).alias(k) for k in ("observed", "mean", "z", "p")])


@query
def adjusted_mutual_information(spark, d):
    """E21."""
    return stats.adjusted_mutual_information(clones(spark, d), "epitope", "va1", "jb").select("epitope", r("ami", 8).alias("ami"))


@query
def pair_enrichment_tails(spark, d):
    """Hypergeometric tails of gene pairs."""
    n = usage.pair_counts(clones(spark, d), "epitope", "va1", "jb")
    over = lambda *k: F.sum("n").over(Window.partitionBy("epitope", *k))
    x = n.select("epitope", "va1", "jb", "n", over().alias("t"), over("va1").alias("a"), over("jb").alias("b"))
    tails = x.withColumn("p", stats.hypergeometric_tails("n", "t", "a", "b"))
    return tails.select("epitope", "va1", "jb", "n", r("p.enriched", 8).alias("enriched"), r("p.depleted", 8).alias("depleted"))


@query
def fisher_shared_clonal(spark, d):
    """Clonality against score sign."""
    big, good = F.col("clone_size") > 2, F.col("score") > 0
    k = lambda f: F.sum(f.cast("long"))
    x = clones(spark, d).groupBy("epitope").agg(k(big & good).alias("a"), k(big & ~good).alias("b"), k(~big & good).alias("c"), k(~big & ~good).alias("e"))
    return x.select("epitope", "a", "b", "c", "e", r(stats.fisher_exact("a", "b", "c", "e"), 8).alias("p"))


@query
def score_t_test(spark, d):
    """Scores of large and other clones."""
    return stats.t_test(clones(spark, d), ["epitope"], F.col("score"), F.col("clone_size") > 2).select("epitope", r("t", 6).alias("t"), r("p", 8).alias("p"))


@query
def sharing_interval(spark, d):
    """Interval of each epitope's clonality."""
    x = F.col("clone_size")
    s = clones(spark, d).groupBy("epitope", "subject").agg(F.sum(x * (x - 1)).alias("k"), F.sum(x).alias("n"))
    s = s.groupBy("epitope").agg(F.sum("k").alias("k"), F.sum(F.col("n") * (F.col("n") - 1)).alias("n")).withColumn("i", stats.binomial_interval("k", "n"))
    return s.select("epitope", "k", "n", r("i.low", 8).alias("low"), r("i.high", 8).alias("high"))


@query
def motif_mining(spark, d):
    """Seeds, extensions and removal of redundant motifs."""
    c, b = clones(spark, d), fixtures.frame(spark, d, "background").withColumnRenamed("cdr3", "cdr3a")
    m = motifs.mine_motifs(c, b, ["epitope"], "cdr3a", min_chi=5.0)
    return motifs.drop_redundant(m, motifs.matches(m, c, ["epitope"], "cdr3a"), ["epitope"])


def _germline(spark, d):
    n = reads(spark, d).withColumn("nuc", F.concat("nuc_a", F.lit("a")))
    return n.select("read_id", "nuc", F.substr("nuc", F.lit(1), F.lit(9)).alias("v_nuc"), F.substr("nuc", F.lit(25), F.lit(9)).alias("j_nuc"))


@query
def junction_parts(spark, d):
    """Germline, D and inserted parts of each read's junction."""
    x = _germline(spark, d).withColumn("protein", seq.translate_frame(F.col("nuc"), 1))
    y = junctions.analyze_junctions(x.select("read_id", "v_nuc", "j_nuc", "nuc", "protein"), {1: "gggacagggggc", 2: "gggactagcggg"})
    return y.select("read_id", "v_trim", "j_trim", "insert", "d_id", "vd_insert", "dj_insert", "source", "masked")


_TRIMS = junctions.TrimTables([0.4, 0.2, 0.15, 0.1, 0.1, 0.05], [0.5, 0.2, 0.2, 0.1], [1 / 16] * 16)


@query
def generation_probability(spark, d):
    """K3, K5, K6: generation probability of junction proteins."""
    x = _germline(spark, d).withColumn("protein", seq.translate_frame(F.col("nuc"), 1)).where(~F.contains("protein", F.lit("*")) & ~F.contains("protein", F.lit("X")))
    return junctions.with_probability(x.select("read_id", "v_nuc", "j_nuc", "protein"), _TRIMS).select("read_id", F.round(F.log10(F.greatest("probability", F.lit(1e-99))), 6).alias("log10_p"))


@query
def sampled_junctions(spark, d):
    """Random junctions of every gene pair."""
    g = _germline(spark, d).select(F.substr("v_nuc", F.lit(1), F.lit(6)).alias("v_nuc"), F.substr("j_nuc", F.lit(4), F.lit(6)).alias("j_nuc")).distinct()
    return junctions.sample_junctions(g.select(F.col("v_nuc").alias("v"), "v_nuc", F.col("j_nuc").alias("j"), "j_nuc"), _TRIMS, 5).select("v", "j", "n", "nuc", "protein")


@query
def gene_assignment(spark, d):
    """K1: reads to the germline genes that they came from."""
    germline = reads(spark, d).where("nuc_a not like '%n%'").groupBy("nuc_a").agg(F.min("read_id").alias("g")).select(F.concat(F.lit("G"), F.col("g").cast("string")).alias("gene"), F.lit("V").alias("region"), F.col("nuc_a").alias("nucseq"))
    x = parsing.assign_genes(reads(spark, d).select("read_id", F.col("nuc_a").alias("nuc")), germline)
    return x.select("read_id", "gene", "strand", "shift", "score", "gap")


@query
def chain_pairing(spark, d):
    """Greedy pairing of chains by support."""
    c = tuples(spark, d).where("g1 <> g2").groupBy(F.col("g1").alias("a"), F.concat(F.col("g2"), F.col("file"), F.col("epitope")).alias("b")).agg(F.count(F.lit(1)).alias("support"))
    return pairing.accepted_pairs(c)


@query
def gene_classes(spark, d):
    """Classes of V genes."""
    g = genes(spark, d).withColumn("region", F.lit("V"))
    return gene_dim.representatives(g).join(gene_dim.merged_representatives(g, 2), "gene")


# names, cells and alignments


@query
def gene_names(spark, d):
    """Gene of an allele, number in a name, padding, line ends."""
    stripped = seq.strip_line_end(F.concat("vb1", F.lit(" \r\n")))
    gene = seq.gene_of_allele(F.concat("va1", F.lit("*01")))
    return clones(spark, d).select("clone_id", gene.alias("gene"), seq.gene_number(F.col("va1")).alias("number"), seq.pad_middle(F.col("va1"), 8).alias("padded"), stripped.alias("stripped"))


@query
def score_scalars(spark, d):
    """Guarded logarithms, Z-scores and inverses, stars of a probability."""
    s, w = F.col("score"), Window.partitionBy("epitope")
    p = F.abs(s) / 1e5
    z = seq.z_score(s, F.avg(s).over(w), F.stddev_pop(s).over(w))
    inverse = seq.safe_inverse(F.floor(s / 1000).cast("double"))
    return clones(spark, d).select("clone_id", r(seq.safe_log10(s)).alias("log10"), seq.truncated_log10(p).alias("exponent"), r(z).alias("z"), r(inverse, 8).alias("inverse"), stats.stars(p).alias("stars"))


@query
def top_hit_genes(spark, d):
    """Genes with the best score of a hit cell."""
    n = lambda m: (F.col("clone_id") % m + 10).cast("string")
    hits = F.concat("va1", F.lit(":"), n(3), F.lit(";"), "va2", F.lit("*02:"), n(2))
    return clones(spark, d).select("clone_id", F.array_join(seq.top_hits(hits), ";").alias("genes"))


@query
def gapped_alignment(spark, d):
    """Both loops of a clone aligned by one run of gaps."""
    return clones(spark, d).select("clone_id", seq.align_with_gap(F.col("cdr3a"), F.col("cdr3b")).alias("aligned"))


@query
def loop_qualities(spark, d):
    """Qualities of a part of a read, found on either strand."""
    quals = F.transform(F.sequence(F.lit(1), F.length("nuc_a")), lambda i: (F.col("read_id") + i) % 40)
    part = F.substr("nuc_a", F.lit(5), F.lit(9))
    part = F.when(F.col("read_id") % 2 == 0, part).otherwise(seq.reverse_complement(part))
    return reads(spark, d).select("read_id", F.array_join(F.transform(parsing.part_qualities(F.col("nuc_a"), quals, part), lambda q: q.cast("string")), ".").alias("quals"))


@query
def fake_chains(spark, d):
    """Whether a chain is constant."""
    return calls.fake_chain(clones(spark, d), "cdr3a", "va1")


@query
def subset_rows(spark, d):
    """The first groups, subjects and rows."""
    return sources.test_subset(reads(spark, d).select(F.col("read_id").alias("id"), "epitope", "subject"))


@query
def common_columns(spark, d):
    """C17, H1: all rows of two tables on their common columns."""
    b = fixtures.frame(spark, d, "background").select(F.col("chain_id").alias("clone_id"), "v_rep", F.col("cdr3").alias("cdr3a"))
    return sources.union_common([clones(spark, d).select("clone_id", "epitope", "cdr3a"), b])


@query
def converted_rows(spark, d):
    """Clonotypes of another dialect by what became of them."""
    c = clones(spark, d)
    cdr3 = F.when(F.col("clone_id") % 11 == 0, F.lit(None)).when(F.col("clone_id") % 13 == 0, "CAF").when(F.col("clone_id") % 17 == 0, "CAXXXXF").otherwise(F.col("cdr3a"))
    other = c.select(F.concat("va1", F.lit(", VA9")).alias("V segments"), F.col("ja").alias("J segments"), cdr3.alias("CDR3 amino acid sequence"), F.col("clone_size").alias("Count"))
    known = spark.createDataFrame([(g,) for g in ("VA0", "VA1", "VA2", "VA3", "VA4", "JA0", "JA1", "JA2")], "gene string")
    good, bad = sources.convert_clonotypes(other, known)
    rows = good.select(F.lit("OK").alias("status"), "clone_size").unionAll(bad.select(F.col("reason").alias("status"), "clone_size"))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("clone_size").alias("reads"))


# distributions and samples


@query
def trim_distribution(spark, d):
    """Weighted distribution of a capped length."""
    x = reads(spark, d).withColumns({"trim": F.col("read_id") % 30, "w": F.col("qual").cast("double")})
    return junctions.length_distribution(x, "trim", "w").select("length", r("p", 8).alias("p"))


def _file_tables(spark, d, item: str):
    n = tuples(spark, d).groupBy("file", F.col("epitope").alias("tag"), F.col("g1").alias(item)).agg(F.count(F.lit(1)).alias("n"))
    return n.select("file", "tag", item, (F.col("n") / F.sum("n").over(Window.partitionBy("file", "tag"))).alias("p"))


@query
def averaged_distributions(spark, d):
    """Distributions of several files, summed and normalised."""
    return junctions.average_distributions(_file_tables(spark, d, "key")).select("tag", "key", r("p", 8).alias("p"))


@query
def pseudo_probabilities(spark, d):
    """Gene frequencies over files, files without the gene as 0."""
    x = _file_tables(spark, d, "rep").where("tag = 'N'").drop("tag")
    return junctions.pseudo_probabilities(x).select("rep", r("p", 8).alias("p"))


@query
def protein_probabilities(spark, d):
    """K7: the best gene's frequency times the junction's probability."""
    reps = junctions.pseudo_probabilities(_file_tables(spark, d, "rep").where("tag = 'N'").drop("tag"))
    rows = tuples(spark, d).select(F.col("seq_id").alias("id"), "genes", (1 / (F.col("seq_id") % 7 + 1)).alias("junction"))
    return junctions.protein_probability(rows, reps, "genes", "junction", "p").select("id", r("p", 8).alias("p"))


@query
def germline_bases(spark, d):
    """Most frequent base of each position of a gene's reads."""
    return parsing.germline_bases(reads(spark, d), ["va"], "nuc_a").select("va", "pos", "base", r("share", 8).alias("share"))


@query
def voted_frames(spark, d):
    """each subject's most frequent frame."""
    return parsing.voted_frames(reads(spark, d).select("subject", parsing.reading_frame(F.col("nuc_a"), F.col("qual") % 20 + 1).alias("frame")), ["subject"])


@query
def background_sample(spark, d):
    """At most ten background chains of each gene pair."""
    return sampling.sample_per_key(fixtures.frame(spark, d, "background"), ["v_rep", "j_rep"], "chain_id", 10)


@query
def distinct_junctions(spark, d):
    """H6: reads whose junction no earlier read has with genes in common."""
    x = tuples(spark, d).select(F.col("seq_id").alias("id"), F.concat("epitope", "file").alias("nuc"), F.col("genes").alias("v_genes"), F.array(F.concat(F.lit("J"), (F.col("seq_id") % 5).cast("string"))).alias("j_genes"))
    return parsing.distinct_junctions(x).select("id")


# motif reports and ranks


@query
def motif_top_genes(spark, d):
    """Three most frequent V genes of each motif's matches."""
    return motifs.top_genes(motif_matches(spark, d), clones(spark, d), ["epitope"], "va1")


@query
def motif_match_plus(spark, d):
    """Matches and their near neighbours of equal length."""
    near = lambda c: distance.length_band_pairs(c.withColumn("epitope", F.concat("epitope", F.length("cdr3a").cast("string"))), "A", 19.0).select("id1", "id2")
    return motifs.match_plus_equal(motif_matches(spark, d), clones(spark, d), near, ["epitope"], "cdr3a")


@query
def pwm_relative_entropy(spark, d):
    """Information of each position against the background."""
    c = clones(spark, d).withColumn("length", F.length("cdr3a"))
    b = fixtures.frame(spark, d, "background").withColumn("length", F.length("cdr3"))
    weights = lambda x, s: motifs.position_weights(x, ["length"], s, tables.AMINO_ACIDS)
    return motifs.relative_entropy(weights(c, "cdr3a"), weights(b, "cdr3"), ["length"]).select("length", "pos", r("relent").alias("relent"))


@query
def mutual_rank(spark, d):
    """Mean rank of a repertoire's scores within each repertoire's own."""
    s = reports.nearest_values(spark, d)
    ranks = neighbors.rank_against(s, s.where("epitope = ref_epitope"), ["ref_epitope"], "v")
    return ranks.groupBy("epitope", "ref_epitope").agg(r(F.avg("rank"), 4).alias("rank"))


# single cells


def _contigs(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    n = lambda c: c.cast("string")
    chain = F.when(F.col("l_partkey") % 2 == 0, "TRA").otherwise("TRB")
    x = x.select(
        F.concat(F.lit("ct"), n(F.col("l_orderkey") % 997)).alias("raw_clonotype_id"), F.concat(F.lit("bc"), n(F.col("l_orderkey") % 4999)).alias("barcode"),
        F.when(F.col("l_linenumber") % 5 == 0, "False").otherwise("True").alias("productive"), chain.alias("chain"),
        F.concat(F.lit("V"), n(F.col("l_partkey") % 5)).alias("v_gene"), F.concat(F.lit("J"), n(F.col("l_suppkey") % 3)).alias("j_gene"),
        F.when(F.col("l_suppkey") % 9 == 0, "None").otherwise(F.concat(F.lit("CA"), n(F.col("l_partkey") % 7))).alias("cdr3"),
        F.concat(F.lit("tgt"), n(F.col("l_suppkey") % 3)).alias("cdr3_nt"), F.col("l_quantity").cast("long").alias("umis"),
    )
    return x.withColumn("raw_consensus_id", F.concat("raw_clonotype_id", F.lit("_"), "chain"))


@query
def contig_chains(spark, d):
    """Chains of each clonotype with their UMIs and cells."""
    return pairing.clonotype_chains(pairing.usable_contigs(_contigs(spark, d)))


@query
def clonotype_barcodes(spark, d):
    """Cells of each clonotype."""
    return pairing.barcodes(_contigs(spark, d))


@query
def umi_discrepancies(spark, d):
    """Chains whose UMI sum differs from a consensus table, either side may lack one."""
    c = _contigs(spark, d)
    k = F.substr("raw_clonotype_id", F.lit(3), F.lit(9)).cast("int")
    other = c.groupBy(F.when(k % 11 == 0, F.concat("raw_consensus_id", F.lit("_other"))).otherwise(F.col("raw_consensus_id")).alias("consensus_id"), k.alias("k")).agg(F.sum("umis").alias("umis"))
    return pairing.umi_discrepancies(c, other.withColumn("umis", F.col("umis") + F.when(F.col("k") % 7 == 0, 1).otherwise(0)))


@query
def single_cell_clones(spark, d):
    """Clones of one beta and one or two alphas, after badly supported pairs are dropped."""
    c = pairing.usable_contigs(_contigs(spark, d))
    chains, sizes = pairing.clonotype_chains(c), pairing.barcodes(c)
    accepted = pairing.accepted_pairs(pairing.chain_pairs(chains, sizes).checkpoint())
    return pairing.paired_clones(pairing.accepted_chains(chains, accepted), sizes)
