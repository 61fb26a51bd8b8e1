"""Gene usage, information measures and summary tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repertoire.functions import tables
from repertoire.functions.sequences import residue_sum
from repertoire.operators.broadcasts import bounded, shipped


def rep_counts(clones: DataFrame, group: str, genes: Column) -> DataFrame:
    """(group, rep, n) of the genes in set-valued cells."""
    return clones.select(group, F.explode(genes).alias("rep")).groupBy(group, "rep").agg(F.count(F.lit(1)).alias("n"))


def label_reps(clones: DataFrame, group: str, genes: Column, id_col: str = "clone_id") -> DataFrame:
    """(id, label): of a clone's ambiguous genes the most frequent one of its repertoire, the
    lexicographically largest of ties."""
    rows = clones.select(id_col, group, F.explode(genes).alias("rep"))
    counts = rep_counts(clones, group, genes)
    return rows.join(counts, [group, "rep"]).groupBy(id_col, group).agg(F.max_by("rep", F.struct("n", "rep")).alias("label"))


def label_ranks(labels: DataFrame, group: str) -> DataFrame:
    """(group, label, n, rank) by falling count, larger names first among ties."""
    counts = labels.groupBy(group, "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), F.desc("label"))))


def pair_counts(labels: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Counts of label pairs, zero for pairs of seen labels that never meet (labels are dimensions)."""
    seen = labels.groupBy(group, a, b).agg(F.count(F.lit(1)).alias("n"))
    grid = labels.select(group, a).distinct().join(labels.select(group, b).distinct(), group)
    return grid.join(seen, [group, a, b], "left").select(group, a, b, F.coalesce("n", F.lit(0)).alias("n"))


def entropy(counts: DataFrame, group: str, n: str = "n") -> DataFrame:
    """(group, entropy in bits, effective number) of counts."""
    p = F.col(n) / F.sum(n).over(Window.partitionBy(group))
    rows = counts.where(F.col(n) > 0).select(group, p.alias("__p"))
    rows = rows.groupBy(group).agg((-F.sum(F.col("__p") * F.log2("__p"))).alias("entropy"))
    return rows.select("*", F.pow(F.lit(2.0), "entropy").alias("effective"))


def mutual_information(labels: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(group, mi in bits) of two label columns, in one grouping of the joint counts."""
    joint = labels.groupBy(group, a, b).agg(F.count(F.lit(1)).alias("n"))
    over = lambda *k: F.sum("n").over(Window.partitionBy(group, *k))
    rows = joint.select(group, "n", over(a).alias("na"), over(b).alias("nb"), over().alias("t"))
    return rows.groupBy(group).agg(F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))


def js_divergence(p: DataFrame, q: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, jsd, jsd_normed) in bits of two tables (keys, item, p); missing items count zero.
    ``jsd_normed`` divides twice the divergence by the sum of the entropies."""
    both = p.withColumnRenamed("p", "__p").join(q.withColumnRenamed("p", "__q"), [*keys, item], "full").fillna(0.0, ["__p", "__q"])
    x, y = F.col("__p"), F.col("__q")
    part = lambda v: F.when(v > 0, v * F.log2(v)).otherwise(0.0)
    rows = both.groupBy(*keys).agg(F.sum(part(x)).alias("__hp"), F.sum(part(y)).alias("__hq"), F.sum(part((x + y) / 2)).alias("__hm"))
    jsd = (F.col("__hp") + F.col("__hq")) / 2 - F.col("__hm")
    return rows.select(*keys, jsd.alias("jsd"), F.when(F.col("__hp") + F.col("__hq") < 0, 2 * jsd / -(F.col("__hp") + F.col("__hq"))).otherwise(0.0).alias("jsd_normed"))


def allocate(tuples: DataFrame, bias: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rep, p): each ambiguous tuple's count split by a bias (evenly where the bias is all zero).

    ``tuples``: (keys, genes array, n); ``bias``: (keys, rep, p). Tuples are counted before they are
    exploded, so the work follows the number of distinct tuples.
    """
    rows = tuples.withColumn("__t", F.xxhash64("genes")).select(*keys, "__t", "n", F.size("genes").alias("__k"), F.explode("genes").alias("rep"))
    rows = rows.join(bias.withColumnRenamed("p", "__b"), [*keys, "rep"], "left").fillna(0.0, ["__b"])
    whole = F.sum("__b").over(Window.partitionBy(*keys, "__t"))
    share = F.when(whole == 0, 1.0 / F.col("__k")).otherwise(F.col("__b") / whole)
    split = rows.withColumn("__s", share * F.col("n")).groupBy(*keys, "rep").agg(F.sum("__s").alias("__s"))
    total = tuples.groupBy(*keys).agg(F.sum("n").alias("__n"))
    return split.join(bounded(total), keys).select(*keys, "rep", (F.col("__s") / F.col("__n")).alias("p"))


def uniform_bias(tuples: DataFrame, keys: list[str]) -> DataFrame:
    reps = tuples.select(*keys, F.explode("genes").alias("rep")).distinct()
    return reps.withColumn("p", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def allocate_against(foreground: DataFrame, background: DataFrame, keys: list[str], rounds: int = 5) -> DataFrame:
    """(keys, round, jsd_normed) of alternating allocation: the background by the foreground's
    frequencies, then the foreground by the background's. Frequencies are dimension tables."""
    fg, bg = allocate(foreground, uniform_bias(foreground, keys), keys), allocate(background, uniform_bias(background, keys), keys)
    out = None
    for i in range(1, rounds + 1):
        bg = allocate(background, fg, keys).checkpoint()
        fg = allocate(foreground, bg, keys).checkpoint()
        row = js_divergence(fg, bg, keys, "rep").select(*keys, F.lit(i).alias("round"), "jsd_normed")
        out = row if out is None else out.unionAll(row)
    return out


def enrichment(observed: DataFrame, expected: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, item, p, background, enrich); enrichment is 1 where the background is 0."""
    both = observed.join(expected.withColumnRenamed("p", "background"), [*keys, item], "left").fillna(0.0, ["background"])
    return both.withColumn("enrich", F.when(F.col("background") == 0, 1.0).otherwise(F.col("p") / F.col("background")))


def property_means(clones: DataFrame) -> DataFrame:
    """(epitope, chains, length, charge, ges, hp): mean CDR3 properties; the hydrophobicity is negated."""
    one = lambda s: F.struct(F.length(s).cast("double").alias("length"), residue_sum(s, tables.CHARGE).alias("charge"), residue_sum(s, tables.GES, -1.0).alias("ges"), residue_sum(s, tables.HP).alias("hp"))
    rows = clones.select("epitope", one(F.col("cdr3a")).alias("a"), one(F.col("cdr3b")).alias("b"))
    add = F.struct(*[(F.col(f"a.{k}") + F.col(f"b.{k}")).alias(k) for k in ("length", "charge", "ges", "hp")])
    rows = rows.select("epitope", F.explode(F.map_from_arrays(F.array(F.lit("A"), F.lit("B"), F.lit("AB")), F.array("a", "b", add))).alias("chains", "v"))
    return rows.groupBy("epitope", "chains").agg(*[F.avg(f"v.{k}").alias(k) for k in ("length", "charge", "ges", "hp")])


def property_histogram(clones: DataFrame, value: Column) -> DataFrame:
    return clones.groupBy("epitope", value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def totals(clones: DataFrame) -> DataFrame:
    """(epitope, subjects, clones, reads)."""
    return clones.groupBy("epitope").agg(F.count_distinct("subject").alias("subjects"), F.count(F.lit(1)).alias("clones"), F.sum("clone_size").alias("reads"))


def subject_table(clones: DataFrame) -> DataFrame:
    """Clones and reads by subject and epitope, with all marginals (null: all), and the largest clone."""
    top = F.max_by("clone_id", F.struct("clone_size", -F.col("clone_id"))).alias("top_clone")
    return clones.cube("subject", "epitope").agg(F.count(F.lit(1)).alias("clones"), F.sum("clone_size").alias("reads"), top)


def share_by_length(clones: DataFrame, seq: str, label: str) -> DataFrame:
    """(epitope, length, label, n, share of the length)."""
    counts = clones.groupBy("epitope", F.length(seq).alias("length"), label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("epitope", "length")))


def log_enrichment(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, expected, log_enrich) of two labels against independence; pairs that never meet count
    min(expected, 0.25). Labels are dimensions, so their grid is small."""
    joint = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    left, right = pairs.groupBy(a).agg(F.count(F.lit(1)).alias("na")), pairs.groupBy(b).agg(F.count(F.lit(1)).alias("nb"))
    named = shipped(right)
    kind = right.schema
    every = F.from_json(F.lit(json.dumps([row.asDict() for row in named])), T.ArrayType(kind))
    rows = left.withColumn("t", F.lit(sum(row["nb"] for row in named))).select("*", F.inline(every)).join(joint, [a, b], "left")
    expected = F.col("na") * F.col("nb") / F.col("t")
    seen = F.coalesce(F.col("n").cast("double"), F.least(expected, F.lit(0.25)))
    return rows.select(a, b, F.coalesce("n", F.lit(0)).alias("n"), expected.alias("expected"), F.log(seen / expected).alias("log_enrich"))


def top_kmers(df: DataFrame, seq: str, k: int, top: int) -> DataFrame:
    """The most frequent k-mers, with counts (ties: smaller first)."""
    at = F.sequence(F.lit(1), F.greatest(F.length(seq) - k + 1, F.lit(1)))
    mers = df.where(F.length(seq) >= k).select(F.explode(F.transform(at, lambda i: F.substr(F.col(seq), i, F.lit(k)))).alias("kmer"))
    return mers.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kmer").limit(top)


def top_words(df: DataFrame, keys: list[str], seqs: dict[str, Column], k: int, top: int = 10, mark: str = "+") -> DataFrame:
    """(keys, kind, word, n, place): the most frequent words of ``k`` letters of each kind of sequence (kind -> column), as
    for insertions and the same in shuffled order; words over a ``mark`` do not count (ties: smaller first)."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("kind"), s.alias("s")) for name, s in seqs.items()])).alias("x")
    rows = df.select(*keys, each).select(*keys, "x.kind", "x.s").where(F.length("s") >= k)
    at = F.sequence(F.lit(1), F.greatest(F.length("s") - k + 1, F.lit(1)))
    words = rows.select(*keys, "kind", F.explode(F.transform(at, lambda i: F.substr("s", i, F.lit(k)))).alias("word")).where(~F.contains("word", F.lit(mark)))
    n = words.groupBy(*keys, "kind", "word").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy(F.desc("n"), "word"))
    return n.withColumn("place", place).where(F.col("place") <= top)


def pseudo_probabilities(df: DataFrame, keys: list[str], genes: str) -> DataFrame:
    """(keys, gene, pseudoprob): share of rows whose set holds a gene; one row counts for each gene of its set, so these
    add up to more than 1. Without ``keys``: of all rows."""
    rows = df.select(*(keys or [F.lit(0).alias("__all")]), F.array_distinct(genes).alias("__g"))
    by = keys or ["__all"]
    total = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__t"))
    held = rows.select(*by, F.explode("__g").alias("gene")).groupBy(*by, "gene").agg(F.count(F.lit(1)).alias("__n"))
    return held.join(bounded(total), by).select(*keys, "gene", (F.col("__n") / F.col("__t")).alias("pseudoprob"))


def gene_probabilities(clones: DataFrame, genes: str, label: str, background: DataFrame, dimension: DataFrame) -> DataFrame:
    """(epitope, gene, label_prob, pseudoprob, pseudoprob_enrich) of every gene of ``dimension`` (gene) in every repertoire.

    ``label_prob`` is the share of clones labelled with the gene, ``background`` (gene, pseudoprob) what the
    enrichment is over; where that is 0 or the gene is not in it, the enrichment is 1. Clones without genes or label count
    in the number of clones only.
    """
    names = [row["gene"] for row in shipped(dimension.select("gene").distinct())]
    sizes = clones.groupBy("epitope").agg(F.count(F.lit(1)).alias("__t"))
    grid = sizes.select("*", F.explode(F.array(*[F.lit(n) for n in sorted(names)])).alias("gene"))
    labels = clones.groupBy("epitope", F.col(label).alias("gene")).agg(F.count(F.lit(1)).alias("__l"))
    rows = grid.join(labels, ["epitope", "gene"], "left").join(pseudo_probabilities(clones, ["epitope"], genes), ["epitope", "gene"], "left")
    rows = rows.join(bounded(background.select("gene", F.col("pseudoprob").alias("__b"))), "gene", "left")
    p, b = F.coalesce("pseudoprob", F.lit(0.0)), F.coalesce("__b", F.lit(0.0))
    enrich = F.when(b == 0, 1.0).otherwise(p / b)
    return rows.select("epitope", "gene", (F.coalesce("__l", F.lit(0)) / F.col("__t")).alias("label_prob"), p.alias("pseudoprob"), enrich.alias("pseudoprob_enrich"))


def best_gene_probability(df: DataFrame, genes: str, background: DataFrame, out: str) -> DataFrame:
    """Adds the largest ``background`` pseudo-probability of a row's genes; genes that it lacks have 0, no genes null."""
    found = {row["gene"]: row["pseudoprob"] for row in shipped(background.where("gene is not null").select("gene", "pseudoprob"))}
    at = F.create_map(*[F.lit(x) for pair in found.items() for x in pair]) if found else F.create_map(F.lit(""), F.lit(0.0))
    return df.withColumn(out, F.array_max(F.transform(genes, lambda g: F.coalesce(F.try_element_at(at, g), F.lit(0.0)))))


def frequencies(df: DataFrame, genes: Column, group: str) -> DataFrame:
    """(group, rep, n, n_unique): occurrences in all sets and in sets of one gene."""
    rows = df.select(group, F.explode(genes).alias("rep"), (F.size(genes) == 1).cast("long").alias("u"))
    return rows.groupBy(group, "rep").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("n_unique"))


def segment_usage(clones: DataFrame, segments: dict[str, str]) -> DataFrame:
    """(epitope, seg, rep, p): usage of several kinds of segments (name -> gene column)."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("seg"), F.col(c).alias("rep")) for k, c in segments.items()])).alias("x")
    n = clones.select("epitope", each).groupBy("epitope", "x.seg", "x.rep").agg(F.count(F.lit(1)).alias("n"))
    return n.select("epitope", "seg", "rep", (F.col("n") / F.sum("n").over(Window.partitionBy("epitope", "seg"))).alias("p"))


def segment_divergence(clones: DataFrame, segments: dict[str, str]) -> DataFrame:
    """(epitope1 < epitope2, jsd): Jensen-Shannon divergences of two repertoires' usage, summed over segments
    (name -> gene column). Usage tables are dimensions, and all pairs of repertoires are compared."""
    use = segment_usage(clones, segments)
    names = use.select("epitope", "seg").distinct()
    pairs = names.withColumnRenamed("epitope", "epitope1").join(names.withColumnRenamed("epitope", "epitope2"), "seg").where("epitope1 < epitope2")
    side = lambda k: pairs.join(use.withColumnRenamed("epitope", f"epitope{k}"), [f"epitope{k}", "seg"]).select("epitope1", "epitope2", "seg", "rep", "p")
    return js_divergence(side(1), side(2), ["epitope1", "epitope2", "seg"], "rep").groupBy("epitope1", "epitope2").agg(F.sum("jsd").alias("jsd"))


def best_allocation(rounds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, round, jsd_normed) of the round, or background file, with the lowest divergence."""
    return rounds.groupBy(*keys).agg(F.min(F.struct("jsd_normed", "round")).alias("b")).select(*keys, F.col("b.round").alias("round"), F.col("b.jsd_normed").alias("jsd_normed"))
