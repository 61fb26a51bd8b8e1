"""Clonotype calling: reads to clones, gene consolidation, averaged scores."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repertoire.functions import tables
from repertoire.functions.sequences import letters, mismatches
from repertoire.operators.broadcasts import bounded
from repertoire.operators.graph import _ready, components

#: Columns of ';'-joined gene sets.
GENE_COLUMNS = ("va", "ja", "vb", "jb")
#: Quality below which a single mismatch may be an error.
MERGE_QUALITY = 20
#: One mismatch is an error too if the non-germline part has no more, or the junction is as unlikely as this log10.
NEW_MISMATCHES, UNLIKELY = 1, -15
#: Mismatches that non-germline parts of unequal lengths count as.
UNEQUAL = 9
#: Plain sequences that one with ambiguous bases may stand for, before it is compared base by base.
MOST_FORMS = 64
#: What groups of one clone share.
FAMILY = ["epitope", "subject", "same"]


def read_groups(reads: DataFrame) -> DataFrame:
    """Identical receptors of a subject: (key, node, epitope, subject, genes, nuc_a, nuc_b, size, qa, qb, first_read, new, log10_p).

    A read is in one group, so the first read names it (``node``). ``new`` joins the non-germline parts of both chains and ``log10_p`` is the truncated log10 probability of
    the junctions; both are null where the reads have no columns ``new_a`` and ``new_b`` or ``log10_p``.
    """
    cols = ["epitope", "subject", *GENE_COLUMNS, "nuc_a", "nuc_b"]
    new = F.min(F.concat_ws(" ", "new_a", "new_b")) if {"new_a", "new_b"} <= set(reads.columns) else F.lit(None).cast("string")
    p = F.min(F.col("log10_p").cast("int")) if "log10_p" in reads.columns else F.lit(None).cast("int")
    groups = reads.groupBy(*cols).agg(
        F.count(F.lit(1)).alias("size"), F.max("qual_a").alias("qa"), F.max("qual_b").alias("qb"), F.min("read_id").alias("first_read"), new.alias("new"), p.alias("log10_p")
    )
    return groups.withColumns({"key": F.concat_ws("|", *cols), "node": F.col("first_read")})


def _forms(seq: Column) -> Column:
    """The plain sequences that a sequence with ambiguous bases may be; null where there are more than ``MOST_FORMS``."""
    bases = tables.as_map(tables.IUPAC)
    each = F.transform(letters(F.lower(seq)), lambda x: F.coalesce(F.try_element_at(bases, x), x))
    # only ambiguous places multiply, so a plain sequence is its own form
    count = F.aggregate(each, F.lit(1), lambda t, x: F.least(F.lit(MOST_FORMS + 1), t * F.length(x)))
    grown = F.aggregate(
        F.when(count <= MOST_FORMS, each), F.array(F.lit("")), lambda t, x: F.flatten(F.transform(t, lambda s: F.transform(letters(x), lambda y: F.concat(s, y))))
    )
    return F.when(count == 1, F.array(F.lower(seq))).otherwise(grown)


def _sides(groups: DataFrame) -> Iterator[DataFrame]:
    """The groups twice: with the chain that must be identical as ``same``, the other as ``other`` and its quality as ``q``."""
    for same, other, q in (("nuc_a", "nuc_b", "qb"), ("nuc_b", "nuc_a", "qa")):
        named = groups.select("epitope", "subject", F.col(same).alias("same"), F.col(other).alias("other"), F.col(q).alias("q"), "size", "key", "node", "new", "log10_p", *GENE_COLUMNS)
        yield named.withColumn("forms", _forms(F.col("other")))


def _by_genes(df: DataFrame) -> DataFrame:
    """A row for each choice of one gene of every set: sets have genes in common if they share a choice."""
    for i, g in enumerate(GENE_COLUMNS):
        df = df.withColumn(f"g{i}", F.explode(F.split(g, ";"))).drop(g)
    return df.withColumn("genes", F.concat_ws("|", *[f"g{i}" for i in range(len(GENE_COLUMNS))])).drop(*[f"g{i}" for i in range(len(GENE_COLUMNS))])


def near_forms(rows: DataFrame, poor: Column) -> DataFrame:
    """(epitope, subject, same, form, near): forms of equal length that differ in one place, where a row of the first is
    ``poor``. Forms meet by what is left when a place is blanked, so a form meets three others at each place at most."""
    at = [*FAMILY, "form"]
    classes = rows.groupBy(*at).agg(F.bool_or(poor).alias("poor"))
    place = F.explode(F.sequence(F.lit(1), F.length("form"))).alias("i")
    blank = F.concat(F.expr("substr(form, 1, i - 1)"), F.lit("_"), F.expr("substr(form, i + 1)"))
    open_ = classes.where(F.length("form") > 0).select(*at, "poor", place).withColumn("blank", blank)
    far = open_.select(*FAMILY, "i", "blank", F.col("form").alias("near"))
    return open_.where("poor").join(far, [*FAMILY, "i", "blank"]).where("form <> near").select(*at, "near")


def _star_edges(rows: DataFrame) -> DataFrame:
    """(a, b): rows of one form, identical other chain and choice of genes, each with the first of them."""
    cell = Window.partitionBy(*FAMILY, "form", "genes")
    return rows.select("node", F.min("node").over(cell).alias("first")).where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))


def _error_edges(rows: DataFrame) -> DataFrame:
    """(a, b): poor singletons and the best group of each cell of a near form whose quality or order is ahead of theirs.

    Groups of one cell are one clone by ``_star_edges``, so an edge to any of them is enough; the one of highest
    quality, then smallest key, allows an edge if any does.
    """
    poor = (F.col("size") == 1) & (F.col("q") < MERGE_QUALITY)
    unlikely = F.coalesce(F.col("log10_p") < UNLIKELY, F.lit(False)).alias("unlikely")
    best = rows.groupBy(*FAMILY, F.col("form").alias("near"), "genes", F.col("new").alias("near_new"), unlikely).agg(F.min(F.struct((-F.col("q")).alias("q"), "key", "node")).alias("o"))
    asked = rows.where(poor).select(*FAMILY, "form", "genes", "q", "key", "node", "new", unlikely.alias("own_unlikely"))
    pairs = asked.join(near_forms(rows, poor), [*FAMILY, "form"]).join(best, [*FAMILY, "near", "genes"])
    ahead = (-F.col("o.q") > F.col("q")) | ((-F.col("o.q") == F.col("q")) & (F.col("o.key") < F.col("key")))
    changed = F.when(F.length("new") != F.length("near_new"), UNEQUAL).otherwise(mismatches(F.col("new"), F.col("near_new")))
    junction = F.coalesce(changed <= NEW_MISMATCHES, F.lit(True)) | F.col("unlikely") | F.col("own_unlikely")
    return pairs.where(ahead & junction).select(F.col("node").alias("a"), F.col("o.node").alias("b"))


def _compared_edges(rows: DataFrame) -> DataFrame:
    """(a, b) of groups where one has too many ambiguous bases for forms: these are compared with all of their family."""
    own = ["other", "q", "size", "key", "node", "new", "log10_p", *GENE_COLUMNS]
    wide = rows.where("forms is null").select(*FAMILY, F.length("other").alias("len"), *[F.col(c).alias(f"{c}1") for c in own])
    every = rows.select(*FAMILY, F.length("other").alias("len"), *[F.col(c).alias(f"{c}2") for c in own])
    pairs = wide.join(every, [*FAMILY, "len"]).where("key1 <> key2")
    for g in GENE_COLUMNS:
        pairs = pairs.where(F.arrays_overlap(F.split(f"{g}1", ";"), F.split(f"{g}2", ";")))
    miss = mismatches(F.col("other1"), F.col("other2"))
    first_is_low = (F.col("q1") < F.col("q2")) | ((F.col("q1") == F.col("q2")) & (F.col("key1") > F.col("key2")))
    low = F.when(first_is_low, F.col("size1")).otherwise(F.col("size2"))
    changed = F.when(F.length("new1") != F.length("new2"), UNEQUAL).otherwise(mismatches(F.col("new1"), F.col("new2")))
    junction = F.coalesce(changed <= NEW_MISMATCHES, F.lit(True)) | F.coalesce(F.least("log10_p1", "log10_p2") < UNLIKELY, F.lit(False))
    merge = (miss == 0) | ((miss == 1) & (F.least("q1", "q2") < MERGE_QUALITY) & (low == 1) & junction)
    return pairs.where(merge).select(F.col("node1").alias("a"), F.col("node2").alias("b"))


def merge_edges(groups: DataFrame) -> DataFrame:
    """(a, b) nodes whose components are the clones: two groups are one clone if all four gene sets have a gene in common,
    lengths are equal, one chain is identical, and the other has no mismatch, or one where the group with the lower
    quality (of equal ones, the larger key) is a poor singleton and the mismatch is no change of the junction (or
    the junction unlikely to come twice).

    Edges grow with the groups, not with their pairs: equal chains are stars over choices of genes, a mismatch is found
    by blanking a place, and a poor singleton takes one edge to each cell it belongs with.
    """
    _ready(groups.sparkSession)
    out = None
    for side in _sides(groups):
        side = side.checkpoint()
        rows = _by_genes(side.where("forms is not null").withColumn("form", F.explode("forms")).drop("forms", "other"))
        kinds = [_star_edges(rows), _error_edges(rows)]
        if not side.where("forms is null").limit(1).isEmpty():
            kinds.append(_compared_edges(side))
        for edges in kinds:
            out = edges if out is None else out.unionAll(edges)
    return out.distinct()


def call_clones(reads: DataFrame, min_quality_for_singletons: int = 20) -> DataFrame:
    """(clone_id, epitope, subject, genes, nuc_a, nuc_b, clone_size, members): components of the merge
    edges; the representative has the most reads, then quality, then key; poor singletons go."""
    groups = read_groups(reads).checkpoint()
    labels = components(merge_edges(groups), groups.select("node"))
    joined = groups.join(labels, "node")
    rep = F.max_by(F.struct(*GENE_COLUMNS, "nuc_a", "nuc_b", "first_read", F.least("qa", "qb").alias("q")), F.struct("size", F.least("qa", "qb"), "key"))
    clones = joined.groupBy("epitope", "subject", "component").agg(rep.alias("r"), F.sum("size").alias("clone_size"), F.array_sort(F.collect_list("first_read")).alias("members"))
    kept = clones.where((F.col("clone_size") > 1) | (F.col("r.q") >= min_quality_for_singletons))
    return kept.select(
        F.concat(F.col("r.first_read").cast("string"), F.lit(".clone")).alias("clone_id"), "epitope", "subject", *[F.col(f"r.{c}").alias(c) for c in (*GENE_COLUMNS, "nuc_a", "nuc_b")], "clone_size", "members"
    )


def consolidate_genes(members: DataFrame, clone: str, genes: str) -> DataFrame:
    """(clone, genes): genes that all members share, else the most frequent ones."""
    n = members.groupBy(clone).agg(F.count(F.lit(1)).alias("__size"))
    counts = members.select(clone, F.explode(genes).alias("g")).groupBy(clone, "g").agg(F.count(F.lit(1)).alias("__c"))
    best = counts.withColumn("__m", F.max("__c").over(Window.partitionBy(clone))).join(n, clone)
    return best.where(F.col("__c") == F.col("__m")).groupBy(clone).agg(F.array_sort(F.collect_list("g")).alias(genes))


def with_representatives(consolidated: DataFrame, clone: str, genes: str, classes: DataFrame) -> DataFrame:
    """Adds ``reps`` and ``countreps`` of the consolidated genes of each clone, the sorted distinct ones; a gene without a class
    stands for itself. ``classes``: (gene, rep, count_rep), a dimension."""
    each = consolidated.select(clone, F.explode(genes).alias("gene")).join(bounded(classes.select("gene", "rep", "count_rep")), "gene", "left")
    named = lambda c: F.array_sort(F.collect_set(F.coalesce(c, "gene")))
    return consolidated.join(each.groupBy(clone).agg(named("rep").alias("reps"), named("count_rep").alias("countreps")), clone, "left")


def average_scores(members: DataFrame, clone: str, score: str, none_score: float, tolerance: float = 1e-3) -> DataFrame:
    """(clone, score): mean over members that have a score; the sentinel if none has."""
    real = F.when(F.abs(F.col(score) - none_score) > tolerance, F.col(score))
    return members.groupBy(clone).agg(F.coalesce(F.avg(real), F.lit(none_score)).alias(score))


def fake_chain(clones: DataFrame, seq: str, gene: str) -> DataFrame:
    """(is_fake): whether a chain has one distinct (gene, CDR3) in all clones."""
    return clones.agg((F.count_distinct(F.struct(gene, seq)) == 1).alias("is_fake"))


def nonzero_probability(df: DataFrame, p: str, group: str) -> DataFrame:
    """Zero probabilities replaced by the smallest other one of the group."""
    least = F.min(F.when(F.col(p) > 0, F.col(p))).over(Window.partitionBy(group))
    return df.withColumn(p, F.when(F.col(p) > 0, F.col(p)).otherwise(least))


def clonality_fraction(clones: DataFrame) -> DataFrame:
    """Adds (size^(1/3) - 1) / (largest^(1/3) - 1) of the epitope."""
    root = lambda c: F.pow(c.cast("double"), F.lit(1 / 3)) - 1
    most = F.max("clone_size").over(Window.partitionBy("epitope"))
    return clones.withColumn("fraction", F.when(most > 1, root(F.col("clone_size")) / root(most)).otherwise(0.0))
