"""Diversity and sharing of repertoires."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repertoire.functions.sequences import safe_inverse
from repertoire.operators.distance import distance_counts, gaussian, kernel_sums, near_subjects, pair_sums, pairs_within

#: Distance at which the Gaussian of a chain falls to 1/e.
THRESHOLD = 25 / 1.298


def clonality(clones: DataFrame) -> DataFrame:
    """(epitope, p, diversity, evenness): chance that two reads of one subject are of one clone."""
    x = F.col("clone_size")
    subjects = clones.groupBy("epitope", "subject").agg(F.sum(x * (x - 1)).alias("same"), F.sum(x).alias("reads"))
    total = subjects.groupBy("epitope").agg(F.sum("same").alias("same"), F.sum(F.col("reads") * (F.col("reads") - 1)).alias("pairs"))
    p = F.when(F.col("pairs") > 0, F.col("same") / F.col("pairs"))
    return total.select("epitope", p.alias("p"), safe_inverse(p).alias("diversity"), (1 - p).alias("evenness"))


def clonality_by_subject(clones: DataFrame) -> DataFrame:
    x = F.col("clone_size")
    subjects = clones.groupBy("epitope", "subject").agg(F.sum(x * (x - 1)).alias("same"), F.sum(x).alias("reads"))
    return subjects.select("epitope", "subject", "reads", F.when(F.col("reads") > 1, F.col("same") / (F.col("reads") * (F.col("reads") - 1))).otherwise(0.0).alias("p"))


def gaussian_diversity(clones: DataFrame, genes: DataFrame | None, threshold: float = THRESHOLD) -> DataFrame:
    """(epitope, chains, same_subject, overlap, pairs, diversity) within epitopes; pairs count once.

    Whole-number distances are counted: all pairs of an epitope, less those within its subjects where these are left out."""
    every = distance_counts(clones, genes)
    if every is not None:
        kernel = F.exp(-F.pow(F.col("d") / (threshold * F.length("chains")), 2))
        sums = lambda x: x.groupBy("epitope", "chains").agg((F.sum(F.col("n") * kernel) / 2).alias("overlap"), (F.sum("n") / 2).alias("pairs"))
        name = F.concat_ws("|", F.col("subject").cast("string"), "epitope")
        own = distance_counts(clones.where("subject is not null and epitope is not null").withColumn("__of", name), genes, unit="__of")
        own = sums(own.withColumn("epitope", F.split("unit", r"\|", 2)[1]))
        whole = sums(every.withColumnRenamed("unit", "epitope"))
        left = whole.join(own.select("epitope", "chains", F.col("overlap").alias("__o"), F.col("pairs").alias("__p")), ["epitope", "chains"], "left")
        apart = left.select("epitope", "chains", (F.col("overlap") - F.coalesce("__o", F.lit(0.0))).alias("overlap"), (F.col("pairs") - F.coalesce("__p", F.lit(0.0))).alias("pairs")).where("pairs > 0")
        rows = whole.withColumn("same_subject", F.lit(True)).unionByName(apart.withColumn("same_subject", F.lit(False)))
        rows = rows.select("epitope", "chains", "same_subject", "overlap", "pairs")
        return rows.select("*", F.when(F.col("overlap") > 0, F.col("pairs") / F.col("overlap")).alias("diversity"))
    sums = pair_sums(clones, genes, gaussian(threshold))
    sums = sums.select("unit", "chains", (F.col("n") / 2).alias("n"), (F.col("total") / 2).alias("total"), (F.col("subject1") == F.col("subject2")).alias("same"))
    both = F.explode(F.when(F.col("same"), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False))))
    rows = sums.withColumn("same_subject", both).groupBy(F.col("unit").alias("epitope"), "chains", "same_subject").agg(F.sum("total").alias("overlap"), F.sum("n").alias("pairs"))
    return rows.select("*", F.when(F.col("overlap") > 0, F.col("pairs") / F.col("overlap")).alias("diversity"))


def gaussian_shannon(clones: DataFrame, genes: DataFrame | None, threshold: float = THRESHOLD) -> DataFrame:
    """(epitope, chains, entropy, diversity, n): mean of -ln of each clone's mean kernel; diversity 2^entropy."""
    sums = kernel_sums(clones, genes, gaussian(threshold))
    each = F.when((F.col("n") > 0) & (F.col("total") > 0), -F.log(F.col("total") / F.col("n")))
    rows = sums.groupBy(F.col("unit").alias("epitope"), "chains").agg(F.avg(each).alias("entropy"), F.count(F.lit(1)).alias("n"))
    return rows.select("*", F.pow(F.lit(2.0), "entropy").alias("diversity"))


def same_receptor(a: str, b: str, chains: str = "AB", j: bool = True) -> Column:
    """Whether the receptors of two sides (prefixes of struct columns) are one: equal CDR3s, and overlapping V
    and J gene sets (V only unless ``j``), on every chain."""
    tests = []
    for c in chains.lower():
        tests.append(F.col(f"{a}.cdr3{c}") == F.col(f"{b}.cdr3{c}"))
        tests += [F.arrays_overlap(f"{a}.{g}{c}_genes", f"{b}.{g}{c}_genes") for g in ("vj" if j else "v")]
    return reduce(lambda x, y: x & y, tests)


def _receptor(chains: str, j: bool = True) -> list[str]:
    return [x for c in chains.lower() for x in (f"cdr3{c}", *(f"{g}{c}_genes" for g in ("vj" if j else "v")))]


def exact_matches(clones: DataFrame, chains: str) -> DataFrame:
    """Pairs (clone_id1 < clone_id2) of equal receptors: an equi-join on the CDR3s with the set tests as residual."""
    seqs = [f"cdr3{c}" for c in chains.lower()]
    keep = lambda n: clones.select(*seqs, *[F.col(x).alias(f"{x}{n}") for x in ("clone_id", "epitope", "subject")], F.struct(*_receptor(chains)).alias(f"r{n}"))
    return keep(1).join(keep(2), seqs).where(F.col("clone_id1") < F.col("clone_id2")).where(same_receptor("r1", "r2", chains)).drop("r1", "r2", *seqs)


def exact_match_counts(clones: DataFrame, chains: str) -> DataFrame:
    """(epitope, subject1 < subject2, overlap): pairs of equal receptors of two subjects of an epitope. Equal receptors of a
    subject are counted before they meet those of another, so no pair of clones is made."""
    seqs = [f"cdr3{c}" for c in chains.lower()]
    sets = [x for x in _receptor(chains) if x not in seqs]
    kinds = clones.groupBy("epitope", "subject", F.struct(*seqs, *[F.array_sort(F.array_distinct(x)).alias(x) for x in sets]).alias("r")).agg(F.count(F.lit(1)).alias("n"))
    side = lambda i: kinds.select("epitope", *[F.col(f"r.{x}").alias(x) for x in seqs], *[F.col(x).alias(f"{x}{i}") for x in ("subject", "r", "n")])
    met = side(1).join(side(2), ["epitope", *seqs]).where("subject1 < subject2").where(same_receptor("r1", "r2", chains))
    return met.groupBy("epitope", "subject1", "subject2").agg(F.sum(F.col("n1") * F.col("n2")).alias("overlap"))


def gene_matches(clones: DataFrame, chain: str) -> DataFrame:
    """(clone_id1, clone_id2, epitope1, epitope2, subject1, subject2) of pairs whose V sets overlap and J agree."""
    c = chain.lower()
    keep = lambda n: clones.select(
        F.explode(f"v{c}_genes").alias("v"), F.explode_outer(f"j{c}_genes").alias("j"), *[F.col(x).alias(f"{x}{n}") for x in ("clone_id", "epitope", "subject")]
    )
    return keep(1).join(keep(2), ["v", "j"]).where("clone_id1 < clone_id2").drop("v", "j").dropDuplicates(["clone_id1", "clone_id2"])


def gene_match_counts(clones: DataFrame, chains: str) -> DataFrame:
    """(epitope, subject1, subject2, overlap): gene-only matches (V and J sets of all chains overlap) between subjects
    of an epitope.

    Matching depends on the gene sets alone, so equal sets are counted first and pairs of sets are
    joined by a J gene in common; no pair of clones is made.
    """
    names = [f"{g}{c}_genes" for c in chains.lower() for g in "vj"]
    genes = F.struct(*[F.array_sort(F.array_distinct(n)).alias(n) for n in names])
    sets = clones.groupBy("epitope", "subject", genes.alias("g")).agg(F.count(F.lit(1)).alias("n")).withColumn("j", F.explode(f"g.{names[1]}"))
    a, b = (sets.select("epitope", "j", *[F.col(x).alias(f"{x}{i}") for x in ("subject", "g", "n")]) for i in (1, 2))
    pairs = a.join(b, ["epitope", "j"]).where("subject1 < subject2")
    for n in names:
        pairs = pairs.where(F.arrays_overlap(f"g1.{n}", f"g2.{n}"))
    return pairs.drop("j").distinct().groupBy("epitope", "subject1", "subject2").agg(F.sum(F.col("n1") * F.col("n2")).alias("overlap"))


def match_counts(pairs: DataFrame) -> DataFrame:
    """(epitope, subject1 < subject2, overlap) of pairs (epitope1, epitope2, subject1, subject2) of one epitope and two subjects."""
    own = pairs.where("epitope1 = epitope2 and subject1 <> subject2")
    return own.groupBy(F.col("epitope1").alias("epitope"), F.least("subject1", "subject2").alias("subject1"), F.greatest("subject1", "subject2").alias("subject2")).agg(F.count(F.lit(1)).alias("overlap"))


def sharing_grid(clones: DataFrame, genes: DataFrame | None, threshold: float | None = None, *, exact: DataFrame | None = None) -> DataFrame:
    """``sharing`` of every (mode, chains): equal receptors, genes alone, and distances within the threshold a chain.
    ``exact``: clones whose CDR3s stand for those of ``clones`` in the first mode."""
    radius = THRESHOLD if threshold is None else threshold
    out = []
    for chains in ("A", "B", "AB"):
        for mode, counts in (
            ("receptor", exact_match_counts(clones if exact is None else exact, chains)),
            ("genes", gene_match_counts(clones, chains)),
            ("distance", match_counts(pairs_within(clones, genes, radius, chains=(chains,))) if chains == "AB" else near_subjects(clones, genes, radius, chains)),
        ):
            out.append(sharing(counts, clones).select(F.lit(mode).alias("mode"), F.lit(chains).alias("chains"), "*"))
    return reduce(DataFrame.unionByName, out)


def unpaired_estimate(grid: DataFrame) -> DataFrame:
    """(mode, epitope, estimate, ratio): the product of both chains' diversities, and by what it exceeds that of pairs."""
    side = lambda c: grid.where(F.col("chains") == c).select("mode", "epitope", F.col("diversity").alias(c))
    rows = side("A").join(side("B"), ["mode", "epitope"]).join(side("AB"), ["mode", "epitope"])
    both = F.col("A") * F.col("B")
    return rows.select("mode", "epitope", both.alias("estimate"), F.when(F.col("AB") > 0, both / F.col("AB")).otherwise(0.0).alias("ratio"))


def gaussian_between(clones: DataFrame, genes: DataFrame | None, threshold: float = THRESHOLD) -> DataFrame:
    """(epitope1 < epitope2, chains, same_subject, overlap, pairs, diversity) of pairs between repertoires."""
    sums = pair_sums(clones.withColumn("__every", F.lit(1)), genes, gaussian(threshold), unit="__every").where("epitope1 < epitope2")
    rows = sums.groupBy("epitope1", "epitope2", "chains", (F.col("subject1") == F.col("subject2")).alias("same_subject"))
    rows = rows.agg(F.sum("total").alias("overlap"), F.sum("n").alias("pairs"))
    return rows.select("*", F.when(F.col("overlap") > 0, F.col("pairs") / F.col("overlap")).alias("diversity"))


def sharing(matches: DataFrame, clones: DataFrame) -> DataFrame:
    """(epitope, overlap, total, diversity, subject_pairs, sharing_pairs, top3) over pairs of different
    subjects of an epitope. ``matches``: (epitope, subject1, subject2, overlap), subject1 < subject2."""
    sizes = clones.groupBy("epitope", "subject").agg(F.count(F.lit(1)).alias("n"))
    a, b = sizes.select("epitope", F.col("subject").alias("subject1"), F.col("n").alias("n1")), sizes.select("epitope", F.col("subject").alias("subject2"), F.col("n").alias("n2"))
    pairs = a.join(b, "epitope").where("subject1 < subject2").join(matches, ["epitope", "subject1", "subject2"], "left")
    pairs = pairs.select("epitope", F.coalesce("overlap", F.lit(0)).alias("overlap"), (F.col("n1") * F.col("n2")).alias("total"))
    top = Window.partitionBy("epitope").orderBy(F.desc("overlap"), F.desc("total"))
    ranked = pairs.withColumn("r", F.row_number().over(top))
    rows = ranked.groupBy("epitope").agg(
        F.sum("overlap").alias("overlap"),
        F.sum("total").alias("total"),
        F.count(F.lit(1)).alias("subject_pairs"),
        F.sum((F.col("overlap") > 0).cast("long")).alias("sharing_pairs"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "overlap")))), lambda x: x["overlap"].cast("string")), " ").alias("top3"),
    )
    return rows.select("*", F.when(F.col("overlap") > 0, F.col("total") / F.col("overlap")).otherwise(0.0).alias("diversity"))


def shared_flags(clones: DataFrame, chains: str = "AB") -> DataFrame:
    """(clone_id, is_shared): whether another subject of the epitope has the same receptor (equal CDR3s and
    overlapping V and J sets). Different receptors of a subject are compared, not clones."""
    seqs = [f"cdr3{c}" for c in chains.lower()]
    key = ["epitope", *seqs]
    receptor = F.struct(*_receptor(chains))
    own = clones.select("clone_id", "subject", *key, receptor.alias("r1"))
    other = clones.select("epitope", "subject", receptor.alias("r2")).distinct().select(F.col("subject").alias("other"), "epitope", *[F.col(f"r2.{x}").alias(x) for x in seqs], "r2")
    cond = [own[k] == other[k] for k in key] + [own["subject"] != other["other"], same_receptor("r1", "r2", chains)]
    hit = own.join(other, reduce(lambda x, y: x & y, cond), "left_semi").select("clone_id", F.lit(True).alias("__hit"))
    return clones.select("clone_id").join(hit.distinct(), "clone_id", "left").select("clone_id", F.coalesce("__hit", F.lit(False)).alias("is_shared"))


def cross_reactivity(clones: DataFrame, chains: str) -> DataFrame:
    """(clone_id, n_subjects, n_subjects_any, n_epitopes, epitopes): where a clone's receptor is seen, by equal
    CDR3s and overlapping V sets (J genes are not looked at). Different receptors are compared, not clones."""
    seqs = [f"cdr3{c}" for c in chains.lower()]
    receptor = F.struct(*_receptor(chains, j=False))
    seen = clones.select(receptor.alias("r2"), "epitope", "subject").distinct().select("*", *[F.col(f"r2.{x}").alias(x) for x in seqs])
    kinds = clones.select(receptor.alias("r1")).distinct().select("*", *[F.col(f"r1.{x}").alias(x) for x in seqs])
    met = kinds.join(seen, seqs).where(same_receptor("r1", "r2", chains, j=False)).select("r1", "epitope", "subject").distinct()
    any_ = met.groupBy("r1").agg(
        F.count_distinct("subject").alias("n_subjects_any"), F.count_distinct("epitope").alias("n_epitopes"), F.array_join(F.array_sort(F.collect_set("epitope")), ";").alias("epitopes")
    )
    own = met.groupBy("r1", "epitope").agg(F.count(F.lit(1)).alias("n_subjects"))
    rows = clones.select("clone_id", "epitope", receptor.alias("r1"))
    return rows.join(own, ["r1", "epitope"]).join(any_, "r1").select("clone_id", "n_subjects", "n_subjects_any", "n_epitopes", "epitopes")
