"""Report tables over motifs, clusters and gene usage: reweighted weights, consensus, membership, orderings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repertoire.functions.sequences import letters
from repertoire.operators.broadcasts import bounded

#: Proportional fitting: exponent of a step, steps, deviation at which it stops.
FIT_EXPONENT, FIT_STEPS, FIT_DEVIATION = 0.25, 1000, 1e-3
#: Share of the best position's weight from which a position belongs to a cluster's consensus.
CONSENSUS_SHARE = 0.75
#: Enrichments that a report flags, and counts standing for none.
ENRICHED, DEPLETED, NO_COUNT = 2.0, 0.5, 0.25


def fit_pair_weights(pairs: pd.DataFrame, targets: list[dict[str, float]]) -> np.ndarray:
    """Weights of (v, j) pairs with counts ``n`` so that the weighted counts of each gene come to its target share:
    iterative proportional fitting, a gene at a time, by a power of what is wanted / what is there."""
    n = pairs["n"].to_numpy(float)
    weight, total = np.ones(len(pairs)), n.sum()
    codes = []
    for c, want in zip(("v", "j"), targets, strict=True):
        names, code = np.unique(pairs[c].to_numpy(str), return_inverse=True)
        whole = sum(want.values())
        codes.append((code, np.array([want.get(x, 0.0) for x in names]) * total / whole if whole else np.zeros(len(names))))
    before = np.inf
    for _ in range(FIT_STEPS):
        deviation = 0.0
        for code, want in codes:
            have = np.bincount(code, weight * n, len(want))
            deviation += float(np.abs(want - have).sum())
            weight = weight * ((want / np.maximum(have, 1e-300)) ** FIT_EXPONENT)[code]
        if deviation < FIT_DEVIATION or abs(before - deviation) < FIT_DEVIATION * 1e-3:
            break
        before = deviation
    return weight


def reweighted_positions(rows: DataFrame, targets: DataFrame, keys: list[str], seq: str, alphabet: str) -> DataFrame:
    """(keys, pos, letter, freq) of aligned background sequences, weighted so that their V and J usage is that of
    the foreground. ``rows``: (keys, v, j, seq), ``targets``: (keys, v, j). Only counts of gene pairs, which are
    dimensions, meet in a task; sequences are weighted by a join."""
    counts = rows.groupBy(*keys, "v", "j").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(0))
    wanted = targets.groupBy(*keys, "v", "j").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(1))
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        own, goal = x[x["side"] == 0].reset_index(drop=True), x[x["side"] == 1]
        if not len(own) or not len(goal):
            return pd.DataFrame(columns=[*keys, "v", "j", "weight"])
        own["weight"] = fit_pair_weights(own, [goal.groupby(c)["n"].sum().to_dict() for c in ("v", "j")])
        return own[[*keys, "v", "j", "weight"]]

    weights = counts.unionByName(wanted).groupBy(*keys).applyInPandas(run, f"{kinds}, v string, j string, weight double")
    seen = rows.join(weights, [*keys, "v", "j"]).select(*keys, "weight", F.posexplode(letters(F.col(seq))).alias("pos", "letter"))
    seen = seen.where(F.col("letter").isin(*alphabet)).groupBy(*keys, "pos", "letter").agg(F.sum("weight").alias("n"))
    return seen.select(*keys, "pos", "letter", (F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "pos"))).alias("freq"))


def scaled_entropy(forward: DataFrame, reverse: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, height): the smaller of two relative entropies / 3, between 0 and 1."""
    both = forward.withColumnRenamed("relent", "__f").join(reverse.withColumnRenamed("relent", "__r"), [*keys, "pos"])
    return both.select(*keys, "pos", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least("__f", "__r") / 3)).alias("height"))


def consensus_letter(n: Column, total: Column, letter: Column) -> Column:
    """A letter, capital from three quarters of a position, small from two fifths, else a dot."""
    share = n / total
    return F.when(share >= 0.75, F.upper(letter)).when(share >= 0.4, F.lower(letter)).otherwise(".")


def cluster_consensus(places: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, consensus) of clusters of motifs. ``places``: (keys, motif, is_center, expected, id, at, offsets, seq):
    where each member matches each clone (0-based place, and the offsets of the positions it matches).

    A member is shifted by the median difference of its places to the centre's over the clones of both; letters
    count 1, or 1 / expected for members expected more than once; the consensus holds the positions with three
    quarters of the best one's weight.
    """
    center = places.where("is_center").select(*keys, "id", F.col("at").alias("__c"))
    shift = places.join(center, [*keys, "id"]).groupBy(*keys, "motif").agg(F.median(F.col("__c") - F.col("at")).cast("int").alias("shift"))
    weight = F.when(F.col("expected") < 1, 1.0).otherwise(1.0 / F.col("expected"))
    seen = places.join(shift, [*keys, "motif"]).select(*keys, "seq", "at", "shift", weight.alias("w"), F.explode("offsets").alias("o"))
    seen = seen.select(*keys, (F.col("o") - F.col("shift")).alias("pos"), F.substr("seq", F.col("at") + F.col("o") + 1, F.lit(1)).alias("letter"), "w")
    counts = seen.groupBy(*keys, "pos", "letter").agg(F.sum("w").alias("n"))
    top = counts.groupBy(*keys, "pos").agg(F.max(F.struct("n", "letter")).alias("t"), F.sum("n").alias("total"))
    kept = top.withColumn("__m", F.max("total").over(Window.partitionBy(*keys))).where(F.col("total") >= CONSENSUS_SHARE * F.col("__m"))
    char = consensus_letter(F.col("t.n"), F.col("total"), F.col("t.letter"))
    rows = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", char.alias("c")))).alias("cs"))
    return rows.select(*keys, F.array_join(F.transform("cs", lambda x: x["c"]), "").alias("consensus"))


def aligned_weights(aligned: DataFrame, keys: list[str], gap: str = ".") -> DataFrame:
    """(keys, pos, letter, freq, gaps) of members aligned to their medoid. ``aligned``: (keys, a, b), the medoid's and
    the member's row of an alignment. A gap of the medoid counts once, at the position before it."""
    cells = aligned.select(*keys, F.posexplode(F.arrays_zip(letters(F.col("a")).alias("x"), letters(F.col("b")).alias("y"))).alias("i", "c"), "a")
    head = F.substr("a", F.lit(1), F.col("i"))
    pos = F.col("i") - (F.length(head) - F.length(F.replace(head, F.lit(gap), F.lit(""))))
    cells = cells.select(*keys, pos.alias("pos"), F.col("c.x").alias("x"), F.col("c.y").alias("y"), F.when(F.col("i") > 0, F.substr("a", F.col("i"), F.lit(1))).alias("before"))
    gaps = cells.where((F.col("x") == gap) & F.coalesce(F.col("before") != gap, F.lit(True))).groupBy(*keys, (F.col("pos") - 1).alias("pos")).agg(F.count(F.lit(1)).alias("gaps"))
    counts = cells.where(F.col("x") != gap).groupBy(*keys, "pos", F.col("y").alias("letter")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.select(*keys, "pos", "letter", (F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "pos"))).alias("freq"))
    return rows.join(gaps, [*keys, "pos"], "left").fillna(0, ["gaps"])


def cluster_membership(matches: DataFrame, motifs: DataFrame, keys: list[str], id_col: str = "clone_id") -> DataFrame:
    """(keys, id, cluster, cluster_rank) of clones that match a motif: the cluster of their strongest motif.
    ``motifs``: (keys, shown, cluster, chi_squared); clusters rank by their best motif."""
    best = motifs.groupBy(*keys, "cluster").agg(F.max("chi_squared").alias("__c"))
    ranked = best.withColumn("cluster_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__c"), "cluster"))).drop("__c")
    named = motifs.join(ranked, [*keys, "cluster"])
    rows = matches.select(*keys, "shown", id_col).join(bounded(named.select(*keys, "shown", "cluster", "cluster_rank", "chi_squared")), [*keys, "shown"])
    top = rows.groupBy(*keys, id_col).agg(F.max_by(F.struct("cluster", "cluster_rank"), F.struct("chi_squared", "shown")).alias("t"))
    return top.select(*keys, id_col, "t.cluster", "t.cluster_rank")


def matched_fraction(members: DataFrame, clones: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, matched, fraction) of a repertoire's clones that any motif matches."""
    total = clones.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    found = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("matched"))
    rows = total.join(found, keys, "left").fillna(0, ["matched"])
    return rows.select(*keys, "matched", (F.col("matched") / F.col("__n")).alias("fraction"))


def enrichment_flags(usage: DataFrame) -> DataFrame:
    """Adds ``shown`` (enriched twofold, or depleted by half) and ``heads``, the whole doublings either way."""
    e = F.col("enrich")
    heads = F.when(e > 0, F.floor(F.abs(F.log2(e)))).cast("int")
    return usage.withColumns({"shown": (e >= ENRICHED) | (e <= DEPLETED), "heads": heads})


def pair_enrichment(counts: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(group, a, b, n, expected, log2_enrich, tail) of gene pairs against independence: log2 of n (a quarter for none)
    over the expected count, and whether the pair is to be tested for being too frequent (1), too rare (-1) or neither."""
    over = lambda *k: F.sum("n").over(Window.partitionBy(group, *k))
    rows = counts.select(group, a, b, "n", over(a).alias("__a"), over(b).alias("__b"), over().alias("__t"))
    expected = F.col("__a") * F.col("__b") / F.col("__t")
    n = F.when(F.col("n") == 0, NO_COUNT).otherwise(F.col("n").cast("double"))
    tail = F.when(F.col("n") > expected, 1).when(F.col("n") < expected, -1).otherwise(0)
    rows = rows.where((F.col("__a") > 0) & (F.col("__b") > 0))
    return rows.select(group, a, b, "n", expected.alias("expected"), F.log2(n / expected).alias("log2_enrich"), tail.alias("tail"))


def pair_significance(p: Column, log2_enrich: Column) -> Column:
    """What gene pairs are ordered by: -log10 p / 5 and the size of the log2 enrichment."""
    return -F.log10(F.greatest(p, F.lit(1e-300))) / 5 + F.abs(log2_enrich)


def metric_order(metrics: DataFrame, keys: list[str] = ("metric", "chains")) -> DataFrame:
    """(keys, name, value, place): repertoires and random baselines of each metric in rising order."""
    keys = list(keys)
    return metrics.select(*keys, "name", "value", F.row_number().over(Window.partitionBy(*keys).orderBy("value", "name")).alias("place"))


def metric_table(base: DataFrame, sources: list[DataFrame], zero: tuple[str, ...] = ()) -> DataFrame:
    """``base`` (a row for each repertoire) with the metrics of all ``sources``, tables of (epitope, metrics) with one row for
    each; a repertoire that a source lacks has null there, or 0 for the metrics that ``zero`` names."""
    for df in sources:
        base = base.join(df, "epitope", "left")
    return base.withColumns({name: F.coalesce(name, F.lit(0.0)) for name in zero})


def by_chains(values: DataFrame, column: str, prefix: str) -> DataFrame:
    """(epitope, <prefix>_a, <prefix>_b, <prefix>_ab) of (epitope, chains, column)."""
    one = lambda c: F.max(F.when(F.col("chains") == c, F.col(column))).alias(f"{prefix}_{c.lower()}")
    return values.groupBy("epitope").agg(one("A"), one("B"), one("AB"))


def length_range(clones: DataFrame, seq: str) -> DataFrame:
    """(epitope, shortest, longest) lengths of a sequence."""
    return clones.groupBy("epitope").agg(F.min(F.length(seq)).alias("shortest"), F.max(F.length(seq)).alias("longest"))


def zero_filled(values: DataFrame, clones: DataFrame, column: str) -> DataFrame:
    """A value for every repertoire, 0 where it has none."""
    return clones.select("epitope").distinct().join(values, "epitope", "left").select("epitope", F.coalesce(F.col(column), F.lit(0.0)).alias(column))


def best_of_set(motifs: DataFrame, members: DataFrame, keys: list[str], id_col: str = "clone_id") -> DataFrame:
    """Of motifs that the same clones match, the one of highest chi-squared (ties: the larger text).
    Sets are compared by two sums of hashes of their ids, so no list of ids is gathered."""
    h = lambda s: F.sum(F.xxhash64(F.lit(s), id_col).cast("decimal(38,0)"))
    sets = members.select(*keys, "shown", id_col).distinct().groupBy(*keys, "shown").agg(F.count(F.lit(1)).alias("__n"), h(1).alias("__h1"), h(2).alias("__h2"))
    rows = motifs.join(sets, [*keys, "shown"])
    top = Window.partitionBy(*keys, "__n", "__h1", "__h2").orderBy(F.desc("chi_squared"), F.desc("shown"))
    return rows.withColumn("__r", F.row_number().over(top)).where("__r = 1").drop("__r", "__n", "__h1", "__h2")


def wide_scores(scores: DataFrame, key: str, name: list[str], values: list[str]) -> DataFrame:
    """One row for each key: a column for each value and combination of names (at most some hundred)."""
    tag = F.concat_ws("_", *name)
    rows = scores.select(key, F.explode(F.array(*[F.struct(F.concat_ws("_", tag, F.lit(v)).alias("k"), F.col(v).cast("double").alias("v")) for v in values])).alias("x"))
    return rows.groupBy(key).pivot("x.k").agg(F.first("x.v"))
