"""Single-cell contigs to paired clones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repertoire.operators.broadcasts import bounded

_CHAIN = {"TRA": "A", "TRB": "B"}


def usable_contigs(contigs: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """Productive contigs of a clonotype with a CDR3 and both genes; allele ``*01`` is added to bare names.

    ``genes`` (gene) keeps known genes only; ``..DV..`` names are tried as ``../DV..`` too.
    """
    named = lambda c: F.when(F.contains(c, F.lit("*")), F.col(c)).otherwise(F.concat(c, F.lit("*01")))
    rows = contigs.where("raw_clonotype_id is not null and raw_clonotype_id not in ('', 'None') and lower(productive) = 'true' and cdr3 is not null and cdr3 <> 'None'")
    rows = rows.where(F.col("chain").isin(*_CHAIN)).withColumns({"v": named("v_gene"), "j": named("j_gene")})
    if genes is None:
        return rows
    slashed = F.regexp_replace("v", "(?<!/)DV", "/DV")
    known = bounded(genes.select(F.col("gene").alias("__g")).distinct())
    rows = rows.join(known, rows.v == F.col("__g"), "left").withColumn("v", F.when(F.col("__g").isNull(), slashed).otherwise(F.col("v"))).drop("__g")
    return rows.join(known, rows.v == F.col("__g"), "left_semi").join(known, rows.j == F.col("__g"), "left_semi")


def clonotype_chains(contigs: DataFrame) -> DataFrame:
    """(clonotype, chain, v, j, cdr3, cdr3_nt, umis, cells)."""
    keys = [F.col("raw_clonotype_id").alias("clonotype"), F.when(F.col("chain") == "TRA", "A").otherwise("B").alias("chain"), "v", "j", "cdr3", "cdr3_nt"]
    return contigs.groupBy(*keys).agg(F.sum("umis").alias("umis"), F.count_distinct("barcode").alias("cells"))


def barcodes(contigs: DataFrame) -> DataFrame:
    """(clonotype, size, barcodes)."""
    cells = contigs.select(F.col("raw_clonotype_id").alias("clonotype"), "barcode").distinct()
    return cells.groupBy("clonotype").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.array_sort(F.collect_list("barcode")), ",").alias("barcodes"))


def umi_discrepancies(contigs: DataFrame, consensus: DataFrame) -> DataFrame:
    """Chains whose UMI sum differs from the consensus table's; either side may lack a clonotype."""
    own = contigs.groupBy(F.col("raw_consensus_id").alias("consensus_id")).agg(F.sum("umis").alias("contig_umis"))
    return own.join(consensus.select("consensus_id", F.col("umis").alias("consensus_umis")), "consensus_id", "full").where("not contig_umis <=> consensus_umis")


def chain_pairs(chains: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b, support): cells of all clonotypes that hold both chains; a pairing product within a
    clonotype, whose few chains are its only members."""
    name = F.concat_ws("|", "v", "j", "cdr3", "cdr3_nt")
    a = chains.where("chain = 'A'").select("clonotype", name.alias("a"))
    b = chains.where("chain = 'B'").select("clonotype", name.alias("b"))
    return a.join(b, "clonotype").join(sizes.select("clonotype", "size"), "clonotype").groupBy("a", "b").agg(F.sum("size").alias("support"))


def accepted_pairs(pairs: DataFrame, fraction: float = 0.33) -> DataFrame:
    """(a, b, support): pairs by falling support; one whose chain is taken needs a third of the support
    of the pairs that took it. Order matters only among pairs linked by a chain, so each connected
    component of chains is one task's work."""
    from repertoire.operators.graph import components

    edges = pairs.select(F.concat(F.lit("A:"), "a").alias("a"), F.concat(F.lit("B:"), "b").alias("b"))
    nodes = edges.select(F.col("a").alias("node")).unionAll(edges.select(F.col("b").alias("node"))).distinct()
    label = components(edges, nodes)
    rows = pairs.join(label, F.concat(F.lit("A:"), pairs.a) == label.node).drop("node")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        took: dict[tuple[str, str], int] = {}
        out = []
        for r in rows.sort_values(["support", "a", "b"], ascending=[False, True, True]).itertuples():
            before = [took[k] for k in (("A", r.a), ("B", r.b)) if k in took]
            if not before or r.support >= fraction * max(before):
                took.setdefault(("A", r.a), r.support)
                took.setdefault(("B", r.b), r.support)
                out.append((r.a, r.b, r.support))
        return pd.DataFrame(out, columns=["a", "b", "support"])

    return rows.groupBy("component").applyInPandas(run, "a string, b string, support long")


def accepted_chains(chains: DataFrame, accepted: DataFrame) -> DataFrame:
    """The rows of ``chains`` that belong to an accepted pair within their own clonotype."""
    named = chains.withColumn("__name", F.concat_ws("|", "v", "j", "cdr3", "cdr3_nt"))
    a = named.where("chain = 'A'").select("clonotype", F.col("__name").alias("a"))
    b = named.where("chain = 'B'").select("clonotype", F.col("__name").alias("b"))
    pairs = a.join(b, "clonotype").join(accepted.select("a", "b"), ["a", "b"], "left_semi")
    kept = pairs.select("clonotype", F.explode(F.array(F.struct(F.lit("A").alias("chain"), F.col("a").alias("__name")), F.struct(F.lit("B").alias("chain"), F.col("b").alias("__name")))).alias("x"))
    return named.join(kept.select("clonotype", "x.*").distinct(), ["clonotype", "chain", "__name"], "left_semi").select(*chains.columns)


def paired_clones(chains: DataFrame, sizes: DataFrame) -> DataFrame:
    """(clonotype, a, a2, b, size): clonotypes with one beta and one or two alphas by UMIs; a single-alpha
    clonotype joins the one double-alpha clonotype that has its pair."""
    w = Window.partitionBy("clonotype", "chain").orderBy(F.desc("umis"), "v", "j", "cdr3_nt")
    ranked = chains.withColumn("r", F.row_number().over(w)).withColumn("name", F.concat_ws("|", "v", "j", "cdr3", "cdr3_nt"))
    pick = lambda c, i: F.max(F.when((F.col("chain") == c) & (F.col("r") == i), F.col("name")))
    n = lambda c: F.sum((F.col("chain") == c).cast("int"))
    rows = ranked.groupBy("clonotype").agg(pick("A", 1).alias("a"), pick("A", 2).alias("a2"), pick("B", 1).alias("b"), n("A").alias("na"), n("B").alias("nb"))
    rows = rows.where("nb = 1 and na in (1, 2)").join(sizes.select("clonotype", "size"), "clonotype")
    double = rows.where("na = 2").select(F.explode(F.array("a", "a2")).alias("a"), "b", F.col("clonotype").alias("target"))
    sole = double.groupBy("a", "b").agg(F.min("target").alias("target"), F.count(F.lit(1)).alias("k")).where("k = 1").drop("k")
    joined = rows.join(sole, ["a", "b"], "left").withColumn("clonotype", F.when((F.col("na") == 1) & F.col("target").isNotNull(), F.col("target")).otherwise(F.col("clonotype")))
    return joined.groupBy("clonotype").agg(F.max_by("a", "na").alias("a"), F.max_by("a2", "na").alias("a2"), F.max_by("b", "na").alias("b"), F.sum("size").alias("size"))
