"""Gene dimension: equivalence classes of germline genes and lookups of set-valued gene cells.

A gene table (gene, chain, region, loops) is a dimension of hundreds of rows; comparing all its pairs is
cheap, and every lookup into it is a broadcast join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repertoire.functions import tables
from repertoire.functions.sequences import gene_of_allele, letters
from repertoire.operators.broadcasts import bounded
from repertoire.operators.graph import components


def representatives(genes: DataFrame) -> DataFrame:
    """(gene, rep): the smallest gene of the same chain and region with identical loops."""
    reps = genes.groupBy("chain", "region", "loops").agg(F.min("gene").alias("rep"))
    return genes.join(reps, ["chain", "region", "loops"]).select("gene", "rep")


def near_pairs(genes: DataFrame, most: int = 1, least_score: int = 1) -> DataFrame:
    """(a, b) of genes whose loops differ in at most ``most`` places, each by a likely substitution."""
    side = lambda n: genes.select("chain", "region", F.length("loops").alias("len"), F.col("gene").alias(n), F.col("loops").alias(f"l{n}"))
    score = tables.as_map(tables.blosum62())
    diff = F.filter(F.zip_with(letters(F.col("la")), letters(F.col("lb")), lambda x, y: F.when(x != y, F.coalesce(F.try_element_at(score, F.concat(x, y)), F.lit(-9)))), lambda s: s.isNotNull())
    pairs = side("a").join(side("b"), ["chain", "region", "len"]).where("a < b")
    return pairs.where((F.size(diff) <= most) & F.forall(diff, lambda s: s >= least_score)).select("a", "b")


def merged_representatives(genes: DataFrame, most: int = 1) -> DataFrame:
    """(gene, mm1_rep): the smallest gene reachable over near pairs."""
    found = components(near_pairs(genes, most), genes.select(F.col("gene").alias("node")))
    return found.select(F.col("node").alias("gene"), F.col("component").alias("mm1_rep"))


def counting_representatives(genes: DataFrame, most: int = 1) -> DataFrame:
    """(gene, count_rep): merged representatives without their allele."""
    return merged_representatives(genes, most).select("gene", gene_of_allele(F.col("mm1_rep")).alias("count_rep"))


def lookup(rows: DataFrame, id_col: str, genes_col: str, table: DataFrame, out: str) -> DataFrame:
    """Adds the sorted distinct representatives of a set-valued gene column; ``table``: (gene, rep)."""
    value = [c for c in table.columns if c != "gene"][0]
    each = rows.select(id_col, F.explode(genes_col).alias("gene")).join(bounded(table), "gene")
    return rows.join(each.groupBy(id_col).agg(F.array_sort(F.collect_set(value)).alias(out)), id_col, "left")


#: Mismatches of the CDR1 and CDR2 loops, of these with the CDR2.5 loop, and of the aligned protein up to behind the C.
LOOP_MISMATCHES, THREE_LOOP_MISMATCHES, WHOLE_MISMATCHES = 1, 2, 10
#: What a gap or stop opposite another letter counts as; the least substitution score of a mismatch in a loop.
GAP_MISMATCHES, LEAST_SCORE = 10, 1
ODD = [ord(x) for x in "*."]


def _letters(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Texts as rows of bytes, 0 where they are shorter."""
    return np.array([x.encode("ascii", "replace") for x in column.to_pylist()], f"S{max(width, 1)}").view(np.uint8).reshape(len(column), -1)


def _weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums over the columns of aligned parts of 0, 1, or ``GAP_MISMATCHES`` where a gap or stop meets another letter."""
    odd = np.isin(x, ODD) | np.isin(y, ODD)
    return np.where(x == y, 0, np.where(odd, GAP_MISMATCHES, 1)).sum(1)


def _kept_pairs(batches):
    """(a, b) of the pairs of genes that are equal or near."""
    scores = np.full((256, 256), -9, np.int8)
    for k, v in tables.blosum62().items():
        scores[ord(k[0]), ord(k[1])] = v
    for rows in batches:
        side = lambda n: [_letters(rows.column(f"{n}{i}"), max(len(t or "") for j in "ab" for t in rows.column(f"{n}{j}").to_pylist())) for i in "ab"]  # noqa: B023, E731
        kept = np.zeros(0, bool)
        if len(rows):
            (xa, xb), (ya, yb), (wa, wb) = side("two"), side("l3"), side("whole")
            in_two = _weights(xa, xb)
            likely = ((xa == xb) | (xa == 0) | (xb == 0) | (scores[xa, xb] >= LEAST_SCORE)).all(1)
            near = (in_two <= LOOP_MISMATCHES) & likely & (in_two + _weights(ya, yb) <= THREE_LOOP_MISMATCHES) & (_weights(wa, wb) <= WHOLE_MISMATCHES)
            kept = rows.column("equal").to_numpy(zero_copy_only=False) | near
        yield rows.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _v_loops(genes: DataFrame) -> DataFrame:
    """(organism, chain, gene, l1, l2, l3, whole) of V genes: three loops, and the aligned protein up to the residue behind the C."""
    return genes.select(
        "organism", "chain", "gene", F.get("cdrs", F.lit(0)).alias("l1"), F.get("cdrs", F.lit(1)).alias("l2"), F.get("cdrs", F.lit(2)).alias("l3"),
        F.expr("substr(aligned_protseq, 1, element_at(cdr_columns, -1).start + 1)").alias("whole"),
    )


def v_neighbours(genes: DataFrame) -> DataFrame:
    """(a, b), a < b, of V genes of one organism and chain whose CDR1 and CDR2 loops have one mismatch at most, and that a likely
    substitution; these and the CDR2.5 loop two at most; and the aligned proteins up to the residue behind the C ten.

    ``genes``: (gene, organism, chain, aligned_protseq, cdrs, cdr_columns), loops in columns of equal width. A
    mismatch in one of two loops leaves the other as it is, so pairs meet on an equal CDR1 or an equal CDR2.
    """
    return _near(_v_loops(genes))


def v_links(genes: DataFrame) -> DataFrame:
    """(a, b) of V genes that are connected by these links as they are by ``v_neighbours``: genes of equal loops are linked to the
    first of them, and of equal proteins only the first meets others."""
    own = _v_loops(genes)
    loops = ["organism", "chain", "l1", "l2", "l3"]
    first = own.dropna(subset=loops).withColumn("b", F.min("gene").over(Window.partitionBy(*loops)))
    kinds = own.groupBy(*loops, "whole").agg(F.min("gene").alias("gene"))
    return first.where("gene <> b").select(F.col("gene").alias("a"), "b").unionAll(_near(kinds, unequal=True))


def _near(own: DataFrame, *, unequal: bool = False) -> DataFrame:
    """``v_neighbours`` of genes with their loops; only those of different loops if ``unequal``."""
    side = lambda n, loop: own.select("organism", "chain", F.col(loop).alias("__same"), *[F.col(c).alias(f"{c}{n}") for c in ("gene", "l1", "l2", "l3", "whole")])
    equal = (F.col("l1a") == F.col("l1b")) & (F.col("l2a") == F.col("l2b")) & (F.col("l3a") == F.col("l3b"))
    pairs = None
    for loop in ("l1", "l2"):
        met = side("a", loop).join(side("b", loop), ["organism", "chain", "__same"]).where("genea < geneb").drop("__same")
        met = met.where(~F.coalesce(equal, F.lit(False))) if unequal else met
        pairs = met if pairs is None else pairs.unionAll(met.where("l1a <> l1b"))  # those of equal CDR1 have met
    parts = [c.alias(f"{n}{i}") for i in "ab" for n, c in (("two", F.concat(f"l1{i}", f"l2{i}")), ("l3", F.col(f"l3{i}")), ("whole", F.col(f"whole{i}")))]
    rows = pairs.select(F.col("genea").alias("a"), F.col("geneb").alias("b"), equal.alias("equal"), *parts).dropna()
    return rows.mapInArrow(_kept_pairs, "a string, b string")


def j_loops(genes: DataFrame) -> DataFrame:
    """J genes with ``loop``: the protein up to the end of the G-x-G behind the CDR3 loop."""
    protein = F.replace("aligned_protseq", F.lit("."), F.lit(""))
    return genes.withColumn("loop", F.substr(protein, F.lit(1), F.length(F.replace(F.get("cdrs", F.lit(0)), F.lit("."), F.lit(""))) + 3))


def gene_classes(genes: DataFrame) -> DataFrame:
    """(gene, rep, mm1_rep, count_rep) of V and J genes.

    ``rep``: the smallest gene of equal loops (J genes: loop and G-x-G); ``mm1_rep``: the smallest one reachable over
    ``v_neighbours`` (J genes: ``rep``); ``count_rep``: ``mm1_rep`` without its allele, where the alleles of one gene are
    in several classes that of the most alleles (of equal ones the greatest name).
    """
    v, j = genes.where("region = 'V'"), j_loops(genes.where("region = 'J'"))
    keyed = v.select("organism", "chain", "region", "gene", F.concat_ws(" ", F.slice("cdrs", 1, 3)).alias("loop")).unionByName(j.select("organism", "chain", "region", "gene", "loop"))
    reps = keyed.withColumn("rep", F.min("gene").over(Window.partitionBy("organism", "chain", "region", "loop"))).drop("loop")
    found = components(v_links(v), v.select(F.col("gene").alias("node"))).select(F.col("node").alias("gene"), F.col("component").alias("mm1"))
    classes = reps.join(found, "gene", "left").withColumn("mm1_rep", F.coalesce("mm1", "rep")).drop("mm1")
    classes = classes.withColumns({"name": gene_of_allele(F.col("gene")), "class": gene_of_allele(F.col("mm1_rep"))})
    kind = ["organism", "chain", "region"]
    sizes = classes.groupBy(*kind, "class").agg(F.count(F.lit(1)).alias("alleles"))
    several = classes.select(*kind, "name", "class").distinct().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*kind, "name"))).where("n > 1")
    merged = several.join(sizes, [*kind, "class"]).withColumn("top", F.max(F.struct("alleles", "class")).over(Window.partitionBy(*kind, "name"))["class"])
    merged = merged.groupBy(*kind, "class").agg(F.max("top").alias("top"))
    return classes.join(merged, [*kind, "class"], "left").select("gene", "rep", "mm1_rep", F.coalesce("top", "class").alias("count_rep"))
