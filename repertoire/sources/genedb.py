"""Gene tables: built from gapped reference sequences, checked, written and read.

A table has a row for each gene: gene, organism, chain (A recombines V and J, B also D), region, nucseq, frame,
aligned_protseq, cdr_columns (``start-stop``, from 1, joined by ``;``) and cdrs (the columns' letters, joined by ``;``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repertoire.functions.sequences import translate_frame
from repertoire.operators.broadcasts import bounded
from repertoire.sources.tables import read_fasta

GAP = "."
FIELDS = ("gene", "organism", "chain", "region", "nucseq", "frame", "aligned_protseq", "cdr_columns", "cdrs")


@dataclass(frozen=True)
class Layout:
    """Where loops lie in the aligned proteins of a locus (the third letter of its gene names): its chain, the columns of
    the loops, the column of the conserved C, and columns that are inserted to bring it in line with another locus."""

    chain: str
    loops: tuple[tuple[int, int], ...]
    c_column: int
    inserted: tuple[int, ...] = ()


def _translated(nuc: Column, offset: Column) -> Column:
    return F.when(offset == 0, translate_frame(nuc, 1)).when(offset == 1, translate_frame(nuc, 2)).when(offset == 2, translate_frame(nuc, 3))


def reference_records(fasta: DataFrame, *, species: str, prefix: str = "TR") -> DataFrame:
    """(gene, region, sequence) of records whose header is ``accession|gene|species|function|REGION|...``."""
    part = F.split("header", r"\|")
    rows = fasta.select(part[1].alias("gene"), part[2].alias("species"), part[4].alias("region"), "sequence")
    rows = rows.where(F.contains("species", F.lit(species)) & F.col("region").isin("V-REGION", "D-REGION", "J-REGION") & F.col("gene").startswith(prefix))
    return rows.select("gene", F.substring("region", 1, 1).alias("region"), "sequence")


def build_genes(gapped: DataFrame, nucleotides: DataFrame, layouts: dict[str, Layout], *, organism: str, species: str, prefix: str = "TR") -> tuple[DataFrame, DataFrame]:
    """(gene table, rejected genes with reason) from FASTA records (header, sequence) of gapped proteins and nucleotides.

    The frame is the one whose translation is the protein. V proteins are filled with gaps to the longest of their
    chain, loops by the columns of their locus, the last one from the C to the end; J proteins are set so
    that the G-x-G behind their loops stands in one column; D genes are read in the first frame. Rejected: no
    nucleotides, no frame that gives the protein, a J gene without G-x-G, a locus without layout.
    """
    spark = gapped.sparkSession
    rows = [(locus, x.chain, x.c_column, [list(c) for c in x.loops], list(x.inserted)) for locus, x in layouts.items()]
    columns = spark.createDataFrame(rows, "locus string, chain string, c_column int, loops array<array<int>>, inserted array<int>")
    nuc = reference_records(nucleotides, species=species, prefix=prefix).select("gene", F.lower("sequence").alias("nucseq"), "region")
    protein = reference_records(gapped, species=species, prefix=prefix).select("gene", F.upper("sequence").alias("aligned"))
    x = nuc.join(protein, "gene", "full").withColumn("region", F.coalesce("region", F.substring("gene", 4, 1)))
    x = x.withColumn("locus", F.substring("gene", 3, 1)).join(F.broadcast(columns), "locus", "left")
    shifted = F.aggregate("inserted", F.col("aligned"), lambda s, at: F.concat(F.substr(s, F.lit(1), at - 1), F.lit(GAP), F.substr(s, at, F.length(s))))
    x = x.withColumn("aligned", F.when((F.col("region") == "V") & (F.size("inserted") > 0), shifted).otherwise(F.col("aligned")))
    x = x.withColumn("protein", F.when(F.col("region") == "D", translate_frame(F.col("nucseq"), 1)).otherwise(F.replace("aligned", F.lit(GAP), F.lit(""))))
    fits = F.filter(F.array(*[F.when(translate_frame(F.col("nucseq"), f + 1) == F.col("protein"), F.lit(f)) for f in range(3)]), lambda f: f.isNotNull())
    x = x.withColumns({"offset": F.when(F.col("region") == "D", 0).otherwise(F.get(fits, F.lit(0)))})
    x = x.withColumn("inside", F.when((F.col("region") == "J") & F.col("protein").rlike("[FW]G.G"), F.length(F.regexp_extract("protein", "^(.*?[FW])G.G", 1))))
    reason = (
        F.when(F.col("chain").isNull(), "no_layout")
        .when(F.col("nucseq").isNull(), "no_nucleotides")
        .when(F.col("protein").isNull(), "no_protein")
        .when(F.col("offset").isNull(), "no_frame")
        .when((F.col("region") == "J") & F.col("inside").isNull(), "no_loop_end")
    )
    x = x.withColumn("reason", reason)
    rejected = x.where("reason is not null").select("gene", "region", "reason")
    good = x.where("reason is null")
    widths = good.groupBy("chain", "region").agg(
        F.max(F.when(F.col("region") == "V", F.length("aligned")).when(F.col("region") == "D", F.length("protein"))).alias("width"),
        F.max("inside").alias("before"), F.max(F.length("protein") - F.col("inside")).alias("behind"),
    )
    good = good.join(bounded(widths), ["chain", "region"])
    gaps = lambda n: F.repeat(F.lit(GAP), n)
    aligned = (
        F.when(F.col("region") == "V", F.concat("aligned", gaps(F.col("width") - F.length("aligned"))))
        .when(F.col("region") == "J", F.concat(gaps(F.col("before") - F.col("inside")), "protein", gaps(F.col("behind") - F.length("protein") + F.col("inside"))))
        .otherwise(F.concat("protein", gaps(F.col("width") - F.length("protein"))))
    )
    good = good.withColumn("aligned_protseq", aligned)
    spans = F.when(F.col("region") == "V", F.concat("loops", F.array(F.array("c_column", F.length("aligned_protseq"))))).when(F.col("region") == "J", F.array(F.array(F.lit(1), F.col("before"))))
    good = good.withColumn("spans", F.coalesce(spans, F.array().cast("array<array<int>>")))
    cut = F.transform("spans", lambda s: F.substr("aligned_protseq", s[0], s[1] - s[0] + 1))
    named = F.transform("spans", lambda s: F.concat_ws("-", s[0].cast("string"), s[1].cast("string")))
    table = good.select(
        "gene", F.lit(organism).alias("organism"), "chain", "region", "nucseq", F.concat(F.lit("+"), (F.col("offset") + 1).cast("string")).alias("frame"), "aligned_protseq",
        F.array_join(named, ";").alias("cdr_columns"), F.array_join(cut, ";").alias("cdrs"),
    )
    return table, rejected


def genes_from_fasta(spark, gapped_path: str, nucleotide_path: str, layouts: dict[str, Layout], *, organism: str, species: str) -> tuple[DataFrame, DataFrame]:
    """``build_genes`` of two FASTA files."""
    return build_genes(read_fasta(spark, gapped_path), read_fasta(spark, nucleotide_path), layouts, organism=organism, species=species)


def checked_genes(genes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that hold together, others with reason) of a table as ``read_genes`` gives it, with cdrs and cdr_columns as arrays:
    the frame is one of three, the translation is the aligned protein without gaps, and the loops are its columns."""
    frame = F.regexp_extract("frame", r"^\+?([123])$", 1)
    protein = _translated(F.col("nucseq"), frame.try_cast("int") - 1)
    given = F.replace("aligned_protseq", F.lit(GAP), F.lit(""))
    cut = F.transform("cdr_columns", lambda s: F.substr("aligned_protseq", s["start"], s["stop"] - s["start"] + 1))
    reason = (
        F.when(frame == "", "bad_frame")
        .when(~protein.eqNullSafe(given), "translation")
        .when((F.size("cdr_columns") > 0) & ~F.col("cdrs").eqNullSafe(cut), "loops")
    )
    marked = genes.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")
