"""Scans of match logs: raw V and J matches, and ``GENES`` lines of parsed CDR3s with their trims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repertoire.functions.sequences import reverse_complement, translate_frame
from repertoire.operators.broadcasts import bounded

# fixed values: places of fields in a GENES line, by chain
GENES_LENGTH_A, GENES_HEAD_B, GENES_D_FIELDS = 21, 16, 10
#: Fields of a V or J match that follow its gene and the word "score:".
MATCH_FIELDS = ("score", "offset", "start", "stop", "mismatches", "reversed")


def _words() -> Column:
    return F.split(F.trim("value"), r"\s+")



def read_genes_log(spark: SparkSession, path: str, chain: str, d_genes: int = 2) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of ``GENES`` lines; a line of another length than its chain's is bad.

    Alpha lines have ``v_trim``, ``j_trim``, ``vj_insert``; beta lines the array ``d`` of their D matches, best
    first (d_id 0 is no match, and a line whose best D is none is bad). Trims count upwards.
    """
    words = spark.read.text(path).where(F.col("value").startswith("GENES ")).select("value", _words().alias("w"))
    length = GENES_LENGTH_A if chain == "A" else GENES_HEAD_B + GENES_D_FIELDS * d_genes
    w = lambda i: F.get("w", F.lit(i)) if i >= 0 else F.get("w", F.size("w") + i)
    num = lambda i: w(i).try_cast("int")
    good = F.size("w") == length
    cols = {
        "v_gene": w(1), "v_rep": w(2), "j_gene": w(4), "j_rep": w(5), "cdr3": w(7), "new_nuc": w(12), "masked": w(13),
        "v_genes": F.split(w(-4), ","), "j_genes": F.split(w(-3), ","), "cdr3_nuc": w(-2), "file": F.get(F.split(w(-1), ":"), F.lit(1)),
    }
    if chain == "A":
        cols |= {"v_trim": -num(14), "j_trim": -num(15), "vj_insert": num(16)}
    else:
        good = good & (w(14) != "D0")
        each = []
        for k in range(d_genes):
            at = 14 + GENES_D_FIELDS * k
            names = ("d_nucs", "v_trim", "d0_trim", "d1_trim", "j_trim", "vd_insert", "dj_insert")
            values = [(num(at + 1 + i) * (-1 if n.endswith("trim") else 1)).alias(n) for i, n in enumerate(names)]
            each.append(F.struct(F.substr(w(at), F.lit(2)).try_cast("int").alias("d_id"), *values))
        cols["d"] = F.filter(F.array(*each), lambda x: x["d_id"] > 0)
    return words.where(good).select(*[c.alias(n) for n, c in cols.items()]), words.where(~good).select("value")


def read_match_log(spark: SparkSession, path: str) -> DataFrame:
    """V and J matches of raw log lines (those with ``v_offset:``, none with ``UNK``): (id, file, v_gene, v_score, ..,
    j_gene, .., v_genes, j_genes, nuc), the sequence turned where the match is reversed."""
    lines = spark.read.text(path).where(F.contains("value", F.lit("v_offset:")) & ~F.contains("value", F.lit("UNK"))).select(_words().alias("w"))
    at = lambda key, k: F.get("w", F.array_position("w", key).cast("int") - 1 + k)
    cols = {"id": F.concat(F.lit("L"), at("tsvfile_line_number:", 1)), "file": at("filename:", 1), "nuc": F.lower(at("nucleic:", 1))}
    for c in "vj":
        cols[f"{c}_gene"] = at(f"{c}seg:", 1)
        cols |= {f"{c}_{f}": at(f"{c}seg:", 3 + 2 * i).try_cast("int") for i, f in enumerate(MATCH_FIELDS)}
        cols[f"{c}_genes"] = F.split(at(f"all_{c}_hits:", 1), ",")
    rows = lines.select(*[c.alias(n) for n, c in cols.items()])
    return rows.withColumn("nuc", F.when(F.col("v_reversed") == 1, reverse_complement(F.col("nuc"))).otherwise(F.col("nuc")))


def germline_slices(genes: DataFrame, gap: str = ".") -> DataFrame:
    """``genes`` (gene, region, nuc, nuc_offset, aligned, cdr3_column, loop) with ``cdr3_at``, the 0-based base where a
    V's CDR3 starts or a J's ends, and ``cdr3_part``, the germline bases of the CDR3.

    A V's CDR3 starts at the codon of column ``cdr3_column`` (from 1) of its aligned protein; a J's loop ends
    before the GXG motif.
    """
    without_gaps = lambda c: F.length(F.replace(c, F.lit(gap), F.lit("")))
    v_at = 3 * without_gaps(F.substr("aligned", F.lit(1), F.col("cdr3_column") - 1)) + F.col("nuc_offset")
    j_at = 3 * without_gaps(F.col("loop")) + F.col("nuc_offset")
    rows = genes.withColumn("cdr3_at", F.when(F.col("region") == "V", v_at).otherwise(j_at).cast("int"))
    part = F.when(F.col("region") == "V", F.substr("nuc", F.col("cdr3_at") + 1)).otherwise(F.substr("nuc", F.lit(1), F.col("cdr3_at")))
    return rows.withColumn("cdr3_part", part)


def match_junctions(matches: DataFrame, germline: DataFrame) -> DataFrame:
    """``matches`` with ``cdr3_nuc``, ``cdr3``, ``v_reach`` (where the V match ends in V) and ``v_cdr3`` (where its CDR3
    starts): the read between both CDR3 ends, and germline where the read does not reach them.

    ``germline``: ``germline_slices``, a dimension. Rows of genes that it lacks are left out, and those whose
    CDR3 would end before it starts.
    """
    g = lambda c: bounded(germline.where(F.col("region") == c.upper()).select(F.col("gene").alias(f"{c}_gene"), F.col("nuc").alias(f"__{c}"), F.col("cdr3_at").alias(f"__{c}at")))
    rows = matches.join(g("v"), "v_gene").join(g("j"), "j_gene")
    begin, end = F.col("__vat") - F.col("v_offset"), F.col("__jat") - F.col("j_offset")
    rows = rows.withColumns({"__b": begin, "__e": end, "v_reach": F.col("v_stop") + F.col("v_offset"), "v_cdr3": F.col("__vat")}).where("__b < __e")
    missing = F.greatest(F.col("__e") - F.length("nuc"), F.lit(0))
    head = F.substr("__v", F.col("__vat") + 1, F.greatest(-F.col("__b"), F.lit(0)))
    tail = F.substr("__j", F.col("__jat") - missing + 1, missing)
    first = F.greatest(F.col("__b"), F.lit(0))
    body = F.substr("nuc", first + 1, F.greatest(F.least(F.length("nuc"), F.col("__e")) - first, F.lit(0)))
    rows = rows.withColumn("cdr3_nuc", F.concat(head, body, tail)).drop("__v", "__j", "__vat", "__jat", "__b", "__e")
    return rows.withColumn("cdr3", translate_frame(F.col("cdr3_nuc"), 1))


def distinct_scan(rows: DataFrame, by: str = "nuc") -> DataFrame:
    """One row of each distinct ``nuc`` (nucleotide CDR3), ``file`` (nucleotide CDR3 and file) or ``junction`` (protein,
    inserted and masked part); ``all`` keeps repeats."""
    keys = {"nuc": ["cdr3_nuc"], "file": ["cdr3_nuc", "file"], "junction": ["cdr3", "new_nuc", "masked"], "all": None}[by]
    return rows if keys is None else rows.dropDuplicates(keys)
