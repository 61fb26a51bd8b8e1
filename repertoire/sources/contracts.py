"""Column contracts of the tables that an analysis writes as TSV, and fields derived from others where a table lacks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repertoire.functions.sequences import top_hits
from repertoire.operators.broadcasts import bounded
from repertoire.sources.tables import read_tsv, write_tsv

# Column names of the written tables, in the order in which they are written.
PARSED_SEQS = (
    "id", "epitope", "subject",
    "va_gene", "va_rep", "va_mismatches", "va_alignlen", "va_evalue", "va_bitscore_gap",
    "ja_gene", "ja_rep", "ja_mismatches", "ja_alignlen", "ja_evalue", "ja_bitscore_gap",
    "vb_gene", "vb_rep", "vb_mismatches", "vb_alignlen", "vb_evalue", "vb_bitscore_gap",
    "jb_gene", "jb_rep", "jb_mismatches", "jb_alignlen", "jb_evalue", "jb_bitscore_gap",
    "cdr3a", "cdr3a_nucseq", "cdr3a_quals",
    "cdr3b", "cdr3b_nucseq", "cdr3b_quals",
    "va_genes", "va_reps", "va_countreps",
    "ja_genes", "ja_reps", "ja_countreps",
    "vb_genes", "vb_reps", "vb_countreps",
    "jb_genes", "jb_reps", "jb_countreps",
    "va_blast_hits", "ja_blast_hits",
    "vb_blast_hits", "jb_blast_hits",
    "status",
)
PROBABILITIES = (
    "a_protseq_prob", "cdr3a_protseq_prob", "va_rep_prob", "ja_rep_prob", "a_nucseq_prob",
    "b_protseq_prob", "cdr3b_protseq_prob", "vb_rep_prob", "jb_rep_prob", "b_nucseq_prob",
)
MASKED = ("cdr3a_protseq_masked", "a_indels", "cdr3a_new_nucseq", "cdr3b_protseq_masked", "b_indels", "cdr3b_new_nucseq")
CLONES = ("members", "clone_size")
MOTIFS = (
    "id", "epitope", "chain",
    "epitope_num", "chi_squared", "overlap",
    "num_matches", "num_matches_with_nbrs",
    "expected_fraction", "expected_num_matches",
    "showmotif", "matches", "matches_with_nbrs", "matches_with_nbrs_consensus",
    "cluster_number", "is_cluster_center", "cluster_consensus",
)


def contract(table: str, *, masked: bool = False, before: list[str] | None = None) -> list[str]:
    """Columns of ``parsed_seqs``, ``probs``, ``clones`` or ``motifs``. The second and third extend the columns of the table
    that they are made from (``before``; parsed_seqs if not given), and ``clones`` calls its id clone_id."""
    first = list(PARSED_SEQS if before is None else before)
    if table == "parsed_seqs":
        return first
    if table == "probs":
        return first + list(PROBABILITIES) + (list(MASKED) if masked else [])
    if table == "clones":
        return ["clone_id" if c == "id" else c for c in first] + list(CLONES)
    if table == "motifs":
        return list(MOTIFS)
    raise KeyError(f"no table {table!r}; there are parsed_seqs, probs, clones and motifs")


def as_contract(df: DataFrame, columns: list[str], *, extra: list[str] = (), optional: list[str] = ()) -> DataFrame:
    """``df`` with the columns of a contract in their order, then those of ``extra`` that it has. A missing column is an
    error that names it, but for those of ``optional``, which are null."""
    missing = [c for c in columns if c not in df.columns and c not in optional]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    own = [F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    return df.select(*own, *[F.col(f"`{c}`") for c in extra if c in df.columns and c not in columns])


def write_contract(df: DataFrame, path: str, columns: list[str], **options) -> None:
    """A TSV folder in the order of a contract; null and empty cells are '-', arrays are ';'-joined."""
    write_tsv(as_contract(df, columns, **options), path)


def read_contract(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The columns of a contract as text; a table that lacks one fails."""
    return read_tsv(spark, path, columns)


def _sorted_set(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(c, lambda x: (x != "") & (x != "-")))), ";")


def derived_genes(df: DataFrame, prefix: str, classes: DataFrame) -> DataFrame:
    """Fills ``<prefix>_genes``, ``_gene``, ``_rep``, ``_reps`` and ``_countreps`` where a row lacks them (null, '-' or no column).

    Genes come from the hits of the best score, else from the gene; the gene is the first of the genes; representatives come
    from ``classes`` (gene, rep, count_rep), once for each gene of the set. A name without an allele (no '*') or one that
    ``classes`` lacks stands for itself. Lists are sorted. Different sets of genes, not rows, meet ``classes``.
    """
    has = lambda f: F.nullif(F.nullif(f"{prefix}_{f}", F.lit("-")), F.lit("")) if f"{prefix}_{f}" in df.columns else F.lit(None).cast("string")
    hits = has("blast_hits")
    genes = F.coalesce(has("genes"), F.when(hits.isNotNull(), F.array_join(top_hits(hits), ";")), has("gene"))
    df = df.withColumn(f"{prefix}_genes", genes)
    df = df.withColumn(f"{prefix}_gene", F.coalesce(has("gene"), F.array_min(F.split(f"{prefix}_genes", ";"))))
    table = bounded(classes.select("gene", "rep", "count_rep").dropDuplicates(["gene"]))
    names = df.select(F.explode(F.split(f"{prefix}_genes", ";")).alias("gene")).unionAll(df.select(f"{prefix}_gene")).distinct()
    sets = df.select(f"{prefix}_genes", f"{prefix}_gene").distinct()
    named = names.where("gene is not null").join(table, "gene", "left")
    star = F.contains("gene", F.lit("*"))
    named = named.select("gene", *[F.when(star, F.coalesce(c, "gene")).otherwise(F.col("gene")).alias(c) for c in ("rep", "count_rep")])
    each = sets.select(f"{prefix}_genes", f"{prefix}_gene", F.explode(F.split(f"{prefix}_genes", ";")).alias("gene")).join(named, "gene")
    each = each.groupBy(f"{prefix}_genes", f"{prefix}_gene").agg(_sorted_set(F.collect_set("rep")).alias("__reps"), _sorted_set(F.collect_set("count_rep")).alias("__crs"))
    own = named.select(F.col("gene").alias(f"{prefix}_gene"), F.col("rep").alias("__rep"))
    out = df.join(each, [f"{prefix}_genes", f"{prefix}_gene"], "left").join(own, f"{prefix}_gene", "left")
    out = out.withColumns({f"{prefix}_rep": F.coalesce(has("rep"), "__rep"), f"{prefix}_reps": F.coalesce(has("reps"), "__reps"), f"{prefix}_countreps": F.coalesce(has("countreps"), "__crs")})
    return out.drop("__rep", "__reps", "__crs")


def derived_qualities(df: DataFrame, chain: str, quality: int = 60) -> DataFrame:
    """Fills ``cdr3<chain>_quals`` with one constant for each base where a row lacks it."""
    c = f"cdr3{chain}_quals"
    own = F.nullif(F.nullif(c, F.lit("-")), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    made = F.array_join(F.array_repeat(F.lit(str(quality)), F.length(f"cdr3{chain}_nucseq")), ".")
    return df.withColumn(c, F.coalesce(own, made))
