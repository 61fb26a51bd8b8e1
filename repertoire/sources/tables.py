"""Readers and writers of repertoire tables: TSV with '#' headers, CSV, logs, FASTA, gene tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repertoire.operators.broadcasts import bounded
from repertoire.operators.ranks import global_row_number

#: Dialects of third-party clonotype tables: our column -> their names.
DIALECTS = {
    "v_gene": ("v_gene", "V segments", "v"),
    "j_gene": ("j_gene", "J segments", "j"),
    "cdr3": ("cdr3", "CDR3 amino acid sequence", "cdr3aa"),
    "cdr3_nuc": ("cdr3_nuc", "CDR3 nucleotide sequence", "cdr3nt"),
    "clone_size": ("clone_size", "Count", "count"),
}


def read_tsv(spark: SparkSession, path: str, columns: list[str] | None = None, *, sep: str = "\t", schema=None, null: str = "-") -> DataFrame:
    """A header-line TSV; a leading '#' of the header is dropped, '-' is null, ragged rows fail."""
    reader = spark.read.option("sep", sep).option("header", True).option("nullValue", null).option("mode", "FAILFAST").option("quote", "")
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    df = df.withColumnsRenamed({c: c.lstrip("#").strip() for c in df.columns if c.startswith("#")})
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with quoted cells."""
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_tsv(df: DataFrame, path: str, *, sep: str = "\t", null: str = "-") -> None:
    """A TSV folder; arrays are ';'-joined, null and empty cells are written as '-'."""
    flat = [F.array_join(F.transform(f.name, lambda x: x.cast("string")), ";").alias(f.name) if f.dataType.typeName() == "array" else F.col(f"`{f.name}`") for f in df.schema]
    df.select(*flat).write.option("sep", sep).option("header", True).option("nullValue", null).option("emptyValue", null).option("quote", "").csv(path)


def union_common(frames: list[DataFrame]) -> DataFrame:
    """All rows of several tables on the columns that they share."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    return reduce(lambda a, b: a.unionAll(b), [f.select(*common) for f in frames])


def prefixed_groups(df: DataFrame, group: str, prefix: str) -> DataFrame:
    return df.withColumn(group, F.concat(F.lit(prefix), group))


def list_cell(c: str, sep: str = ";") -> Column:
    """A ';'-joined cell as a sorted array without repeats."""
    return F.array_sort(F.array_distinct(F.split(c, sep)))


def hits_cell(c: str) -> Column:
    """A ``gene:score;gene:score`` cell as a map."""
    return F.transform_values(F.str_to_map(c, F.lit(";"), F.lit(":")), lambda _, v: v.cast("int"))


def convert_clonotypes(df: DataFrame, genes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with reason) of any dialect, in our columns.

    Rejected: a missing field, a CDR3 of five residues or fewer or with other letters, unknown genes.
    """
    found = {ours: next((c for c in names if c in df.columns), None) for ours, names in DIALECTS.items()}
    rows = df.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(o) for o, c in found.items()])
    rows = rows.withColumn("clone_size", F.coalesce(F.expr("try_cast(clone_size as int)"), F.lit(1)))
    for g in ("v_gene", "j_gene"):
        rows = rows.withColumn(g, F.trim(F.element_at(F.split(g, ","), 1)))
    if genes is not None:
        known = bounded(genes.select(F.col("gene").alias("__g")).distinct())
        for g in ("v_gene", "j_gene"):
            rows = rows.join(known, rows[g] == F.col("__g"), "left").withColumn(f"__ok_{g}", F.col("__g").isNotNull()).drop("__g")
    unknown = ~(F.col("__ok_v_gene") & F.col("__ok_j_gene")) if genes is not None else F.lit(False)
    reason = (
        F.when(F.col("v_gene").isNull() | F.col("j_gene").isNull() | F.col("cdr3").isNull(), "missing_field")
        .when(F.length("cdr3") <= 5, "short_cdr3")
        .when(~F.col("cdr3").rlike("^[ACDEFGHIKLMNPQRSTVWY]+$"), "bad_residue")
        .when(unknown, "unknown_gene")
    )
    rows = rows.withColumn("reason", reason).drop("__ok_v_gene", "__ok_j_gene")
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def with_defaults(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Missing columns added and nulls filled with defaults (qualities 60, probability 1, size 1, ...)."""
    for c, v in values.items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v))
    return df


def read_tuple_counts(spark: SparkSession, path: str) -> DataFrame:
    """(n, genes, organism, file) of lines ``TUPLE_COUNT n genes organism file``."""
    parts = F.split("value", r"\s+")
    rows = spark.read.text(path).where(F.col("value").startswith("TUPLE_COUNT"))
    return rows.select(parts[1].cast("long").alias("n"), F.split(parts[2], ",").alias("genes"), parts[3].alias("organism"), parts[4].alias("file"))


def read_probabilities(spark: SparkSession, path: str) -> DataFrame:
    """(chain, tag, key, p) of lines ``PROB_{A,B}_tag p0 p1 ..``, where keys are positions, and ``PROB_{A,B}_tag k: p ..``."""
    line = r"^PROB_([AB])_(\S+?):?\s+(.*)$"
    part = lambda i: F.regexp_extract("value", line, i)
    rows = spark.read.text(path).where(F.col("value").startswith("PROB_")).select(part(1).alias("chain"), part(2).alias("tag"), F.trim(part(3)).alias("rest"))
    named = F.contains("rest", F.lit(":"))
    listed = rows.where(~named).select("chain", "tag", F.posexplode(F.split("rest", r"\s+")).alias("key", "p")).withColumn("key", F.col("key").cast("string"))
    pairs = F.explode(F.regexp_extract_all("rest", F.lit(r"(\S+?):\s*(\S+)"), F.lit(0))).alias("x")
    keyed = rows.where(named).select("chain", "tag", pairs).select("chain", "tag", F.trim(F.substring_index("x", ":", 1)).alias("key"), F.trim(F.substring_index("x", ":", -1)).alias("p"))
    return listed.unionByName(keyed).withColumn("p", F.expr("try_cast(p as double)")).where("p is not null")


def read_gene_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(tag, gene, p) of lines ``<tag>_COUNTREP_FREQ: <per cent> <gene>``."""
    line = r"^(\S+)_COUNTREP_FREQ:\s+(\S+)\s+(\S+)\s*$"
    part = lambda i: F.regexp_extract("value", line, i)
    rows = spark.read.text(path).where(F.col("value").rlike(line))
    return rows.select(part(1).alias("tag"), part(3).alias("gene"), (part(2).try_cast("double") / 100).alias("p"))


def read_fasta(spark: SparkSession, path: str, species: str | None = None) -> DataFrame:
    """(header, sequence) of FASTA records; ``species`` keeps headers that name it."""
    rows = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    cut = F.instr("value", "\n")
    rows = rows.select(F.trim(F.substring_index("value", "\n", 1)).alias("header"), F.regexp_replace(F.when(cut > 0, F.expr("substr(value, instr(value, '\n') + 1)")).otherwise(""), r"\s", "").alias("sequence"))
    return rows.where(F.contains("header", F.lit(species))) if species else rows


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """Gene table with ``cdrs`` and ``cdr_columns`` as arrays."""
    span = F.transform(F.split("cdr_columns", ";"), lambda x: F.struct(F.split(x, "-")[0].cast("int").alias("start"), F.split(x, "-")[1].cast("int").alias("stop")))
    return read_tsv(spark, path).withColumns({"cdr_columns": span, "cdrs": F.split("cdrs", ";")})


def background_chains(df: DataFrame, *, chain: str, most: int = 25, v_score: int = 10, j_score: int = 8) -> DataFrame:
    """Background filters: chain, scores, starts with C, length."""
    return df.where((F.col("chain") == chain) & (F.col("v_score") >= v_score) & (F.col("j_score") >= j_score) & F.col("cdr3").startswith("C") & (F.length("cdr3") <= most))


def paired_random(a: DataFrame, b: DataFrame, n: int | None = None, seed: int = 1, *, ids: tuple[str, str]) -> DataFrame:
    """Random pairs of two tables, (place, columns of a, columns of b): each stands in the order of a seeded digest of its
    id (``ids``: its name in a and in b) and places are joined, as many as the shorter table has, or the first ``n``.

    No two columns may share a name. Rows that repeat an id stand in an order that Spark gives.
    """
    out = []
    for k, (df, c) in enumerate(zip((a, b), ids, strict=True)):
        digest = F.md5(F.concat(F.lit(f"{seed + k}:"), F.col(c).cast("string")).cast("binary"))
        out.append(global_row_number(df.withColumn("__h", digest), ["__h", c], "place").drop("__h"))
    pairs = out[0].join(out[1], "place")
    return pairs if n is None else pairs.where(F.col("place") <= n)


def test_subset(df: DataFrame, groups: int = 3, subjects: int = 3, rows: int = 15) -> DataFrame:
    """The first groups, subjects of a group and rows of a subject, in order."""
    from pyspark.sql import Window

    first = df.select("epitope").distinct().orderBy("epitope").limit(groups)
    x = df.join(bounded(first), "epitope").withColumn("__s", F.dense_rank().over(Window.partitionBy("epitope").orderBy("subject")))
    x = x.where(F.col("__s") <= subjects).withColumn("__r", F.row_number().over(Window.partitionBy("epitope", "subject").orderBy("id")))
    return x.where(F.col("__r") <= rows).select(*df.columns)
