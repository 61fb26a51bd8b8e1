"""Row filters of the analyses, with their defaults, as column expressions and DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repertoire.operators.ranks import global_row_number

#: Lengths that a CDR3 may have.
CDR3_LENGTHS = (6, 30)
#: Genes that no analysis takes: unknown ones, and alpha genes of the wrong frame.
BAD_ALPHA = ("UNK", "TRa")
EMPTY = ("", "-")
#: Motif reports show motifs from this chi-squared on, the best of a repertoire from the lower one.
MOTIF_CHI, TOP_MOTIF_CHI, MOTIF_OVERLAP, MOTIF_FRACTION = 200.0, 75.0, 50.0, 0.05
#: Scores, and lengths, that background chains and matches must have.
V_SCORE, J_SCORE, BACKGROUND_LENGTH, MATCH_LENGTH = 10, 8, 25, 5


def ok_rows(df: DataFrame, column: str = "status") -> DataFrame:
    """Rows whose status is ``OK``; all rows where there is no such column."""
    return df.where(F.col(column) == "OK") if column in df.columns else df


def known_alpha(df: DataFrame, *genes: str) -> DataFrame:
    """Rows whose alpha genes are known and in frame."""
    for g in genes:
        for bad in BAD_ALPHA:
            df = df.where(~F.contains(F.col(g), F.lit(bad)))
    return df


def cdr3_errors(seq: str, name: str, lengths: tuple[int, int] = CDR3_LENGTHS, *, allow_stop: bool = False, allow_x: bool = False) -> list[Column]:
    """Error texts (null where there is none) of a protein CDR3: its length, a stop, an unknown and a foreign letter."""
    c = F.col(seq)
    out = [F.when(c.isNull() | ~F.length(c).between(*lengths), f"{name}_length")]
    if not allow_stop:
        out.append(F.when(F.contains(c, F.lit("*")), f"{name}_stop"))
    if not allow_x:
        out.append(F.when(F.contains(c, F.lit("X")), f"{name}_unknown"))
    return [*out, F.when(c.rlike("[^ACDEFGHIKLMNPQRSTVWYX*]"), f"{name}_letter")]


def with_status(df: DataFrame, errors: list[Column], column: str = "status") -> DataFrame:
    """Adds the error texts of a row joined by ``;``, or ``OK``; errors of an earlier status come first."""
    found = F.array_compact(F.array(*errors))
    if column in df.columns:
        found = F.concat(F.when(F.col(column) == "OK", F.array().cast("array<string>")).otherwise(F.split(column, ";")), found)
    return df.withColumn(column, F.when(F.size(found) == 0, "OK").otherwise(F.array_join(found, ";")))


def passing_receptors(df: DataFrame, *, chains: str = "AB", lengths: tuple[int, int] = CDR3_LENGTHS, allow_stop: bool = False, allow_x: bool = False) -> DataFrame:
    """Rows of status ``OK``, known alpha genes and CDR3s without an error: what enters the analyses."""
    df = known_alpha(ok_rows(df), *[g for g in ("va", "ja") if g in df.columns])
    errors = [e for c in chains.lower() for e in cdr3_errors(f"cdr3{c}", c, lengths, allow_stop=allow_stop, allow_x=allow_x)]
    return df.where(F.size(F.array_compact(F.array(*errors))) == 0)


def complete_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without a null, empty or ``-`` cell in the columns named."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.col(c).cast("string").isin(*EMPTY))
    return df


def background_rows(df: DataFrame, chain: str, *, v_score: int = V_SCORE, j_score: int = J_SCORE, longest: int = BACKGROUND_LENGTH) -> DataFrame:
    """Background chains: the right chain, scores, a CDR3 that starts with C and is not too long."""
    return df.where((F.col("chain") == chain) & (F.col("v_score") >= v_score) & (F.col("j_score") >= j_score) & F.col("cdr3").startswith("C") & (F.length("cdr3") <= longest))


def first_junctions(df: DataFrame, order: str, v_genes: str = "v_genes", j_genes: str = "j_genes", nuc: str = "cdr3_nuc") -> DataFrame:
    """Rows whose (V gene, J gene, nucleotide CDR3) no earlier row has, for any of their ambiguous genes."""
    each = df.select(order, F.explode(v_genes).alias("__v"), j_genes, nuc).select(order, "__v", F.explode(j_genes).alias("__j"), F.col(nuc).alias("__s"))
    first = each.groupBy("__v", "__j", "__s").agg(F.min(order).alias("__first"))
    late = each.join(first, ["__v", "__j", "__s"]).where(F.col(order) > F.col("__first")).select(order).distinct()
    return df.join(late, order, "left_anti")


def match_errors(*, v_score: int = V_SCORE, j_score: int = J_SCORE, shortest: int = MATCH_LENGTH) -> list[Column]:
    """Error texts of a V and J match (columns v_score, j_score, v_reversed, j_reversed, v_stop, j_start,
    v_reach, v_cdr3, cdr3_nuc, cdr3): scores, orientation, order, reach of V into the CDR3, frame, length, stops."""
    return [
        F.when((F.col("v_score") < v_score) | (F.col("j_score") < j_score), "score"),
        F.when(F.col("v_reversed") != F.col("j_reversed"), "orientation"),
        F.when(F.col("v_stop") >= F.col("j_start"), "order"),
        F.when(F.col("v_reach") < F.col("v_cdr3"), "short_v"),
        F.when(F.length("cdr3_nuc") % 3 != 0, "frame"),
        F.when(F.floor(F.length("cdr3_nuc") / 3) < shortest, "short_cdr3"),
        F.when(F.col("cdr3").rlike("[*X]"), "stop"),
    ]


def select_groups(df: DataFrame, column: str = "epitope", *, only: list[str] | None = None, skip: list[str] | None = None, control: str | None = None) -> DataFrame:
    """Rows of the groups named, without those skipped and those whose name matches the control pattern."""
    if only:
        df = df.where(F.col(column).isin(*only))
    if skip:
        df = df.where(~F.col(column).isin(*skip))
    return df.where(~F.col(column).rlike(control)) if control else df


def shown_motifs(motifs: DataFrame, keys: list[str], *, chi: float = MOTIF_CHI, top_chi: float = TOP_MOTIF_CHI, fraction: float = MOTIF_FRACTION, overlap: float = MOTIF_OVERLAP) -> DataFrame:
    """Motifs of a report: above ``chi``, or the best of its key above ``top_chi``, whose ``overlap`` with motifs before it, where
    there is such a column, is no more than ``overlap``; ``clusters`` tells whether the expected fraction is low enough
    to take part in clustering."""
    best = motifs.groupBy(*keys).agg(F.max(F.struct("chi_squared", "shown")).alias("__b"))
    rows = motifs.join(best, keys)
    rows = rows.where((F.col("chi_squared") >= chi) | ((F.col("chi_squared") >= top_chi) & (F.col("shown") == F.col("__b.shown")))).drop("__b")
    if "overlap" in rows.columns:
        rows = rows.where(F.col("overlap") <= overlap)
    return rows.withColumn("clusters", F.col("expected_fraction") <= fraction) if "expected_fraction" in rows.columns else rows


def every_nth(df: DataFrame, order: list[str], n: int = 1, most: int | None = None) -> DataFrame:
    """Each n-th row by ``order``, and the first ``most`` of them: the subsample and the cap of a scan that a caller
    asks for. ``line`` is the row's number in the order."""
    rows = global_row_number(df, order, "line")
    rows = rows.where(F.col("line") % n == 0)
    return rows.where(F.col("line") <= most * n) if most is not None else rows


def surrogate_ids(df: DataFrame, order: list[str], *, base: str = "tcr", first: int = 0, suffix: str = "", out: str = "id") -> DataFrame:
    """Adds ids ``<base><N><suffix>`` by place in the order, N from ``first``."""
    rows = global_row_number(df, order, "__line")
    return rows.withColumn(out, F.concat(F.lit(base), (F.col("__line") - 1 + first).cast("string"), F.lit(suffix))).drop("__line")


def fake_chain(df: DataFrame, chain: str, values: dict[str, str], quality: int = 60) -> DataFrame:
    """``df`` with a constant chain: its genes and sequences from ``values``, its qualities constant and as long as
    the nucleotide sequence."""
    c = chain.lower()
    df = df.withColumns({k: F.lit(v) for k, v in values.items()})
    quals = F.array_join(F.array_repeat(F.lit(str(quality)), F.length(f"nuc_{c}")), ".")
    return df.withColumn(f"quals_{c}", quals)
