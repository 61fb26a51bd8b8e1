"""Paired-sequence tables, a catalog of them by name, and the verbs of an analysis for ``DataFrame.transform``."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repertoire.config import Parameters
from repertoire.functions import sequences as seq
from repertoire.operators import clones as calls
from repertoire.operators import filters, usage
from repertoire.sources import probabilities
from repertoire.sources.tables import read_tsv


def chains_of(df: DataFrame) -> list[str]:
    """Chains of a table by its ``<chain>_nucseq`` columns, any number of them."""
    return [c.removesuffix("_nucseq") for c in df.columns if c.endswith("_nucseq")]


def parsed_chain(df: DataFrame, chain: str) -> DataFrame:
    """Adds to a chain its reverse complement, translations in three frames, shortest quality and, where hits are given
    (``<chain>_v_hits``, ``<chain>_j_hits``), its genes of the best score."""
    nuc = F.lower(f"{chain}_nucseq")
    out = {f"{chain}_revcomp": seq.reverse_complement(nuc), **{f"{chain}_frame{k}": seq.translate_frame(nuc, k) for k in (1, 2, 3)}}
    if f"{chain}_quals" in df.columns:
        out[f"{chain}_least_quality"] = seq.least_quality(F.col(f"{chain}_quals"))
    for g in "vj":
        if f"{chain}_{g}_hits" in df.columns:
            out[f"{g}{chain}_genes"] = seq.top_hits(F.col(f"{chain}_{g}_hits"))
    return df.withColumns(out)


def read_paired(spark: SparkSession, path: str, organism: str) -> DataFrame:
    """A TSV of paired chains with every chain parsed and the organism as a column; rows may be unpaired or hold more
    than two chains."""
    df = read_tsv(spark, path)
    for c in chains_of(df):
        df = parsed_chain(df, c)
    return df.withColumn("organism", F.lit(organism))


#: Data sets by name: (file below the catalog's folder, organism).
CATALOG: dict[str, tuple[str, str]] = {}


def register(name: str, file: str, organism: str) -> None:
    CATALOG[name] = (file, organism)


def load(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """A data set of the catalog; an unknown name lists those that there are."""
    if name not in CATALOG:
        raise KeyError(f"no data set {name!r}; there are {', '.join(sorted(CATALOG)) or 'none'}")
    file, organism = CATALOG[name]
    return read_paired(spark, os.path.join(folder, file), organism)


def compute_filters(p: Parameters = Parameters()) -> Callable[[DataFrame], DataFrame]:
    """Verb: rows that enter an analysis."""
    return lambda df: filters.passing_receptors(df, lengths=p.cdr3_lengths)


def identify_clones(p: Parameters = Parameters()) -> Callable[[DataFrame], DataFrame]:
    """Verb: reads to clones."""
    return lambda df: calls.call_clones(df, p.min_quality_for_singletons)


def compute_probs(table: DataFrame, chain: str, genes: dict[str, DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Verb: ``cdr3<c>_prob`` of a chain's trims and inserts in a tagged table, ``v<c>_rep_prob`` and ``j<c>_rep_prob`` as the largest
    background probability of a receptor's genes (``genes``: 'V' and 'J' -> (gene, pseudoprob)), and ``<c>_prob``, their product."""
    c = chain.lower()

    def run(df: DataFrame) -> DataFrame:
        x = probabilities.trim_probability(df, table, chain.upper(), f"cdr3{c}_prob")
        for g in "vj":
            x = usage.best_gene_probability(x, f"{g}{c}_genes", genes[g.upper()], f"{g}{c}_rep_prob")
        return x.withColumn(f"{c}_prob", F.col(f"cdr3{c}_prob") * F.col(f"v{c}_rep_prob") * F.col(f"j{c}_rep_prob"))

    return run


def averaged_scores(clone: str, score: str, p: Parameters = Parameters()) -> Callable[[DataFrame], DataFrame]:
    """Verb: a user's score column averaged over the members of a clone."""
    return lambda df: calls.average_scores(df, clone, score, p.none_score)


def with_extra(df: DataFrame, fields: list[str]) -> list:
    """Columns of ``df`` to pass through, those named that it has."""
    return [F.col(f"`{f}`") for f in fields if f in df.columns]
