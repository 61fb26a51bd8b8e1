"""Sequencing reads to genes and CDR3 loops: k-mer seeded, ungapped assignment (no external aligner)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repertoire.functions.sequences import letters, reverse_complement, translate_frame

K = 11
#: Genes whose score is within so many matches of the best are reported.
SCORE_MARGIN = 25


def _kmers(seq: Column, k: int) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.length(seq) - k + 1, F.lit(1)))
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.substr(seq, i, F.lit(k)).alias("mer")))


def assign_genes(reads: DataFrame, genes: DataFrame, *, nuc: str = "nuc", k: int = K) -> DataFrame:
    """(read_id, region, strand, shift, gene, score, gap, genes): the best germline gene of each region.

    Reads (both strands) and genes meet on shared k-mers; hits on one diagonal are counted, which is an
    ungapped alignment. Equal reads are assigned once. ``gap`` is the lead over the next gene, ``genes`` those within the margin.
    ``genes``: (gene, region, nucseq), a dimension table that Spark broadcasts when small.
    """
    texts = reads.select(F.lower(nuc).alias("__s"))
    once = texts.where(F.col("__s").isNotNull()).distinct()
    both = once.select("__s", F.explode(F.array(F.struct(F.lit(1).alias("strand"), F.col("__s").alias("s")), F.struct(F.lit(-1).alias("strand"), reverse_complement(F.col("__s")).alias("s")))).alias("x"))
    mers = both.select("__s", "x.strand", F.explode(_kmers(F.col("x.s"), k)).alias("m")).select("__s", "strand", F.col("m.at").alias("q"), F.col("m.mer").alias("mer"))
    index = genes.select("gene", "region", F.explode(_kmers(F.lower("nucseq"), k)).alias("m")).select("gene", "region", F.col("m.at").alias("h"), F.col("m.mer").alias("mer"))
    hits = mers.join(index, "mer").where(F.length("mer") == k).groupBy("__s", "region", "gene", "strand", (F.col("q") - F.col("h")).alias("shift")).agg(F.count(F.lit(1)).alias("n"))
    by_gene = hits.groupBy("__s", "region", "gene").agg(F.max(F.struct("n", "strand", "shift")).alias("b"))
    rows = by_gene.select("__s", "region", "gene", (F.col("b.n") + k - 1).alias("score"), "b.strand", "b.shift")
    w = Window.partitionBy("__s", "region")
    order = w.orderBy(F.desc("score"), "gene")
    ranked = rows.withColumns({"r": F.row_number().over(order), "next": F.lead("score").over(order), "top": F.max("score").over(w)})
    near = F.array_sort(F.collect_list(F.when(F.col("score") >= F.col("top") - SCORE_MARGIN, F.col("gene"))))
    best = lambda c: F.max(F.when(F.col("r") == 1, F.col(c)))
    found = ranked.groupBy("__s", "region").agg(
        best("strand").alias("strand"), best("shift").alias("shift"), best("gene").alias("gene"), best("score").alias("score"),
        (best("score") - F.coalesce(best("next"), F.lit(0))).alias("gap"), near.alias("genes"),
    )
    return reads.select("read_id", F.lower(nuc).alias("__s")).join(found, "__s").drop("__s")


def reading_frame(nuc: Column, start: Column) -> Column:
    """Frame (1..3) in which the base at 1-based ``start`` begins a codon."""
    return F.pmod(start - 1, F.lit(3)).cast("int") + 1


def voted_frames(rows: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """(keys, frame): the most frequent frame of a key, of equally frequent ones the larger."""
    n = rows.groupBy(*keys, frame).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.max(F.struct("n", frame))[frame].alias(frame))


def germline_bases(rows: DataFrame, keys: list[str], nuc: str) -> DataFrame:
    """(keys, pos, base, share): the most frequent base of each 1-based position and its share."""
    seen = rows.select(*keys, F.posexplode(letters(F.col(nuc))).alias("pos", "base")).groupBy(*keys, "pos", "base").agg(F.count(F.lit(1)).alias("n"))
    top = seen.groupBy(*keys, "pos").agg(F.max(F.struct("n", "base")).alias("t"), F.sum("n").alias("total"))
    return top.select(*keys, (F.col("pos") + 1).alias("pos"), F.col("t.base").alias("base"), (F.col("t.n") / F.col("total")).alias("share"))


def distinct_junctions(rows: DataFrame, *, id_col: str = "id", nuc: str = "nuc", v_genes: str = "v_genes", j_genes: str = "j_genes") -> DataFrame:
    """``rows`` without those whose nucleotides an earlier kept row has with a V and a J gene in common.

    Earlier means a smaller id. Rows of equal nucleotides and gene sets share their first row's fate but
    for that row itself, so only first rows, of which there are as many as gene sets, meet in a task.
    """
    sets = rows.select(id_col, nuc, F.array_sort(v_genes).alias("__v"), F.array_sort(j_genes).alias("__j"))
    first = sets.groupBy(nuc, "__v", "__j").agg(F.min(id_col).alias(id_col))

    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        seen: set[tuple[str, str]] = set()
        kept = []
        for i, vs, js in pieces.sort_values(id_col)[[id_col, "__v", "__j"]].itertuples(index=False):
            both = {(v, j) for v in vs for j in js}
            if not both & seen:
                seen |= both
                kept.append(i)
        return pd.DataFrame({id_col: kept})

    kept = first.groupBy(nuc).applyInPandas(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}")
    return rows.join(kept, id_col, "left_semi")


def find_cdr3(reads: DataFrame, *, nuc: str = "nuc", least: int = 6, most: int = 30) -> DataFrame:
    """(read_id, frame, cdr3, cdr3_nuc, status): the loop from the last conserved C to the residue
    before the first F/W-G-x-G after it, in the first forward frame that has one."""
    pattern = r"(C[^*C]{%d,%d}?)[FW]G.G" % (least - 1, most - 1)
    frames = [F.struct(F.lit(f).alias("frame"), translate_frame(F.col(nuc), f).alias("p")) for f in (1, 2, 3)]
    rows = reads.select("read_id", F.col(nuc).alias("n"), F.explode(F.array(*frames)).alias("x")).select("read_id", "n", "x.frame", "x.p")
    rows = rows.withColumn("cdr3", F.regexp_extract("p", pattern, 1))
    first = rows.groupBy("read_id").agg(F.min_by(F.struct("frame", "p", "cdr3", "n"), F.when(F.col("cdr3") == "", F.lit(9)).otherwise(F.col("frame"))).alias("b"))
    at = F.expr("(instr(b.p, b.cdr3) - 1) * 3 + b.frame")
    status = F.when(F.col("b.cdr3") == "", "no_cdr3").otherwise("OK")
    return first.select(
        "read_id", F.col("b.frame").alias("frame"), F.when(status == "OK", F.col("b.cdr3")).alias("cdr3"),
        F.when(status == "OK", F.substr(F.col("b.n"), at, F.length("b.cdr3") * 3)).alias("cdr3_nuc"), status.alias("status"),
    )


def part_qualities(read: Column, quals: Column, part: Column) -> Column:
    """Qualities (array) of the first place of a sequence part in its read, on either strand; null if absent."""
    forward = F.instr(read, part)
    back = F.instr(read, reverse_complement(part))
    n = F.length(part)
    return F.when(forward > 0, F.slice(quals, forward, n)).when(back > 0, F.reverse(F.slice(quals, back, n)))


def junction_qualities(read: Column, quals: Column, part: Column, missing: int = 60) -> Column:
    """Qualities (array) of a junction by its read: of its place, on the reverse strand if it is not on the read's own; of
    several places, of the one whose least quality is best (the first of equal ones).

    A junction that is on neither strand takes those of its largest part that is on one (the read's own strand and the first
    of equal ones), with ``missing`` for the rest, which came from a gene. Letters of either case are the same; null
    for an empty junction or a null.
    """
    # bound once, so that no step below turns a read again
    own = F.lower(read)
    bound = F.struct(own.alias("own"), reverse_complement(own).alias("back"), quals.alias("quals"), F.reverse(quals).alias("turned"), F.lower(part).alias("part"), F.length(part).alias("n"))
    found = F.get(F.transform(F.array(bound), lambda x: _by_read(x, missing)), F.lit(0))
    return F.when((F.length(part) > 0) & read.isNotNull() & quals.isNotNull(), found)


def _by_read(x: Column, missing: int) -> Column:
    part, n = x["part"], x["n"]
    rest = lambda k: F.array_repeat(F.lit(missing), k.cast("int"))

    def whole(nuc: Column, q: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(nuc), F.lit(1))), lambda i: F.substr(nuc, i, n) == part)
        best = F.array_max(F.transform(at, lambda i: F.struct(F.array_min(F.slice(q, i, n)).alias("least"), (-i).alias("i"))))
        return F.slice(q, -best["i"], n)

    def largest(nuc: Column) -> Column:
        # what starts one place on holds all but the first letter of what starts here, so ends only move on: 2 n steps
        def step(s: Column, _: Column) -> Column:
            i, size = s["i"], s["size"]
            more = (i + size <= n) & (F.instr(nuc, F.substr(part, i, size + 1)) > 0)
            best = more & (size >= s["best"])
            return F.struct(
                F.when(more, i).otherwise(i + 1).alias("i"), F.when(more, size + 1).otherwise(F.greatest(size - 1, F.lit(0))).alias("size"),
                F.when(best, size + 1).otherwise(s["best"]).alias("best"), F.when(best, i).otherwise(s["at"]).alias("at"),
            )

        start = F.struct(*[F.lit(v).alias(k) for k, v in (("i", 1), ("size", 0), ("best", 0), ("at", 1))])
        return F.aggregate(F.sequence(F.lit(1), n * 2), start, step, lambda s: F.struct(s["best"].alias("size"), s["at"].alias("i")))

    def filled(nuc: Column, q: Column, best: Column) -> Column:
        i, size = best["i"], best["size"]
        inner = F.slice(q, F.instr(nuc, F.substr(part, i, size)), size)
        return F.when(size == 0, rest(n)).otherwise(F.concat(rest(i - 1), inner, rest(n - i - size + 1)))

    both = F.array(F.struct(largest(x["own"]).alias("own"), largest(x["back"]).alias("back")))
    partial = F.get(F.transform(both, lambda b: F.when(b["back"]["size"] > b["own"]["size"], filled(x["back"], x["turned"], b["back"])).otherwise(filled(x["own"], x["quals"], b["own"]))), F.lit(0))
    return F.when(F.contains(x["own"], part), whole(x["own"], x["quals"])).when(F.contains(x["back"], part), whole(x["back"], x["turned"])).otherwise(partial)


def parsed_pairs(alpha: DataFrame, beta: DataFrame) -> DataFrame:
    """One row for each read with both chains' fields prefixed a_ and b_; either may be missing."""
    named = lambda df, p: df.select("read_id", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "read_id"])
    return named(alpha, "a").join(named(beta, "b"), "read_id", "full")
