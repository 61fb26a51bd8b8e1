"""Background chains by V and J gene: an inverted index, and a sample of it for each receptor.

A chain with ambiguous genes stands under each of its pairs of V and J. Under a pair the chains are in the order of a
seeded digest, which places are counted in two levels, so a list of any length is never in one task. A receptor takes
the chains from a place that its own digest names, round the end of the list: those that come first by digest,
seen from there. Receptors and chains meet on (pair, place), as many rows as are sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repertoire.operators.broadcasts import bounded
from repertoire.operators.graph import _ready

#: Chains of a pair that are ordered together, on average.
BUCKET = 1000
#: Rows that a task sorts, on average.
TASK_ROWS = 200_000
PAIR = ["v_rep", "j_rep"]


def tasks(rows: int) -> int:
    """Partitions for ``rows`` rows: their number grows with a table, what one of them holds does not."""
    return max(1, -(-rows // TASK_ROWS))


def _digest(seed: int, c: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(c).cast("string")).cast("binary"))


def _hex(digits: int, digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def postings(chains: DataFrame, *, id_col: str = "chain_id", v: str = "v_reps", j: str = "j_reps", seed: int = 1) -> DataFrame:
    """(v_rep, j_rep, n, place, id, other columns): every chain under each pair of its genes, ``n`` the length of the list and
    ``place`` (from 0) in its seeded order. Chains that repeat an id under a pair stand there once."""
    _ready(chains.sparkSession)
    each = chains.withColumn("v_rep", F.explode(F.array_distinct(v))).withColumn("j_rep", F.explode(F.array_distinct(j))).drop(v, j)
    parts = tasks(each.count())
    each = each.repartition(parts, *PAIR, id_col).dropDuplicates([*PAIR, id_col]).withColumn("__d", _digest(seed, id_col)).checkpoint()
    sizes = bounded(each.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n")))
    # four hex digits split a list into up to 65,536 buckets in order of the digest
    bucket = F.floor(_hex(4, F.col("__d")) / F.lit(65536.0) * F.ceil(F.col("n") / BUCKET)).cast("int")
    ranged = each.join(sizes, PAIR).withColumn("__b", bucket)
    counts = ranged.groupBy(*PAIR, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*PAIR).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*PAIR, "__b", before.alias("__o"))
    inside = F.row_number().over(Window.partitionBy(*PAIR, "__b").orderBy("__d", id_col))
    placed = ranged.repartition(parts, *PAIR, "__b").withColumn("__r", inside).join(bounded(starts), [*PAIR, "__b"])
    return placed.withColumn("place", (F.col("__o") + F.col("__r") - 1).cast("long")).drop("__d", "__b", "__o", "__r")


def sampled(receptors: DataFrame, index: DataFrame, n: int, *, id_col: str = "clone_id", seed: int = 1) -> DataFrame:
    """``receptors`` (id, v_rep, j_rep, ...) with the chains of ``index`` (``postings``) drawn for each: min(n, length of the
    list of its genes) different ones; receptors whose genes no chain has give no row."""
    lists = bounded(index.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("__n")))
    start = F.pmod(_hex(8, _digest(seed, id_col)), F.col("__n"))
    asked = receptors.join(lists, PAIR).withColumn("__s", start).withColumn("__i", F.explode(F.sequence(F.lit(0), F.least(F.lit(n), F.col("__n")).cast("int") - 1)))
    asked = asked.withColumn("place", F.pmod(F.col("__s") + F.col("__i"), F.col("__n"))).drop("__s", "__i", "__n")
    # a list has as many places as chains, a receptor asks for n of them at most
    parts = tasks(max(receptors.count() * n, index.count()))
    on = [*PAIR, "place"]
    return asked.repartition(parts, *on).join(index.drop("n").repartition(parts, *on), on).drop("place")
