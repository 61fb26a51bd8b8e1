"""Junction probabilities as line files and as a tagged table (organism, chain, tag, key, p).

``PROB_A_v_trim`` lines list probabilities by length, ``PROB_B_D1_d01_trim`` and other lines of chain B name their
keys (``0,3:``), and ``AV_COUNTREP_FREQ:`` lines give a gene's per cent. The table is what generation and sampling take
their ``TrimTables`` from, and what trims of parsed receptors are looked up in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repertoire.operators.broadcasts import bounded, shipped
from repertoire.operators.graph import _ready
from repertoire.operators.junctions import TrimTables
from repertoire.sources.tables import read_gene_frequencies, read_probabilities

#: Tags of chain A, whose keys are lengths from 0 on; keys of chain B are named.
LISTED = ("v_trim", "j_trim", "vj_insert")
#: Tags that chain B has for each D gene and as a mean over them.
MEAN_TAGS = ("v_trim", "j_trim", "vd_insert", "dj_insert")


def probability_lines(table: DataFrame) -> DataFrame:
    """(place, value): the lines of one organism's probabilities, in order of chain, D gene and tag. A list is filled with 0
    up to its last length; a line's keys are in order of their numbers."""
    keyed = table.withColumn("k", F.transform(F.split("key", ","), lambda x: x.cast("int")))
    lists = keyed.where(F.col("chain") == "A").groupBy("chain", "tag").agg(F.map_from_entries(F.collect_list(F.struct(F.col("k")[0], F.col("p")))).alias("m"))
    value = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("m"))), lambda i: F.format_string("%.9f", F.coalesce(F.try_element_at("m", i), F.lit(0.0))))
    listed = lists.select("chain", "tag", F.array_join(value, "  ").alias("cells"))
    pair = F.format_string("%s:  %.9f", "key", "p")
    named = keyed.where(F.col("chain") == "B").groupBy("chain", "tag").agg(F.array_sort(F.collect_list(F.struct("k", pair.alias("cell")))).alias("x"))
    named = named.select("chain", "tag", F.array_join(F.transform("x", lambda x: x["cell"]), " ").alias("cells"))
    both = listed.unionByName(named)
    order = F.create_map(*[F.lit(x) for pair in {"d01_trim": 0, "v_trim": 1, "j_trim": 2, "vj_insert": 3, "vd_insert": 4, "dj_insert": 5}.items() for x in pair])
    base = F.regexp_extract("tag", r"(?:D\d+_)?(.*)", 1)
    place = F.format_string("%s %s %d %s", "chain", F.regexp_extract("tag", r"^(D\d+)_", 1), F.coalesce(F.try_element_at(order, base), F.lit(9)), "tag")
    return both.select(place.alias("place"), F.format_string("PROB_%s_%s  %s", "chain", "tag", "cells").alias("value"))


def frequency_lines(frequencies: DataFrame) -> DataFrame:
    """(place, value): ``<tag>_COUNTREP_FREQ`` lines of a table (tag, gene, p) and the total of each tag."""
    genes = frequencies.select(F.format_string("%s 0 %s", "tag", "gene").alias("place"), F.format_string("%s_COUNTREP_FREQ: %9.6f %s", F.col("tag"), 100 * F.col("p"), F.col("gene")).alias("value"))
    totals = frequencies.groupBy("tag").agg(F.sum("p").alias("p"))
    return genes.unionByName(totals.select(F.format_string("%s 1", "tag").alias("place"), F.format_string("%s_COUNTREP_TOTALFREQ: %9.6f", F.col("tag"), 100 * F.col("p")).alias("value")))


def write_probabilities(probabilities: DataFrame, frequencies: DataFrame, path: str) -> None:
    """One organism's probabilities and gene frequencies as a folder of lines, frequencies first."""
    lines = frequency_lines(frequencies).withColumn("kind", F.lit(0)).unionByName(probability_lines(probabilities).withColumn("kind", F.lit(1)))
    lines.repartitionByRange(1, "kind", "place").sortWithinPartitions("kind", "place").select("value").write.text(path)


def read_tagged(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(organism, chain, tag, key, p) and (organism, tag, gene, p) of the files of several organisms.

    Each tag's probabilities are divided by their sum; chain B has means over its D genes under tags without one.
    """
    probabilities = frequencies = None
    for organism, path in paths.items():
        p = read_probabilities(spark, path).select(F.lit(organism).alias("organism"), "chain", "tag", "key", "p")
        f = read_gene_frequencies(spark, path).select(F.lit(organism).alias("organism"), "tag", "gene", "p")
        probabilities = p if probabilities is None else probabilities.unionByName(p)
        frequencies = f if frequencies is None else frequencies.unionByName(f)
    return normalised(probabilities), frequencies


def normalised(table: DataFrame) -> DataFrame:
    """A tagged table whose tags sum to 1, with the means of chain B's tags over its D genes."""
    keys = ["organism", "chain", "tag"]
    # a dimension that every join below would make anew from its source
    _ready(table.sparkSession)
    table = table.checkpoint()
    sums = table.groupBy(*keys).agg(F.sum("p").alias("total"))
    p = table.join(bounded(sums), keys).select(*keys, "key", (F.col("p") / F.col("total")).alias("p"))
    of_d = p.where((F.col("chain") == "B") & F.col("tag").rlike(rf"^D\d+_({'|'.join(MEAN_TAGS)})$"))
    of_d = of_d.withColumn("base", F.regexp_extract("tag", r"^D\d+_(.*)$", 1))
    genes = of_d.groupBy("organism", "base").agg(F.count_distinct("tag").alias("d"))
    mean = of_d.join(bounded(genes), ["organism", "base"]).groupBy("organism", "chain", "base", "key", "d").agg(F.sum("p").alias("p"))
    return p.unionByName(mean.select("organism", "chain", F.col("base").alias("tag"), "key", (F.col("p") / F.col("d")).alias("p")))


def trim_tables(table: DataFrame, organism: str, chain: str, d_genes: dict[int, str] | None = None) -> TrimTables:
    """The lists that generation and sampling take, of one organism and chain; D genes are equally likely."""
    found: dict[str, dict[str, float]] = {}
    for r in shipped(table.where((F.col("organism") == organism) & (F.col("chain") == chain))):
        found.setdefault(r["tag"], {})[r["key"]] = r["p"]

    def listed(tag: str) -> list[float]:
        by = {int(k): p for k, p in found.get(tag, {}).items()}
        return [by.get(i, 0.0) for i in range(max(by, default=-1) + 1)]

    d = d_genes or {}
    trims = {i: {tuple(map(int, k.split(","))): p for k, p in found.get(f"D{i}_d01_trim", {}).items()} for i in d}
    return TrimTables(listed("v_trim"), listed("j_trim"), listed("vj_insert"), listed("vd_insert"), listed("dj_insert"), trims, d, {i: 1 / len(d) for i in d})


def trim_probability(rows: DataFrame, table: DataFrame, chain: str, out: str = "probability") -> DataFrame:
    """Adds the product of the probabilities of a receptor's trims and inserts: ``organism`` and, for chain A, v_trim, j_trim,
    vj_insert; for chain B d_id, v_trim, d0_trim, d1_trim, j_trim, vd_insert, dj_insert.

    A value that its table lacks has 0; an organism without any table of the chain has 1.
    """
    own = table.where(F.col("chain") == chain)
    wanted: dict[str, tuple[Column, Column]] = {t: (F.lit(t), F.col(t).cast("string")) for t in (LISTED if chain == "A" else MEAN_TAGS)}
    if chain == "B":
        wanted["d01_trim"] = (F.concat(F.lit("D"), F.col("d_id").cast("string"), F.lit("_d01_trim")), F.concat_ws(",", F.col("d0_trim").cast("string"), F.col("d1_trim").cast("string")))
    known = bounded(own.select(F.col("organism").alias("__o")).distinct())
    x = rows.join(known, F.col("organism") == F.col("__o"), "left")
    product = F.lit(1.0)
    for i, (tag, key) in enumerate(wanted.values()):
        values = own.select(F.col("organism").alias(f"__o{i}"), F.col("tag").alias(f"__t{i}"), F.col("key").alias(f"__k{i}"), F.col("p").alias(f"__p{i}"))
        x = x.join(bounded(values), (F.col("organism") == F.col(f"__o{i}")) & (tag == F.col(f"__t{i}")) & (key == F.col(f"__k{i}")), "left")
        product = product * F.coalesce(f"__p{i}", F.lit(0.0))
    return x.withColumn(out, F.when(F.col("__o").isNull(), 1.0).otherwise(product)).select(*rows.columns, out)
