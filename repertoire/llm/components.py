"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repertoire.llm._shared import written


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    root = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionAll(root.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", *, most_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge to another.

    Nodes must be orderable; null ends and loops are ignored. A round is written to the shared folder,
    so a lost executor never costs more than one round.
    """
    now = edges.where(f"{a} is not null and {b} is not null and {a} <> {b}")
    now = written(now.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(seen) == mark or seen[0] == 0:
            break
        mark = tuple(seen)
        now = written(_round(now), "stars")
    else:
        raise RuntimeError(f"no fixed point within {most_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
