"""Connected components of an edge table."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _ready(spark: SparkSession) -> None:
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="repertoire-"))


def components(edges: DataFrame, nodes: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for every row of ``nodes`` (node).

    Each round takes the smallest label among the neighbours and then the label of that label, so paths
    halve; labels are checkpointed in the shared folder every round.
    """
    _ready(edges.sparkSession)
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct().checkpoint()
    labels = nodes.select("node", F.col("node").alias("component")).distinct().checkpoint()
    for _ in range(most_rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("m"))
        least = labels.join(near, labels.node == near.a, "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("old"))
        of = least.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        new = least.join(of, "component").select("node", F.least("component", "jump").alias("component"), "old").checkpoint()
        changed = new.where("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"no fixed point within {most_rounds} rounds")
