"""Row numbers over whole tables without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repertoire.operators.broadcasts import bounded


def global_row_number(df: DataFrame, order: list[str | Column], out: str, partitions: int | None = None) -> DataFrame:
    """Adds ``out``: 1, 2, ... in the order of ``order``, which must tell rows apart.

    Range partitions are numbered inside and shifted by the rows of those before, a table of one row for
    each partition. The ranged rows are checkpointed, so that both passes see the same partitions.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(n, *keys).withColumn("__p", F.spark_partition_id()).checkpoint()
    counts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__p", before.alias("__o"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*keys))
    return ranged.join(bounded(starts), "__p").withColumn(out, (F.col("__o") + inside).cast("long")).drop("__p", "__o")
