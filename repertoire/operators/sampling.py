"""Seeded samples that do not depend on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample_per_key(df: DataFrame, keys: list[str], id_col: str, n: int, seed: int = 1) -> DataFrame:
    """At most ``n`` rows of each key without replacement, in the order of a seeded digest of their ids."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(digest, id_col))
    return df.withColumn("__r", place).where(F.col("__r") <= n).drop("__r")
