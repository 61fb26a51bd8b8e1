"""Fixture tables as the queries take them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repertoire.operators.broadcasts import shipped
from repertoire.plans import fixtures


def clones(spark: SparkSession, d: str) -> DataFrame:
    c = fixtures.frame(spark, d, "clones")
    sets = {f"v{x}_genes": F.array_sort(F.array_distinct(F.array(f"v{x}1", f"v{x}2"))) for x in "ab"}
    other = {"a": F.concat(F.lit("JA"), ((F.col("clone_id") * 2 + 1) % 3).cast("string")), "b": F.concat(F.lit("JB"), ((F.col("clone_id") + 2) % 4).cast("string"))}
    return c.withColumns({**sets, **{f"j{x}_genes": F.array_sort(F.array_distinct(F.array(f"j{x}", other[x]))) for x in "ab"}})


def genes(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.frame(spark, d, "genes")


def reads(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.frame(spark, d, "reads").withColumns({"qual_a": F.col("qual"), "qual_b": F.col("qual")})


def tuples(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.frame(spark, d, "tuples").withColumn("genes", F.array_sort(F.array_distinct(F.array("g1", "g2"))))


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def for_each(df: DataFrame, groups: DataFrame, column: str) -> DataFrame:
    """The rows of a small table for every value of a dimension's ``column``."""
    names = sorted(row[column] for row in shipped(groups.select(column).where(F.col(column).isNotNull()).distinct()))
    return df.withColumn(column, F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>")))
