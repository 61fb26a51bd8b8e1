"""Tables that many joins read are made once."""

from pyspark.sql import functions as F

from repertoire.sources import probabilities


def test_a_tagged_table_is_read_from_its_source_once(spark):
    x = spark.range(6).select(F.lit("o").alias("organism"), F.lit("A").alias("chain"), F.lit("v_trim").alias("tag"), (F.col("id") % 3).cast("string").alias("key"), F.lit(1.0).alias("p"))
    x = x.groupBy("organism", "chain", "tag", "key").agg(F.sum("p").alias("p"))
    t = probabilities.normalised(x)
    rows = spark.createDataFrame([("o", 1, 2, 5), ("q", 1, 2, 0)], "organism string, v_trim int, j_trim int, vj_insert int")
    got = probabilities.trim_probability(rows, t, "A", "p")
    assert "Range (0" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.organism: r.p for r in got.collect()} == {"o": 0.0, "q": 1.0}
