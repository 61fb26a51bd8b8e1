"""Rows of a task that do not grow with the table."""

from pyspark.sql import functions as F

from repertoire.operators import background, motifs


def test_draws_are_dealt_to_more_tasks_where_there_are_more(spark, monkeypatch):
    monkeypatch.setattr(background, "TASK_ROWS", 100)
    chains = spark.range(600).selectExpr("id chain_id", "array('V', 'W') v_reps", "array('J') j_reps", "concat('C', id) cdr3")
    index = background.postings(chains)
    assert index.agg(F.count(F.lit(1))).first()[0] == 1200
    receptors = spark.range(200).selectExpr("id clone_id", "'V' v_rep", "'J' j_rep")
    drawn = background.sampled(receptors, index, 8).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in drawn) == 1600 and len(drawn) > 10 and max(r["count"] for r in drawn) < 300


def test_support_of_sequences_that_are_not_counted_first(spark):
    m = spark.createDataFrame([("A", "A"), ("B.", "B[A-Z]"), ("Z", "Z")], "shown string, pattern string")
    c = spark.createDataFrame([("e", "AB"), ("e", "AB"), ("e", "BA"), ("f", "CC"), ("f", "A"), ("f", None)], "epitope string, s string")
    assert {tuple(r) for r in motifs.support(m, c, ["epitope"], "s", counted=False).collect()} == {tuple(r) for r in motifs.support(m, c, ["epitope"], "s").collect()}
