"""Equal receptors are counted before they meet, in as many rows as there are different ones."""

from pyspark.sql import functions as F

from repertoire.operators import diversity
from tests.test_reports import clones_of


def test_counts_are_those_of_pairs(spark):
    c = clones_of(spark, 120, epitopes="EF").withColumns({f"cdr3{k}": F.concat(F.lit("CAV"), (F.col("clone_id") % 5).cast("string")) for k in "ab"})
    for k in "ab":
        c = c.withColumns({f"v{k}_genes": F.array(F.concat(F.lit("V"), (F.col("clone_id") % 2).cast("string")), F.lit("V2")), f"j{k}_genes": F.array(F.concat(F.lit("J"), (F.col("clone_id") % 3).cast("string")))})
    for chains in ("A", "B", "AB"):
        want = sorted(map(tuple, diversity.match_counts(diversity.exact_matches(c, chains)).collect()))
        assert want and sorted(map(tuple, diversity.exact_match_counts(c, chains).collect())) == want


def test_many_equal_receptors_are_few_rows(spark):
    c = spark.range(200_000).selectExpr("id clone_id", "'E' epitope", "id % 2 subject", "'CAV' cdr3a", "array('V') va_genes", "array('J') ja_genes")
    assert diversity.exact_match_counts(c, "A").first().overlap == 10**10
