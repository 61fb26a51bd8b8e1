"""Work that is done once for equal rows, or by counts instead of pairs."""

from repertoire.operators import reads


def test_equal_reads_are_assigned_once(spark):
    genes = spark.createDataFrame([("V1", "V", "acgtacgttagcatcgatcgcta"), ("V2", "V", "acgtacgttagcatcgatcgaaa")], "gene string, region string, nucseq string")
    rows = spark.createDataFrame([(i, "ttACGTACGTTAGCATCGATCGCTA") for i in range(500)] + [(500, None)], "read_id int, nuc string")
    got = reads.assign_genes(rows, genes)
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = next(i for i, line in enumerate(plan) if "Generate explode(array(" in line)
    assert any("Aggregate [" in line for line in plan[made:])
    assert {(r.gene, r.shift, r.strand, r.score, r.gap) for r in got.collect()} == {("V1", 2, 1, 23, 3)}
    assert got.count() == 500
