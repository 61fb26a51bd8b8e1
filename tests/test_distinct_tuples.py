"""Rows of one sequence count by the first of them in the table."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

from repertoire.plans import registry


def test_first_row_of_a_sequence_counts(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(4000), rng.randint(1, 7), rng.randrange(200), rng.randrange(200), rng.choice("OF"), "N") for _ in range(40_000)]
    first = {}
    for order, line, part, supplier, status, _ in rows:
        genes = sorted({f"G{part % 12}", f"G{supplier % 12}"})
        first.setdefault(order * 8 + line, (f"F{status}", ",".join(genes)))
    want = {}
    for key in first.values():
        want[key] = want.get(key, 0) + 1
    # a later part that is larger is read first
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag"]
    (tmp_path / "lineitem.parquet").mkdir()
    for k, part in enumerate((rows[:10_000], rows[10_000:])):
        pq.write_table(pa.table(dict(zip(names, zip(*part, strict=True), strict=True))), tmp_path / "lineitem.parquet" / f"part-{k}.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {(r.file, r.tuple): r.n for r in registry.tuple_counts_distinct(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want
