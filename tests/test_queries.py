"""Every registered query against its SQL oracle on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from repertoire.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    return con


def _text(v) -> str:
    """A cell as text; whole floats like integers, since pandas makes floats of integers beside nulls."""
    if pd.isna(v):
        return "NULL"
    if isinstance(v, float):
        v = round(v, 6)
        return str(int(v)) if v.is_integer() else f"{v:.6f}"
    return str(v)


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(_text(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_oracle_gives_rows(spark, name):
    assert registry.queries()[name](spark, SMALL).count() > 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    got = registry.queries()[name](spark, SMALL).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_partition_count_does_not_matter(spark):
    name = "nbrdist_rank"
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(_rows(registry.queries()[name](spark, SMALL).toPandas()))
        assert found[0] == found[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_entry_imports_without_the_corpus_operators(spark):
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["clone_id", "chains", "wtd_nbrdist", "rank"]
