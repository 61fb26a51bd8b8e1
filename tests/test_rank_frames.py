"""Ranks against a reference take time in proportion to the values of a group."""

import time

from repertoire.operators import neighbors


def test_many_values_of_one_group(spark):
    n = 300_000  # 4.5e10 steps if a frame is gone through for every value
    values = spark.range(n).selectExpr("1 g", "cast(id as double) v")
    began = time.monotonic()
    rows = neighbors.rank_against(values, values.where("v % 2 = 0"), ["g"], "v")
    assert rows.agg({"rank": "max"}).first()[0] == 100.0 and rows.where("v = 3").first()["rank"] == 100 * (2 + (3 - 2) / (4 - 2) * (1 + 0)) / (n / 2)
    assert time.monotonic() - began < 60
