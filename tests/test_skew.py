"""Lookups with hot keys give the rows of a plain join."""

import pytest
from pyspark.sql import functions as F

from plaintide.operators import skew


@pytest.mark.parametrize("hot", [0, 50, 900])
def test_lookup_equals_join(spark, monkeypatch, hot):
    monkeypatch.setattr(skew, "HOT_ROWS", 40)
    rows = [(1, i) for i in range(hot)] + [(2, 7)] * 60 + [(i % 30 + 3, i) for i in range(200)]
    big = spark.createDataFrame(rows, "k int, v int")
    table = spark.range(1, 30).select(F.col("id").cast("int").alias("k"), F.map_from_arrays(F.array("id"), F.array("id")).alias("m"))
    got = skew.lookup(big, table, ["k"], len(rows))
    assert got.columns == ["k", "v", "m"]
    assert sorted((r.k, r.v) for r in got.collect()) == sorted(r for r in rows if r[0] < 30)
