"""Verification by block digests: the rows of the full verification, from few
buckets."""

import pytest
from pyspark.sql import functions as F

from changeflow.operators import digests as dg
from changeflow.operators import reconcile as rc


def rows(df):
    return sorted((repr(tuple(r)) for r in df.collect()))


def sides(spark, n=20_000):
    s = spark.range(n).selectExpr("id AS k", "concat('name ', id) AS name", "if(id % 7 = 0, null, id * 1.5) AS v")
    d = s.withColumn("name", F.when(F.col("k") % 2000 == 3, F.upper("name")).when(F.col("k") % 500 == 1, F.concat(F.lit("  "), "name")).otherwise(F.col("name")))
    return s, d


def test_ten_keys_of_many(spark):
    s, d = sides(spark)
    want = rc.verify_rows(s, d, ["k"]).filter("status <> 'matched'")
    got = dg.verify_by_digests(s, d, ["k"], first=16, fan_out=16, leaf_rows=40)
    assert rows(got) == rows(want) and want.count() == 10
    own, other = dg.differing_rows(s, d, ["k"], ["name", "v"], first=16, fan_out=16, leaf_rows=40)
    assert 10 <= own.count() == other.count() <= 10 * 40
    assert not dg.tables_agree(s, d, ["k"]) and dg.tables_agree(s, s.repartition(5), ["k"])


@pytest.mark.parametrize("typed", [False, True])
def test_missing_rows_null_keys_nulls_and_repeats(spark, typed):
    schema = "k long, j string, name string, v double"
    s = spark.createDataFrame([(1, "a", "x", 1.0), (2, "a", None, 2.0), (3, None, "n", 3.0), (4, "a", "q ", None), (5, "a", "None", 1.0), (9, "z", "only", 0.0)], schema)
    d = spark.createDataFrame([(1, "a", "x", 1.0), (2, "a", "", 2.0), (3, None, "n", 3.0), (4, "a", "q", None), (5, "a", None, 1.0), (8, "z", "other", 0.0)], schema)
    for first in (1, 3, 1024):
        got = dg.verify_by_digests(s, d, ["k", "j"], typed=typed, first=first, leaf_rows=1)
        assert rows(got) == rows(rc.verify_rows(s, d, ["k", "j"], typed=typed).filter("status <> 'matched'"))
    twice = s.filter("k <= 2").unionByName(s.filter("k = 1"))
    assert not dg.tables_agree(twice, s.filter("k <= 2"), ["k", "j"]) and dg.tables_agree(twice, twice, ["k", "j"])
    assert dg.tables_agree(s.limit(0), s.limit(0), ["k"]) and rows(dg.verify_by_digests(s.limit(0), s.limit(0), ["k", "j"])) == []


def test_sides_are_folded_before_they_are_shuffled(spark):
    s, d = sides(spark, 1000)
    a, b = (dg._hashed(x, ["k"], ["name", "v"], False) for x in (s, d))
    plan = dg.differing_buckets(a, b, 64)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("partial_sum") >= 2
