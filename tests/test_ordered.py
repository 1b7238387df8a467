"""Block-wise window functions equal plain windows; the ordered fold equals
a Python fold, across several reduction levels."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from changeflow.operators.merge import ordered_fold
from changeflow.operators.ordered import keyed_neighbor, keyed_row_number


def _data(spark):
    rows = [(k, p, (p * 7) % 5) for k in (1, 2, 3) for p in range(0, 60, 1 + k)]
    return spark.createDataFrame(rows, "k long, p long, v long")


def test_row_number_and_rank(spark):
    df = _data(spark)
    w = Window.partitionBy("k").orderBy("p")
    ref = df.withColumn("rn", F.row_number().over(w))
    got = keyed_row_number(df, ["k"], ["p"], name="rn", partitions=7)
    assert sorted(ref.collect()) == sorted(got.select("k", "p", "v", "rn").collect())
    w2 = Window.partitionBy("k").orderBy("v")
    ref2 = df.withColumn("r", F.rank().over(w2))
    got2 = keyed_row_number(df, ["k"], ["v"], name="r", ties="rank", partitions=5)
    assert sorted(ref2.collect()) == sorted(got2.select("k", "p", "v", "r").collect())


def test_lag_lead(spark):
    df = _data(spark)
    w = Window.partitionBy("k").orderBy("p")
    ref = df.withColumn("prev_v", F.lag("v").over(w)).withColumn("next_v", F.lead("v").over(w))
    got = keyed_neighbor(df, ["k"], ["p"], ["v"], "prev", partitions=6)
    got = keyed_neighbor(got, ["k"], ["p"], ["v"], "next", partitions=6)
    assert sorted(ref.collect()) == sorted(got.select("k", "p", "v", "prev_v", "next_v").collect())


def test_ordered_fold_multi_level(spark):
    rows = [(k, p, p % 11) for k in (1, 2) for p in range(0, 300, k)]
    df = spark.createDataFrame(rows, "k long, lsn long, v long")
    got = ordered_fold(df, ["k"], ["v"],
                       {"v": "old.v * 3 + new.v - old.v * 2"}, "lsn", block=4, associative=True)
    # rule: v' = old.v + new.v (written awkwardly), an associative sum
    expect = {}
    for k, p, v in sorted(rows, key=lambda r: r[1]):
        expect[k] = v if k not in expect else reduce(lambda a, b: a + b, [expect[k], v])
    assert {r["k"]: r["v"] for r in got.collect()} == expect


def test_sequence_ids_dense_and_ordered(spark):
    from changeflow.operators.sequence import next_values, sequence_ids
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("v"))
    out = sequence_ids(df, ["v"], "sid", start=10, partitions=7).collect()
    pairs = sorted((r["v"], r["sid"]) for r in out)
    assert [s for _, s in pairs] == list(range(10, 1010))
    existing = spark.createDataFrame([(5,), (41,)], "sid long")
    new = next_values(spark.range(3).withColumnRenamed("id", "v"), existing, "sid", ["v"])
    assert sorted(r["sid"] for r in new.collect()) == [42, 43, 44]


def test_percentiles_by_one_window_or_by_blocks(spark):
    import random
    from changeflow.operators.transforms import exact_percentiles
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)])) for _ in range(500)] + [("empty", None)] * 3
    df = spark.createDataFrame(rows, "g string, v long").repartition(4)
    wanted = {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}
    for keys in (["g"], []):
        got = [sorted(map(repr, exact_percentiles(df, keys, "v", wanted, few).collect())) for few in (0, 10**6)]
        want = df.groupBy(*keys).agg(*[F.expr(f"percentile(v, {p})").alias(n) for n, p in wanted.items()])
        assert got[0] == got[1] == sorted(map(repr, want.collect()))
