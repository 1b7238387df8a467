"""Windows answered from stored hourly states."""

import random

from pyspark.sql import functions as F

from changeflow.operators import latency_states as ls
from changeflow.operators import telemetry as tm


def records(spark, n=4000):
    rng = random.Random(6)
    rows = [(rng.choice(["m1", "m2"]), f"2024-03-{1 + rng.randrange(3):02} {rng.randrange(24):02}:{rng.randrange(60):02}:07", rng.randrange(100_000)) for _ in range(n)]
    rows += [("m3", "2024-03-02 05:00:00", None), ("m1", "2024-03-02 05:30:00", None)]
    return spark.createDataFrame(rows, "mapping_id string, t string, latency_ms long").withColumn("destination_insert_time", F.col("t").cast("timestamp_ntz")).drop("t")


def test_window_from_states_is_within_the_error(spark):
    df = records(spark)
    states = ls.hourly_states(df)
    assert states.groupBy("mapping_id", "hour").count().filter("count > 1").count() == 0
    got = {r.mapping_id: r for r in ls.window_stats(states, "2024-03-01 06:00:00", "2024-03-02 06:00:00", by_mapping=True).collect()}
    held = df.filter("destination_insert_time >= '2024-03-01 06:00:00' AND destination_insert_time < '2024-03-02 06:00:00'")
    exact = {r.mapping_id: r for r in tm.latency_stats(held, None, None, by_mapping=True).collect()}
    assert set(got) == set(exact) == {"m1", "m2", "m3"}
    assert got["m3"].avg_latency_ms is None and got["m3"].p50_latency_ms is None and got["m3"].total_records == 1
    for m in ("m1", "m2"):
        g, e = got[m], exact[m]
        assert (g.total_records, g.min_latency_ms, g.max_latency_ms) == (e.total_records, e.min_latency_ms, e.max_latency_ms)
        assert abs(g.avg_latency_ms - e.avg_latency_ms) < 1e-6
        values = sorted(r.latency_ms for r in held.filter((F.col("mapping_id") == m) & F.col("latency_ms").isNotNull()).collect())
        for p, v in ((0.5, g.p50_latency_ms), (0.95, g.p95_latency_ms), (0.99, g.p99_latency_ms)):
            share = sum(x <= v for x in values) / len(values)
            assert v in values and abs(share - p) <= ls.RANK_ERROR + 1 / len(values)


def test_moving_windows_equal_single_ones(spark):
    states = ls.hourly_states(records(spark, 300)).cache()
    moving = {str(r.window_end): r for r in ls.moving_stats(states, 24).collect()}
    for end in ("2024-03-02 00:00:00", "2024-03-02 07:00:00", "2024-03-04 10:00:00"):
        start = {"2024-03-02 00:00:00": "2024-03-01 00:00:00", "2024-03-02 07:00:00": "2024-03-01 07:00:00", "2024-03-04 10:00:00": "2024-03-03 10:00:00"}[end]
        one = ls.window_stats(states, start, end).first()
        assert (moving[end].total_records, moving[end].max_latency_ms, moving[end].p50_latency_ms) == (one.total_records, one.max_latency_ms, one.p50_latency_ms)
    assert max(moving) == "2024-03-04 23:00:00"
    states.unpersist()
