"""History kept from batches in any order; progress rows of live queries."""

import random

import pytest
from pyspark.sql import functions as F

from changeflow.operators import changes as ch
from changeflow.streaming import history as hs
from changeflow.streaming import progress as pg
from changeflow.streaming import stream as st

FEED = "k long, v string, lsn long, seqval int, change_time timestamp_ntz, op_code int"


def feed(spark, seed, n=80):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 2, None]), rng.choice(["a", "b", None]), i // 2, i % 2, None if i == 7 else f"2024-01-{1 + i // 4:02}", rng.choice([1, 2, 3, 4, 4])) for i in range(n)]
    df = spark.createDataFrame(rows, FEED.replace("change_time timestamp_ntz", "change_time string"))
    return df.withColumn("change_time", F.col("change_time").cast("timestamp_ntz")).select(*[c.split()[0] for c in FEED.split(", ")])


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


COLUMNS = ("k", "lsn", "seqval", "v", "effective_date", "expiration_date", "is_current")


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_in_any_order_give_the_batch_history(spark, scratch, seed):
    df = feed(spark, seed)
    want = rows(ch.dimension_history(df, ["k"], columns=["lsn", "seqval", "v"]), *COLUMNS)
    table = hs.HistoryTable(f"{scratch}/dest", hs.history_schema(df.schema), keys=["k"])
    for b, part in enumerate(random.Random(seed).sample(range(5), 5)):
        own = df.filter(F.pmod(F.xxhash64("lsn", "seqval"), F.lit(5)) == part)
        table.append(spark, own, b)
        table.append(spark, own, b)                     # a replayed batch
        if b in (1, 3):
            table.compact(spark, b)
    assert rows(table.history(spark), *COLUMNS) == want
    assert table.history(spark).groupBy("k").agg(F.sum(F.col("is_current").cast("int")).alias("n")).filter("n > 1").count() == 0


def test_untouched_keys_are_copied(spark, scratch):
    df = feed(spark, 3)
    table = hs.HistoryTable(f"{scratch}/dest", hs.history_schema(df.schema), keys=["k"])
    table.append(spark, df.filter("k = 1"), 0)
    table.compact(spark, 0)
    marked = table.base(spark)[0].withColumn("v", F.lit("mark"))
    after = table.fold(marked, df.filter("k = 2 AND op_code <> 3"))
    assert after.filter("k = 1 AND v <> 'mark'").count() == 0 and after.filter("k = 2").count() == df.filter("k = 2 AND op_code <> 3").count()
    assert rows(table.fold(marked, df.limit(0)), "k", "v", "lsn") == rows(marked, "k", "v", "lsn")


def test_progress_rows_equal_the_batches(spark, scratch):
    log = pg.ProgressLog(spark, f"{scratch}/progress", buffer=2)
    assert pg.progress_rows(spark, f"{scratch}/progress") is None
    spark.streams.addListener(log)
    try:
        for n in (10, 25, 7):
            spark.range(n).write.mode("append").parquet(f"{scratch}/feed")
            q = (st.read_feed_stream(spark, f"{scratch}/feed", "id long").writeStream.format("noop").queryName("probe")
                 .option("checkpointLocation", f"{scratch}/ck").trigger(availableNow=True).start())
            q.awaitTermination()
            log.wait(q.runId)
    finally:
        spark.streams.removeListener(log)
    got = pg.progress_rows(spark, f"{scratch}/progress").filter("input_rows > 0")
    assert rows(got, "batch_id", "input_rows", "query_name") == [(0, 10, "probe"), (1, 25, "probe"), (2, 7, "probe")]
    r = pg.stream_throughput(got).first()
    assert (r.batches, r.events_processed) == (3, 42) and 0 < r.busy_seconds <= r.run_seconds and r.events_per_second > 0
