"""Conflict rules on a stream and the feed by positions: any split equals the
batch, restarts, late rows."""

import random

import pytest
from pyspark.sql import functions as F

from changeflow.operators.merge import resolve_conflicts
from changeflow.streaming import positions as ps
from changeflow.streaming import resolve as rs
from changeflow.streaming import stream as st

SCHEMA = "k long, src string, v long, lsn long, seqval int"


def events(n=120, seed=3):
    rng = random.Random(seed)
    return [(rng.choice([1, 2, 3, None]), rng.choice(["a", "b", "c", None]), rng.randrange(100), i // 2, i % 2) for i in range(n)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def run(spark, table, folder, parts, compact_every):
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/feed")
        stream = st.read_feed_stream(spark, f"{folder}/feed", table.schema)
        rs.start_resolution(stream, table, f"{folder}/checkpoint", compact_every).awaitTermination()     # a restart for each


RULES = {"latest": {}, "priority": {"source_col": "src", "priority": ["b", "a"]},
         "custom": {"rules": {"src": "greatest(old.src, new.src)", "v": "old.v + new.v"}, "commutative": True}}


@pytest.mark.parametrize("rule", sorted(RULES))
@pytest.mark.parametrize("compact_every", [1, 2])
def test_any_split_equals_the_batch(spark, scratch, rule, compact_every):
    all_events = events()
    shuffled = random.Random(compact_every).sample(all_events, len(all_events))
    frame = spark.createDataFrame(all_events, SCHEMA)
    table = rs.ResolvedTable(f"{scratch}/dest", frame.schema, keys=["k"], rule=rule, order=["lsn", "seqval"], **RULES[rule])
    run(spark, table, scratch, [shuffled[:10], shuffled[10:70], shuffled[70:]], compact_every)
    assert rows(table.current(spark)) == rows(table.resolve(frame))
    options = {k: v for k, v in RULES[rule].items() if k != "commutative"}
    if rule != "custom":
        batch = resolve_conflicts(frame, ["k"], rule, ["src", "v"], ["lsn", "seqval"], **options)
        assert rows(table.current(spark).select("k", "src", "v")) == rows(batch)


def test_state_is_kept_in_rocksdb_and_batches_replay(spark, scratch):
    all_events = events()
    frame = spark.createDataFrame(all_events, SCHEMA)
    table = rs.ResolvedTable(f"{scratch}/dest", frame.schema, keys=["k"], order=["lsn", "seqval"])
    run(spark, table, scratch, [all_events[60:], all_events[:60]], 0)
    assert "RocksDB" in spark.conf.get(rs.STATE_STORE)
    want = rows(table.resolve(frame))
    assert rows(table.current(spark)) == want
    # the second batch emitted its keys' winners of all events, not of its own
    emitted = spark.read.parquet(table.rows_path).filter("batch_id = 1").drop("batch_id").select(*table.schema.fieldNames())
    assert rows(emitted) == want
    table.append(spark, emitted, 1)
    assert rows(table.current(spark)) == want


def test_ordered_rules_and_late_events(spark, scratch):
    all_events = [e for e in events() if e[1]]
    frame = spark.createDataFrame(all_events, SCHEMA)
    table = rs.ResolvedTable(f"{scratch}/dest", frame.schema, keys=["k"], rule="custom", order=["lsn", "seqval"], block=4,
                             rules={"src": "concat(old.src, new.src)", "v": "new.v"})
    run(spark, table, scratch, [all_events[:30], all_events[30:50], all_events[50:]], 2)
    texts = {}
    for k, src, *_ in all_events:
        texts[k] = texts.get(k, "") + src
    assert {r.k: r.src for r in table.current(spark).collect()} == texts
    late = frame.limit(1)
    table.append(spark, late, 3)
    with pytest.raises(Exception, match="not after the last one"):
        table.current(spark).collect()


def test_positions_are_exclusive_and_per_source(spark, scratch):
    feed = f"{scratch}/feed"
    log = []

    def add(*batch):
        spark.createDataFrame(list(batch), "src string, lsn long, seqval int").coalesce(1).write.mode("append").parquet(feed)

    def poll():
        positions = ps.FeedPositions(spark, f"{scratch}/positions", source_col="src")      # as after a restart
        return ps.poll_feed(positions, lambda: spark.read.parquet(feed), lambda b, i: log.append((i, rows(b))))
    add(("a", 1, 0), ("a", 1, 1), ("b", 50, 0))
    assert poll() == 1 and log[-1] == (0, [("a", 1, 0), ("a", 1, 1), ("b", 50, 0)])
    assert poll() == 0
    add(("a", 1, 1), ("a", 0, 7), ("b", 50, 0), ("b", 3, 0))         # a late file with old positions
    assert poll() == 0
    add(("a", 1, 2), ("b", 51, 0), ("c", 1, 0), (None, 9, 9), ("a", None, 1))
    assert poll() == 1 and log[-1] == (1, [("a", 1, 2), ("b", 51, 0), ("c", 1, 0), (None, 9, 9)])
    assert poll() == 0 and len(log) == 2
    positions = ps.FeedPositions(spark, f"{scratch}/positions", source_col="src")
    assert positions.bounds(1) == {"a": (1, 2), "b": (51, 0), "c": (1, 0), "": (9, 9)}


def test_a_batch_that_failed_is_read_again_with_its_bounds(spark, scratch):
    feed, seen = f"{scratch}/feed", []
    add = lambda *r: spark.createDataFrame(list(r), "lsn long, seqval int").coalesce(1).write.mode("append").parquet(feed)     # noqa: E731
    positions = ps.FeedPositions(spark, f"{scratch}/positions")
    add((1, 0), (2, 0))

    def fails(batch, i):
        raise RuntimeError("lost")
    with pytest.raises(RuntimeError):
        ps.poll_feed(positions, lambda: spark.read.parquet(feed), fails)
    add((3, 0))
    assert ps.poll_feed(positions, lambda: spark.read.parquet(feed), lambda b, i: seen.append((i, rows(b)))) == 2
    assert seen == [(0, [(1, 0), (2, 0)]), (1, [(3, 0)])]


def test_bounds_reach_the_scan(spark, scratch):
    spark.range(100).selectExpr("id AS lsn", "0 AS seqval", "'s' AS src").write.parquet(f"{scratch}/feed")
    positions = ps.FeedPositions(spark, f"{scratch}/positions", source_col="src")
    read = lambda: spark.read.parquet(f"{scratch}/feed").filter("lsn < 60")       # noqa: E731
    assert ps.poll_feed(positions, read, lambda b, i: None) == 1
    positions.plan(spark.read.parquet(f"{scratch}/feed"), 1)
    plan = positions.batch(spark.read.parquet(f"{scratch}/feed"), 1)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(lsn,99)" in plan and ">= 59" in plan
