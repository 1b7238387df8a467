"""Streaming: result equals the batch fold, restart from the checkpoint adds
nothing twice, a replayed batch is idempotent.  Graphs: cycles rejected,
logger counts rows.  IO: profile, CSV, sinks."""

import os
import time

import pytest
from pyspark.sql import functions as F

from changeflow.operators import changes as ch
from changeflow.plans.graph import Edge, Node, run_graph, topological_order
from changeflow.sources import io
from changeflow.sources.fixtures import Tables, base_state, change_feed
from changeflow.streaming import stream as st

SF = "/root/testdata/sf0.001"


def _parts(feed, path, lo, hi, n):
    step = (hi - lo) // n + 1
    for i in range(n):
        feed.filter((F.col("lsn") >= lo + i * step) & (F.col("lsn") < lo + (i + 1) * step)) \
            .coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)


def _sorted(df):
    return sorted(tuple(r) for r in df.select("user_id", "event_type", "value").collect())


def test_stream_restart_equals_batch(spark, scratch):
    t = Tables(spark, SF)
    feed = change_feed(t.events).drop("change_time")
    base = base_state(t.events)
    expect = _sorted(ch.apply_strict(base, feed, ["user_id"]))
    table = st.ChangeTable(os.path.join(scratch, "dest"), base.schema, keys=["user_id"])
    table.init(spark, base)
    fdir, ck = os.path.join(scratch, "feed"), os.path.join(scratch, "ck")
    mx = feed.agg(F.max("lsn")).first()[0]
    half = mx // 2
    _parts(feed.filter(F.col("lsn") <= half), fdir, 0, half, 2)
    spec = st.ApplySpec(compact_every=3)
    q = st.start_apply(st.read_feed_stream(spark, fdir, feed.schema, 1), table, spec, ck)
    q.awaitTermination()
    # more files arrive; a restarted query continues after the committed files
    _parts(feed.filter(F.col("lsn") > half), fdir, half + 1, mx, 2)
    q = st.start_apply(st.read_feed_stream(spark, fdir, feed.schema, 1), table, spec, ck)
    q.awaitTermination()
    assert table.base_version(spark) == 2          # compacted after the third batch
    assert _sorted(table.current(spark)) == expect


def test_replayed_batch_is_idempotent(spark, scratch):
    t = Tables(spark, SF)
    feed = change_feed(t.events).drop("change_time")
    base = base_state(t.events)
    table = st.ChangeTable(os.path.join(scratch, "dest"), base.schema, keys=["user_id"])
    table.init(spark, base)
    spec = st.ApplySpec(compact_every=1, outcomes_path=os.path.join(scratch, "out"))
    st.apply_batch(spark, feed, 0, table, spec)
    first = _sorted(table.current(spark))
    st.apply_batch(spark, feed, 0, table, spec)        # the same batch again
    assert _sorted(table.current(spark)) == first
    assert spark.read.parquet(os.path.join(scratch, "out")).count() == feed.count()


@pytest.mark.parametrize("mode", ["strict", "last_wins"])
def test_merge_on_read_equals_copy(spark, scratch, mode):
    """Folding delta batches at read time equals folding them one by one in
    arrival order, however often the state is compacted, although positions
    of the batches interleave as those of two sources do."""
    t = Tables(spark, SF)
    feed = change_feed(t.events).drop("change_time").filter("user_id % 4 = 1")
    base = base_state(t.events)
    batches = [feed.filter(F.col("lsn") % 3 == b) for b in range(3)]
    fold = ch.apply_strict if mode == "strict" else ch.apply_last_wins
    state = base
    for b in batches:
        state = spark.createDataFrame(fold(state, b, ["user_id"]).collect(), base.schema)
    for every in (0, 1, 2, 8):
        root = os.path.join(scratch, f"dest-{every}")
        table = st.ChangeTable(root, base.schema, keys=["user_id"], mode=mode)
        table.init(spark, base)
        spec = st.ApplySpec(compact_every=every, outcomes_path=os.path.join(scratch, f"out-{every}"))
        for i, b in enumerate(batches):
            st.apply_batch(spark, b, i, table, spec)
        assert _sorted(table.current(spark)) == _sorted(state)
        if every == 1:      # what only states before the last base need is gone
            assert [d for d in os.listdir(os.path.join(root, "changes")) if "=" in d] == ["batch_id=2"]
            assert len(os.listdir(os.path.join(root, "base"))) == 2
            status = {r.status for r in spark.read.parquet(spec.outcomes_path).collect()}
            assert status == ({"processed"} if mode == "last_wins" else {"processed", "failed"})


def test_unreadable_state_raises(spark, scratch):
    base = base_state(Tables(spark, SF).events)
    table = st.ChangeTable(os.path.join(scratch, "dest"), base.schema, keys=["user_id"])
    assert table.base_version(spark) is None and table.current(spark).count() == 0
    table.init(spark, base)
    for f in os.listdir(table.log_path):
        if f.startswith("part-"):
            os.remove(os.path.join(table.log_path, "." + f + ".crc"))
            with open(os.path.join(table.log_path, f), "wb") as out:
                out.write(b"damaged")
    with pytest.raises(Exception):
        table.current(spark)


def test_generated_values_are_drawn_once(spark, scratch):
    target = spark.createDataFrame([(1, "a", "kept")], "k long, v string, gid string")
    feed = spark.createDataFrame([(1, 0, 4, 1, "b", "mine"), (2, 0, 2, 2, "c", "mine")],
                                 "lsn long, seqval int, op_code int, k long, v string, gid string")
    table = st.ChangeTable(os.path.join(scratch, "dest"), target.schema, keys=["k"], generated={"gid": "uuid()"})
    table.init(spark, target)
    st.apply_batch(spark, feed, 0, table, st.ApplySpec(compact_every=0))
    first, second = (sorted(map(tuple, table.current(spark).collect())) for _ in range(2))
    assert first == second and first[0] == (1, "b", "kept") and len(first[1][2]) == 36


def test_remerge_batches_without_rows(spark, scratch):
    """Batches whose keys no longer come out of the merge only remove."""
    table = st.KeyReplaceTable(os.path.join(scratch, "dest"), spark.createDataFrame([], "id long, v string").schema)
    table.init(spark, spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"))
    table.append(spark, spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([], "id long, v string"), 0)
    assert [tuple(r) for r in table.current(spark).collect()] == [(2, "b")]


@pytest.mark.parametrize("found,given", [((3, 90), {}), ((3, 90), {"lower": 0}), ((None, None), {})])
def test_jdbc_bounds_come_from_one_query(spark, monkeypatch, found, given):
    """What the reads ask for; no database is read here."""
    from pyspark.sql import DataFrameReader
    reads, option = [{}], DataFrameReader.option
    monkeypatch.setattr(DataFrameReader, "option", lambda self, k, v: (reads[-1].update({k: v}), option(self, k, v))[1])

    def load(self):
        reads.append({})
        return spark.createDataFrame([found], "lo long, hi long")
    monkeypatch.setattr(DataFrameReader, "load", load)
    io.jdbc_scan(spark, "jdbc:none:", "orders", "id", partitions=8, properties={"user": "u"}, **given)
    assert reads[0]["query"] == "SELECT MIN(id) AS lo, MAX(id) AS hi FROM orders" and reads[0]["user"] == "u"
    if found[0] is None:
        assert reads[1]["dbtable"] == "orders" and "partitionColumn" not in reads[1]
    else:
        assert (reads[1]["lowerBound"], reads[1]["upperBound"], reads[1]["numPartitions"]) == (str(given.get("lower", 3)), "90", "8")
        assert "query" not in reads[1]


def test_shared_nodes_are_computed_once(spark):
    """A node with several out-edges and the rows a condition splits are
    computed once: an accumulator counts the rows that pass the expression."""
    seen = spark.sparkContext.accumulator(0)
    mark = F.udf(lambda x: (seen.add(1), x)[1], "long").asNondeterministic()
    df = spark.range(50).select(mark("id").alias("id"))
    nodes = [Node("src", "source", {"table": "t"}), Node("e", "expression", {"target": "d", "expression": "id * 2"}),
             Node("c", "condition", {"condition": "d % 4 = 0"}), Node("yes", "sink"), Node("no", "sink"), Node("all", "sink")]
    edges = [Edge("src", "e"), Edge("e", "c"), Edge("e", "all"), Edge("c", "yes", port="true"), Edge("c", "no", port="false")]
    out, _ = run_graph(spark, nodes, edges, {"t": df})
    assert sorted(r.id for n in ("yes", "no") for r in out[n].collect()) == list(range(50)) and out["all"].count() == 50
    assert seen.value == 50
    seen.value = 0
    single = [n for n in nodes if n.id != "all"]
    out, _ = run_graph(spark, single, [e for e in edges if e.target != "all"], {"t": df})
    assert out["yes"].count() == out["no"].count() == 25 and seen.value == 50


def test_parts_written_once(spark):
    from changeflow.operators import transforms as tf
    seen = spark.sparkContext.accumulator(0)
    mark = F.udf(lambda x: (seen.add(1), x)[1], "long").asNondeterministic()
    df = spark.range(60).select(mark("id").alias("id"), F.lit("x").alias("v"))
    parts = tf.split_parts(df, ["id"], 4, once=True)
    assert sorted(r.id for p in parts for r in p.collect()) == list(range(60)) and seen.value == 60
    assert "PartitionFilters: [isnotnull(_part" in parts[1]._jdf.queryExecution().executedPlan().toString()
    assert [p.columns for p in parts] == [["id", "v"]] * 4
    assert [p.count() for p in tf.split_parts(df.limit(0), ["id"], 3, once=True)] == [0, 0, 0]


def test_graph_cycle_and_logger(spark):
    with pytest.raises(ValueError, match="cycle"):
        topological_order([Node("a", "filter", {"condition": "true"}), Node("b", "filter", {"condition": "true"})],
                          [Edge("a", "b"), Edge("b", "a")])
    t = Tables(spark, SF)
    nodes = [Node("s", "source", {"table": "orders"}), Node("l", "logger"),
             Node("f", "fork", {"outputs": 2}), Node("x", "filter", {"condition": "o_orderstatus = 'F'"})]
    edges = [Edge("s", "l"), Edge("l", "f"), Edge("f", "x", port="out2")]
    res, obs = run_graph(spark, nodes, edges, {"orders": t.orders})
    n = res["x"].count()
    assert n == t.orders.filter("o_orderstatus = 'F'").count()
    assert obs["l"].get["rows"] == t.orders.count()


def test_profile_csv_sinks(spark, scratch):
    t = Tables(spark, SF)
    prof = io.table_profile(t.customer, ["c_custkey"]).collect()
    assert [r["column_name"] for r in prof][0] == "c_custkey" and prof[0]["is_key"]
    assert prof[0]["row_count"] == t.customer.count()
    p = os.path.join(scratch, "c.csv")
    t.customer.write.option("header", "true").csv(p)
    back = io.read_csv(spark, p, t.customer.schema)
    assert back.count() == t.customer.count()
    with pytest.raises(ValueError):
        io.write_table(t.customer, os.path.join(scratch, "b"), bucket_by=["c_custkey"])
    io.write_table(t.customer, os.path.join(scratch, "w"), "overwrite")
    io.write_table(t.customer, os.path.join(scratch, "w"), "overwrite")
    assert spark.read.parquet(os.path.join(scratch, "w")).count() == t.customer.count()


def test_log_table_retention_and_export(spark, scratch):
    from changeflow.operators import patterns as pt
    from changeflow.sources.fixtures import customer_dest, event_log
    t = Tables(spark, SF)
    log = event_log(t.events)
    io.append_log_table(log, "cf_event_log")
    dropped = io.drop_old_partitions(spark, "cf_event_log", 10, "2024-01-31")
    kept = spark.table("cf_event_log")
    assert dropped and min(r["event_date"] for r in kept.select("event_date").distinct().collect()) \
        .isoformat() >= "2024-01-21"
    assert kept.count() == log.filter("event_date >= DATE '2024-01-21'").count()
    spark.sql("DROP TABLE cf_event_log")
    res = pt.analyze_sources([("a", t.customer), ("b", customer_dest(t.customer))],
                             {"name": {"a": "c_name", "b": "c_name"}}, ["c_custkey"])
    out = os.path.join(scratch, "export")
    io.export_table(pt.export_long(res), out, "csv")
    back = spark.read.option("header", "true").csv(out)
    assert back.count() == pt.export_long(res).count() > 0
