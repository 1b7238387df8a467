"""Checks for streaming change application (C9, C11, C12 streaming, C14
streaming).  Each check splits a derived feed into parts, runs the stream
to completion after each part has arrived (``availableNow``, one part per
micro-batch, resumed from its checkpoint) and returns the final destination state - which must equal the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from changeflow.catalog import register
from changeflow.catalog.changes_q import C6_SQL, C7_SQL, C15_SQL, C16_SQL, C17_ORDER_SQL, C17_SQL, C20_SQL
from changeflow.catalog.merge_q import C14_SQL
from changeflow.operators.merge import run_merge
from changeflow.session import scratch_path
from changeflow.sources.fixtures import Tables, base_state, change_feed, customer_dest
from changeflow.streaming import history as hs
from changeflow.streaming import positions as ps
from changeflow.streaming import progress as pg
from changeflow.streaming import resolve as rs
from changeflow.streaming import stream as st

N_PARTS = 4


def _parts(feed):
    """The feed split into ranges of positions."""
    lo, hi = feed.agg(F.min("lsn"), F.max("lsn")).first()
    step = (hi - lo) // N_PARTS + 1
    for i in range(N_PARTS):
        yield feed.filter((F.col("lsn") >= lo + i * step) & (F.col("lsn") < lo + (i + 1) * step))


def _run(spark, sf_dir, mode, tagged=False):
    t = Tables(spark, sf_dir)
    root = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    feed = change_feed(t.events).drop("change_time") if not tagged else change_feed(t.events)
    base = base_state(t.events)
    table = st.ChangeTable(f"{root}/dest", base.schema, keys=["user_id"], mode=mode)
    table.init(spark, base)
    # 4 batches, compaction after the third: the result is base + one delta
    spec = st.ApplySpec(compact_every=3, outcomes_path=f"{root}/outcomes")
    for part in _parts(feed):
        part.write.mode("append").parquet(f"{root}/feed")
        stream = st.read_feed_stream(spark, f"{root}/feed", feed.schema)
        if tagged:
            stream = st.tag_stream(stream.filter(F.col("source_id") == "src_erp"), "erp").unionByName(
                st.tag_stream(stream.filter(F.col("source_id") == "src_crm"), "crm"))
        st.start_apply(stream, table, spec, f"{root}/checkpoint").awaitTermination()
    return table.current(spark)


@register("c11_stream_strict_apply", C6_SQL)
def c11_strict(spark, sf_dir):
    return _run(spark, sf_dir, "strict")


@register("c9_stream_last_wins_apply", C7_SQL)
def c9_last_wins(spark, sf_dir):
    return _run(spark, sf_dir, "last_wins")


@register("c12_stream_multi_source_apply", C6_SQL)
def c12_stream(spark, sf_dir):
    """Two tagged source streams unioned, applied strictly."""
    return _run(spark, sf_dir, "strict", tagged=True)


@register("c14_stream_remerge", C14_SQL)
def c14_stream(spark, sf_dir):
    """Affected keys arrive as a stream; each batch re-merges its keys and
    replaces them in the destination."""
    from changeflow.catalog.merge_q import c14_spec
    t = Tables(spark, sf_dir)
    root = scratch_path(spark, f"remerge-{uuid.uuid4().hex}")
    dest_src = customer_dest(t.customer)
    old = run_merge(spark, c14_spec(t, dest_src))
    changed = dest_src.filter(F.col("c_mktsegment").isNull() | (F.col("c_custkey") >= 10000000)) \
        .select("c_custkey")
    keys = changed.withColumn("lsn", F.col("c_custkey"))
    table = st.KeyReplaceTable(f"{root}/dest", old.schema, key="customer_id")
    table.init(spark, old)
    for part in _parts(keys):
        part.write.mode("append").parquet(f"{root}/keys")
        stream = st.read_feed_stream(spark, f"{root}/keys", keys.schema)
        st.start_remerge(stream, lambda: c14_spec(t, t.customer), "c_custkey", table,
                         f"{root}/checkpoint", compact_every=3).awaitTermination()
    return table.current(spark)


# ------------------------------------------------------------------ C15 - C17

def _resolve(spark, sf_dir, columns, ordered, **rule):
    """The feed in parts - ranges of positions, or any rows in any order -
    resolved part by part, compacted after the third."""
    root = scratch_path(spark, f"resolve-{uuid.uuid4().hex}")
    feed = change_feed(Tables(spark, sf_dir).events).filter(F.col("op_code").isin(1, 2, 4))
    feed = feed.withColumn("n_events", F.lit(1).cast("long")).select("user_id", *columns, "lsn", "seqval")
    table = rs.ResolvedTable(f"{root}/dest", feed.schema, keys=["user_id"], order=["lsn", "seqval"], **rule)
    dealt = [feed.filter(F.pmod(F.xxhash64("lsn"), F.lit(N_PARTS)) == i) for i in range(N_PARTS)]
    for part in _parts(feed) if ordered else dealt:
        part.write.mode("append").parquet(f"{root}/feed")
        stream = st.read_feed_stream(spark, f"{root}/feed", feed.schema)
        rs.start_resolution(stream, table, f"{root}/checkpoint", compact_every=3).awaitTermination()
    return table.current(spark).select("user_id", *columns)


@register("c15_stream_latest", C15_SQL)
def c15_stream(spark, sf_dir):
    return _resolve(spark, sf_dir, ["source_id", "event_type", "value"], False, rule="latest")


@register("c16_stream_priority", C16_SQL)
def c16_stream(spark, sf_dir):
    return _resolve(spark, sf_dir, ["source_id", "event_type", "value"], False, rule="priority", source_col="source_id",
                    priority=["src_erp", "src_crm"])


@register("c17_stream_custom", C17_SQL)
def c17_stream(spark, sf_dir):
    return _resolve(spark, sf_dir, ["value", "n_events"], False, rule="custom", commutative=True,
                    rules={"value": "greatest(old.value, new.value)", "n_events": "old.n_events + new.n_events"})


@register("c17_stream_custom_ordered", C17_ORDER_SQL)
def c17_stream_ordered(spark, sf_dir):
    return _resolve(spark, sf_dir, ["event_type"], True, rule="custom", block=7,
                    rules={"event_type": "concat(old.event_type, '|', new.event_type)"})


# ------------------------------------------------------------------ positions

@register("c9_poll_by_position", C6_SQL)
def c9_poll(spark, sf_dir):
    """The feed polled by the positions of its two sources: parts arrive one
    by one, the last together with copies of rows that were read before."""
    t = Tables(spark, sf_dir)
    root = scratch_path(spark, f"poll-{uuid.uuid4().hex}")
    feed, base = change_feed(t.events).drop("change_time"), base_state(t.events)
    table = st.ChangeTable(f"{root}/dest", base.schema, keys=["user_id"])
    table.init(spark, base)
    seen = None
    for i, part in enumerate(_parts(feed)):
        part.write.mode("append").parquet(f"{root}/feed")
        if i == N_PARTS - 1:
            seen.withColumn("value", F.lit(-1.0)).write.mode("append").parquet(f"{root}/feed")
        seen = part if seen is None else seen.unionByName(part)
        positions = ps.FeedPositions(spark, f"{root}/positions", source_col="source_id")
        ps.poll_feed(positions, lambda: spark.read.schema(feed.schema).parquet(f"{root}/feed"),
                     lambda batch, b: st.apply_batch(spark, batch, b, table, st.ApplySpec(compact_every=3)))
    return table.current(spark)


# ------------------------------------------------------------------ C20

@register("c20_stream_history", f"SELECT * EXCLUDE (surrogate_key) FROM ({C20_SQL})")
def c20_stream(spark, sf_dir):
    """Parts of any rows in any order, so most events are late; compacted
    after the third."""
    root = scratch_path(spark, f"history-{uuid.uuid4().hex}")
    feed = change_feed(Tables(spark, sf_dir).events).select("user_id", "event_type", "lsn", "seqval", "change_time", "op_code")
    table = hs.HistoryTable(f"{root}/dest", hs.history_schema(feed.schema), keys=["user_id"])
    for i in range(N_PARTS):
        feed.filter(F.pmod(F.xxhash64("lsn"), F.lit(N_PARTS)) == i).write.mode("append").parquet(f"{root}/feed")
        stream = st.read_feed_stream(spark, f"{root}/feed", feed.schema)
        hs.start_history(stream, table, f"{root}/checkpoint", compact_every=3).awaitTermination()
    return table.history(spark).select("user_id", "lsn", "event_type", "effective_date", "expiration_date", "is_current")


# ------------------------------------------------------------------ A10

@register("a10_stream_throughput", f"SELECT CAST({N_PARTS} AS BIGINT) AS batches, count(*) AS events_processed, true AS timed FROM events")
def a10_stream(spark, sf_dir):
    """Progress rows of a query that reads the feed in parts."""
    root = scratch_path(spark, f"progress-{uuid.uuid4().hex}")
    feed = change_feed(Tables(spark, sf_dir).events)
    log = pg.ProgressLog(spark, f"{root}/progress")
    spark.streams.addListener(log)
    try:
        for part in _parts(feed):
            part.write.mode("append").parquet(f"{root}/feed")
            query = (st.read_feed_stream(spark, f"{root}/feed", feed.schema).writeStream.format("noop")
                     .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
            query.awaitTermination()
            log.wait(query.runId)
    finally:
        spark.streams.removeListener(log)
    rates = pg.stream_throughput(pg.progress_rows(spark, f"{root}/progress").filter("input_rows > 0"))
    timed = (F.col("run_seconds") > 0) & (F.col("events_per_second") > 0) & (F.col("busy_seconds") > 0)
    return rates.select("batches", "events_processed", timed.alias("timed"))
