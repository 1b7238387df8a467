"""Checks for telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeflow.catalog import register
from changeflow.functions.columns import decode_operation
from changeflow.operators import latency_states as ls
from changeflow.operators import telemetry as tm
from changeflow.session import written
from changeflow.sources.fixtures import (Tables, change_feed, event_log, latency_metrics,
                                         with_ctes)

ANCHOR = "2024-01-30 23:59:59"

C21_SQL = with_ctes("""
WITH a AS (SELECT lsn, CASE WHEN op_code = 1 THEN 'DELETE' WHEN op_code IN (3, 4) THEN 'UPDATE' ELSE 'INSERT' END
                  AS operation, change_time,
                  make_timestamp(epoch_us(change_time) + (lsn * 7919) % 5000000) AS written_at
           FROM change_feed)
SELECT lsn, operation, (epoch_us(written_at) - epoch_us(change_time)) // 1000 AS latency_ms
FROM a WHERE operation IN ('INSERT', 'UPDATE')
""", "change_feed")


@register("c21_latency_capture", C21_SQL)
def c21(spark, sf_dir):
    t = Tables(spark, sf_dir)
    f = change_feed(t.events)
    applied = f.select("lsn", decode_operation("op_code").alias("operation"), "change_time",
                       (F.col("change_time") + F.make_dt_interval(secs=(
                           ((F.col("lsn") * 7919) % 5000000).cast("decimal(18,6)") / 1000000
                       ).cast("decimal(18,6)"))).alias("written_at"))
    return tm.capture_latency(applied, "change_time", "written_at").select("lsn", "operation", "latency_ms")


def _stats_sql(where="", group=""):
    sel_group = f"{group}, " if group else ""
    distinct = "" if group else ", count(DISTINCT mapping_id) AS distinct_mappings"
    return with_ctes(f"""
SELECT {sel_group}count(*) AS total_records,
       CAST(sum(latency_ms) AS DOUBLE) / count(latency_ms) AS avg_latency_ms,
       min(latency_ms) AS min_latency_ms, max(latency_ms) AS max_latency_ms,
       quantile_cont(latency_ms, 0.5) AS p50_latency_ms, quantile_cont(latency_ms, 0.95) AS p95_latency_ms,
       quantile_cont(latency_ms, 0.99) AS p99_latency_ms{distinct}
FROM latency_metrics {where} {"GROUP BY " + group if group else ""}
""", "latency_metrics")


@register("a6_latency_statistics", _stats_sql(
    f"WHERE destination_insert_time >= TIMESTAMP '{ANCHOR}' - INTERVAL 168 HOUR AND mapping_id = 'map_1'"))
def a6(spark, sf_dir):
    """Last 7 days before the anchor, one mapping."""
    t = Tables(spark, sf_dir)
    return tm.latency_stats(latency_metrics(t.events), ANCHOR, 168, mapping="map_1")


@register("a7_latency_percentiles", _stats_sql())
def a7(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tm.latency_stats(latency_metrics(t.events), None, None)


@register("a8_latency_by_mapping", _stats_sql(
    f"WHERE destination_insert_time >= TIMESTAMP '{ANCHOR}' - INTERVAL 240 HOUR", "mapping_id"))
def a8(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tm.latency_stats(latency_metrics(t.events), ANCHOR, 240, by_mapping=True)


def _json_counts(col):
    return (f"(SELECT '{{' || string_agg('\"' || k || '\":' || CAST(n AS VARCHAR), ',' ORDER BY k) || '}}' "
            f"FROM (SELECT coalesce({col}, 'unknown') AS k, count(*) AS n FROM event_log GROUP BY 1))")


A9_SQL = with_ctes(f"""
SELECT count(*) AS total_events,
       count(*) FILTER (WHERE status = 'processed') AS successful_events,
       count(*) FILTER (WHERE status = 'failed') AS failed_events,
       round(count(*) FILTER (WHERE status = 'processed') * 100.0 / count(*), 2) AS success_rate,
       {_json_counts('operation')} AS operations,
       {_json_counts('source_table')} AS tables
FROM event_log
""", "event_log")


@register("a9_event_log_statistics", A9_SQL)
def a9(spark, sf_dir):
    """Maps shown as JSON text for the comparison."""
    t = Tables(spark, sf_dir)
    s = tm.log_statistics(event_log(t.events))
    return s.withColumn("operations", F.to_json("operations")).withColumn("tables", F.to_json("tables"))


A10_SQL = with_ctes("""
SELECT count(*) FILTER (WHERE status = 'processed') AS events_processed,
       count(*) FILTER (WHERE status = 'failed') AS events_failed,
       (epoch_us(max(logged_at)) - epoch_us(min(logged_at))) / 1e6 AS run_seconds,
       count(*) / ((epoch_us(max(logged_at)) - epoch_us(min(logged_at))) / 1e6) AS events_per_second,
       max(logged_at) AS last_event_time
FROM event_log
""", "event_log")


@register("a10_throughput", A10_SQL)
def a10(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tm.throughput(event_log(t.events))


A11_SQL = with_ctes("""
SELECT source_table,
       count(*) FILTER (WHERE status = 'processed' AND operation = 'INSERT') AS inserted,
       count(*) FILTER (WHERE status = 'processed' AND operation = 'UPDATE') AS updated,
       count(*) FILTER (WHERE status = 'processed' AND operation = 'DELETE') AS deleted
FROM event_log GROUP BY source_table
""", "event_log")


@register("a11_run_counters", A11_SQL)
def a11(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tm.run_counters(event_log(t.events), "source_table")


T2_SQL = with_ctes("""
SELECT id, mapping_id, latency_ms, destination_insert_time FROM latency_metrics WHERE mapping_id = 'map_1'
ORDER BY destination_insert_time DESC, id DESC LIMIT 100
""", "latency_metrics")


@register("t2_recent_latency", T2_SQL)
def t2(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tm.recent_latency(latency_metrics(t.events), 100, "map_1") \
        .select("id", "mapping_id", "latency_ms", "destination_insert_time")


T4_SQL = with_ctes("""
SELECT event_id, logged_at, source_table, operation, status FROM event_log
WHERE event_date >= DATE '2024-01-10' AND event_date <= DATE '2024-01-12'
  AND source_table = 'dbo.t1' AND operation = 'UPDATE'
ORDER BY logged_at DESC, event_id DESC LIMIT 100
""", "event_log")


@register("t4_event_log_query", T4_SQL)
def t4(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tm.query_log(event_log(t.events), "2024-01-10", "2024-01-12", table="dbo.t1",
                        operation="UPDATE", limit=100) \
        .select("event_id", "logged_at", "source_table", "operation", "status")


T5_SQL = with_ctes("""
SELECT event_id, logged_at, operation FROM event_log WHERE status = 'failed'
ORDER BY logged_at DESC, event_id DESC LIMIT 50
""", "event_log")


@register("t5_recent_errors", T5_SQL)
def t5(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tm.recent_errors(event_log(t.events), 50).select("event_id", "logged_at", "operation")


T7_SQL = with_ctes("""
SELECT event_id, CAST(event_date AS VARCHAR) AS event_date FROM event_log
WHERE event_date >= DATE '2024-01-31' - INTERVAL 10 DAY
""", "event_log")


@register("t7_log_retention", T7_SQL)
def t7(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tm.retained(event_log(t.events), 10, "2024-01-31") \
        .select("event_id", F.col("event_date").cast("string").alias("event_date"))


# ------------------------------------------------------------------ A6 - A8 from stored states

# the percentiles' ranks are checked: their share of the window's values lies within the sketch's error
A8_STATES_SQL = with_ctes("""
WITH h AS (SELECT mapping_id, date_trunc('hour', destination_insert_time) AS hour, latency_ms FROM latency_metrics),
w AS (SELECT hour + INTERVAL (i) HOUR AS window_end, mapping_id, latency_ms FROM h, unnest(range(1, 25)) AS t(i))
SELECT window_end, mapping_id, count(*) AS total_records, CAST(sum(latency_ms) AS DOUBLE) / count(latency_ms) AS avg_latency_ms,
       CAST(min(latency_ms) AS DOUBLE) AS min_latency_ms, CAST(max(latency_ms) AS DOUBLE) AS max_latency_ms, true AS ranks_hold
FROM w GROUP BY window_end, mapping_id
""", "latency_metrics")


@register("a8_moving_windows_from_states", A8_STATES_SQL)
def a8_states(spark, sf_dir):
    """Every 24 hours of every mapping from hourly states, and whether the
    median's and the 95th percentile's ranks hold against the records."""
    records = latency_metrics(Tables(spark, sf_dir).events)
    moving = written(ls.moving_stats(written(ls.hourly_states(records), "states"), 24, by_mapping=True), "moving")
    hour = F.date_trunc("hour", "destination_insert_time").cast("timestamp_ntz")
    values = records.select("mapping_id", "latency_ms", F.explode(F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: hour + F.make_dt_interval(F.lit(0), i))).alias("window_end"))
    held = values.join(moving, ["window_end", "mapping_id"]).groupBy("window_end", "mapping_id").agg(
        *[F.avg((F.col("latency_ms") < F.col(f"{p}_latency_ms")).cast("int")).alias(f"{p}_below") for p in ("p50", "p95")],
        *[F.avg((F.col("latency_ms") <= F.col(f"{p}_latency_ms")).cast("int")).alias(f"{p}_upto") for p in ("p50", "p95")],
        F.max(1.0 / F.col("total_records")).alias("one"))
    fits = F.lit(True)
    for p, share in (("p50", 0.5), ("p95", 0.95)):
        slack = F.lit(ls.RANK_ERROR) + F.col("one")
        fits = fits & (F.col(f"{p}_below") <= F.lit(share) + slack) & (F.col(f"{p}_upto") >= F.lit(share) - slack)
    return moving.join(held.select("window_end", "mapping_id", fits.alias("ranks_hold")), ["window_end", "mapping_id"]).select(
        "window_end", "mapping_id", "total_records", "avg_latency_ms", "min_latency_ms", "max_latency_ms", "ranks_hold")
