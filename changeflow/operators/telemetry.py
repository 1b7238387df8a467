"""Sync telemetry: latency capture and statistics, event-log queries and
statistics, throughput and run counters (C21, C22, A6-A11, T2, T4, T5,
T7).  Time windows take an explicit anchor instead of "now" so a rerun
returns the same answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.functions.columns import epoch_micros

PERCENTILES = (0.5, 0.95, 0.99)


def _micros(df: DataFrame, name: str) -> Column:
    return epoch_micros(F.col(name), df.schema[name].dataType)


# ---------------------------------------------------------------- C21 / C22

def capture_latency(applied: DataFrame, source_time: str, destination_time: str,
                    op_col: str = "operation") -> DataFrame:
    """Latency in whole milliseconds between the source change and the
    destination write, for inserts and updates only (truncating division of
    the microsecond difference, like ``int()``)."""
    diff = _micros(applied, destination_time) - _micros(applied, source_time)
    ms = F.when(diff >= 0, F.floor(diff / 1000)).otherwise(F.ceil(diff / 1000)).cast("long")
    return applied.filter(F.col(op_col).isin("INSERT", "UPDATE")).withColumn("latency_ms", ms)


def outcome_log(outcomes: DataFrame, table: str, id_col: str = "lsn",
                time_col: str = "change_time", keys: Sequence[str] = ()) -> DataFrame:
    """Event-log rows (event id, time, table, operation, status, error,
    keys) from per-event outcomes such as ``changes.strict_outcomes``."""
    from changeflow.functions.columns import decode_operation
    keys = list(keys)
    return outcomes.select(
        F.col(id_col).cast("string").alias("event_id"),
        F.col(time_col).alias("logged_at"),
        F.col(time_col).cast("date").alias("event_date"),
        F.lit(table).alias("source_table"),
        decode_operation("op_code").alias("operation"),
        "status", "error",
        F.array(*[F.col(k).cast("string") for k in keys]).alias("data_keys"))


# ---------------------------------------------------------------- A6 - A8

def _window(df: DataFrame, time_col: str, anchor: str | None, hours: float | None,
            mapping: str | None, mapping_col: str) -> DataFrame:
    if anchor is not None and hours is not None:
        lo = F.lit(anchor).cast("timestamp_ntz") - F.make_dt_interval(
            F.lit(0), F.lit(0), F.lit(0), F.lit(float(hours) * 3600.0))
        df = df.filter(F.col(time_col) >= lo)
    if mapping is not None:
        df = df.filter(F.col(mapping_col) == mapping)
    return df


def latency_stats(latency: DataFrame, anchor: str | None = None, hours: float | None = 24,
                  mapping: str | None = None, by_mapping: bool = False,
                  time_col: str = "destination_insert_time", mapping_col: str = "mapping_id",
                  approx: bool = False) -> DataFrame:
    """A6 + A7 (+ A8 with ``by_mapping``): count, average, min, max, distinct
    mappings and interpolated p50 / p95 / p99 over the last ``hours`` before
    ``anchor``.

    Exact percentiles come from counts per (group, value) numbered block-wise
    (``transforms.exact_percentiles``), so no group has to fit into one task;
    ``approx=True`` uses ``percentile_approx`` (fixed-size sketch)."""
    df = _window(latency, time_col, anchor, hours, mapping, mapping_col)
    v = F.col("latency_ms")
    names = [f"p{round(p * 100)}_latency_ms" for p in PERCENTILES]
    keys = [mapping_col] if by_mapping else []
    aggs = [F.count(F.lit(1)).alias("total_records"),
            (F.sum(v).cast("double") / F.count(v)).alias("avg_latency_ms"),
            F.min(v).alias("min_latency_ms"), F.max(v).alias("max_latency_ms")]
    if not by_mapping:
        aggs.append(F.count_distinct(mapping_col).alias("distinct_mappings"))
    if approx:
        aggs.append(F.percentile_approx(v, list(PERCENTILES), 10000).alias("_p"))
        out = df.groupBy(*keys).agg(*aggs)
        return out.withColumns({n: F.col("_p")[i].cast("double") for i, n in enumerate(names)}).drop("_p")
    from changeflow.operators.transforms import exact_percentiles
    key = (F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))).alias("_k")
    out = df.groupBy(key).agg(*aggs) if keys else df.agg(*aggs).select("*", key)
    pct = exact_percentiles(df, keys, "latency_ms", dict(zip(names, PERCENTILES))).select(key, *names)
    return out.join(pct, "_k", "left").select(*[F.col(f"_k.{k}").alias(k) for k in keys],
                                              *[c for c in out.columns if c != "_k"], *names)


def recent_latency(latency: DataFrame, n: int = 100, mapping: str | None = None,
                   time_col: str = "destination_insert_time", id_col: str = "id",
                   mapping_col: str = "mapping_id") -> DataFrame:
    """The ``n`` most recent latency records (a top-k report)."""
    df = latency if mapping is None else latency.filter(F.col(mapping_col) == mapping)
    return df.orderBy(F.col(time_col).desc(), F.col(id_col).desc()).limit(n)


# ---------------------------------------------------------------- A9 - A11

def log_statistics(log: DataFrame, start: str | None = None, end: str | None = None,
                   date_col: str = "event_date") -> DataFrame:
    """Totals, processed, failed, success % (2 dp) and counts by
    operation and by table (as maps; their size is bounded by the number of
    operations / tables).  No cap on the number of events."""
    if start:
        log = log.filter(F.col(date_col) >= F.lit(start).cast("date"))
    if end:
        log = log.filter(F.col(date_col) <= F.lit(end).cast("date"))
    # one pass over the log; the rest works on one row per (operation, table,
    # status), of which there are few
    n = F.col("n")
    per = log.groupBy(F.coalesce("operation", F.lit("unknown")).alias("operation"),
                      F.coalesce("source_table", F.lit("unknown")).alias("source_table"), "status") \
             .agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")

    def total(cond=None):
        return F.coalesce(F.sum(n if cond is None else F.when(cond, n)), zero)
    by = per.agg(total().alias("total_events"), total(F.col("status") == "processed").alias("successful_events"),
                 total(F.col("status") == "failed").alias("failed_events"),
                 F.collect_list(F.struct("operation", "source_table", "n")).alias("_rows"))

    def counts(col):
        names = F.array_sort(F.array_distinct(F.transform("_rows", lambda r: r[col])))
        return F.map_from_entries(F.transform(names, lambda k: F.struct(k, F.aggregate(
            F.filter("_rows", lambda r: r[col] == k), zero, lambda a, r: a + r["n"]))))
    rate = F.when(F.col("total_events") > 0, F.round(F.col("successful_events") * 100.0 / F.col("total_events"), 2)) \
        .otherwise(F.lit(0.0))
    return by.select("total_events", "successful_events", "failed_events", rate.alias("success_rate"),
                     counts("operation").alias("operations"), counts("source_table").alias("tables"))


def throughput(log: DataFrame, time_col: str = "logged_at") -> DataFrame:
    """A10: processed and failed events, events per second over the run time
    (first to last event) and the last event time."""
    agg = log.agg(F.count(F.when(F.col("status") == "processed", 1)).alias("events_processed"),
                  F.count(F.when(F.col("status") == "failed", 1)).alias("events_failed"),
                  F.min(time_col).alias("_first"), F.max(time_col).alias("last_event_time"))
    secs = (_micros(agg, "last_event_time") - _micros(agg, "_first")) / 1e6
    total = F.col("events_processed") + F.col("events_failed")
    return agg.select("events_processed", "events_failed",
                      secs.alias("run_seconds"),
                      F.when(secs > 0, total / secs).otherwise(F.lit(0.0)).alias("events_per_second"),
                      "last_event_time")


def run_counters(log: DataFrame, run_col: str | None = None) -> DataFrame:
    """Inserted / updated / deleted counters (processed events), per run
    when ``run_col`` is given."""
    ok = F.col("status") == "processed"
    aggs = [F.count(F.when(ok & (F.col("operation") == op), 1)).alias(name)
            for op, name in (("INSERT", "inserted"), ("UPDATE", "updated"), ("DELETE", "deleted"))]
    return log.groupBy(run_col).agg(*aggs) if run_col else log.agg(*aggs)


# ---------------------------------------------------------------- T4 / T5 / T7

def query_log(log: DataFrame, start: str | None = None, end: str | None = None, table: str | None = None,
              operation: str | None = None, status: str | None = None, limit: int | None = None,
              date_col: str = "event_date", time_col: str = "logged_at") -> DataFrame:
    """T4: events of a date range (partition pruned on ``date_col``; default
    today), optionally one table / operation / status, newest first; all of
    them, or the newest ``limit``."""
    lo = F.lit(start).cast("date") if start else F.current_date()
    hi = F.lit(end).cast("date") if end else lo
    df = log.filter((F.col(date_col) >= lo) & (F.col(date_col) <= hi))
    for col, val in (("source_table", table), ("operation", operation), ("status", status)):
        if val is not None:
            df = df.filter(F.col(col) == val)
    df = df.orderBy(F.col(time_col).desc(), F.col("event_id").desc())
    return df.limit(limit) if limit else df


def recent_errors(log: DataFrame, limit: int = 50, time_col: str = "logged_at") -> DataFrame:
    """T5: newest failed events (a top-k report)."""
    return log.filter(F.col("status") == "failed") \
              .orderBy(F.col(time_col).desc(), F.col("event_id").desc()).limit(limit)


def retained(log: DataFrame, days: int, anchor: str, date_col: str = "event_date") -> DataFrame:
    """Entries kept by a retention of ``days`` days before ``anchor``
    (a filter on the partition column: whole partitions drop out)."""
    cutoff = F.date_sub(F.lit(anchor).cast("date"), days)
    return log.filter(F.col(date_col) >= cutoff)
