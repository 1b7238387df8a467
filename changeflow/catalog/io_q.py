"""Checks for readers, writers and the table profile (S1, S2, S4, S8-S12,
S14, T3).  Sink checks write under the session's checkpoint folder and
read the result back (rows-only checks)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from changeflow.catalog import register
from changeflow.session import scratch_path
from changeflow.sources import io
from changeflow.sources.fixtures import Tables, event_log, latency_metrics, table, with_ctes


@register("s1_pruned_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def s1(spark, sf_dir):
    return io.scan(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"],
                   "l_quantity > 45")


S2_SQL = "SELECT c_mktsegment, count(*) AS customers FROM customer GROUP BY c_mktsegment"


@register("s2_query_source", S2_SQL)
def s2(spark, sf_dir):
    return io.query_source(spark, "SELECT c_mktsegment, count(*) AS customers FROM cust GROUP BY c_mktsegment",
                           {"cust": table(spark, sf_dir, "customer")})


S4_SQL = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 50"


@register("s4_bounded_source", S4_SQL)
def s4(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return io.bounded(t.orders, 50, ["o_orderkey", "o_totalprice"], "o_orderstatus = 'O'", ["o_orderkey"])


T3_SQL = """
SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY c_nationkey ORDER BY customers DESC, c_nationkey
LIMIT 10
"""


@register("t3_query_preview", T3_SQL)
def t3(spark, sf_dir):
    q = io.query_source(spark, "SELECT c_nationkey, count(*) AS customers FROM cust GROUP BY c_nationkey",
                        {"cust": table(spark, sf_dir, "customer")})
    return io.bounded(q, 10, order=[F.col("customers").desc(), "c_nationkey"])


_PROFILE = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
            ("c_acctbal", "double"), ("c_mktsegment", "string")]
S14_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({i + 1}, '{n}', '{t}', true, {str(n == 'c_custkey').lower()})" for i, (n, t) in enumerate(_PROFILE)) + \
    ") v(ordinal, column_name, data_type, is_nullable, is_key) CROSS JOIN (SELECT count(*) AS row_count FROM customer)"


@register("s14_table_profile", S14_SQL)
def s14(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return io.table_profile(t.customer, keys=["c_custkey"])


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@register("s8_csv_source", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def s8(spark, sf_dir):
    t = Tables(spark, sf_dir)
    path = _scratch(spark, "csv")
    t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice").write.option("header", "true").csv(path)
    return io.read_csv(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double")


@register("s9_append_sink", "SELECT * FROM orders")
def s9(spark, sf_dir):
    """Every status in an append of its own."""
    t = Tables(spark, sf_dir)
    path = _scratch(spark, "append")
    for which in ("o_orderstatus = 'F'", "o_orderstatus = 'O'", "coalesce(o_orderstatus NOT IN ('F', 'O'), true)"):
        io.write_table(t.orders.filter(which), path, "append")
    return spark.read.parquet(path)


@register("s9_append_sink_all", "SELECT * FROM orders")
def s9_all(spark, sf_dir):
    """Every row, in two appends."""
    t = Tables(spark, sf_dir)
    path = _scratch(spark, "append")
    for open_orders in (True, False):
        is_open = F.coalesce(F.col("o_orderstatus") == "O", F.lit(False))
        io.write_table(t.orders.filter(is_open if open_orders else ~is_open), path, "append")
    return spark.read.parquet(path)


@register("s10_replace_sink", "SELECT * FROM orders WHERE o_orderstatus = 'P'")
def s10(spark, sf_dir):
    t = Tables(spark, sf_dir)
    path = _scratch(spark, "replace")
    io.write_table(t.orders, path, "overwrite")
    io.write_table(t.orders.filter("o_orderstatus = 'P'"), path, "overwrite")
    return spark.read.parquet(path)


@register("s11_event_log_sink", with_ctes(
    "SELECT * REPLACE (CAST(event_date AS VARCHAR) AS event_date) FROM event_log "
    "WHERE event_date = DATE '2024-01-15'", "event_log"))
def s11(spark, sf_dir):
    t = Tables(spark, sf_dir)
    path = _scratch(spark, "eventlog")
    io.write_event_log(event_log(t.events), path)
    back = spark.read.parquet(path).filter(F.col("event_date") == F.lit("2024-01-15").cast("date"))
    return back.withColumn("event_date", F.col("event_date").cast("string"))   # dates shown as text


@register("s11_event_log_sink_all", with_ctes(
    "SELECT * REPLACE (CAST(event_date AS VARCHAR) AS event_date) FROM event_log", "event_log"))
def s11_all(spark, sf_dir):
    """Every day of the log, read back."""
    path = _scratch(spark, "eventlog")
    io.write_event_log(event_log(Tables(spark, sf_dir).events), path)
    return spark.read.parquet(path).withColumn("event_date", F.col("event_date").cast("string"))


@register("s12_latency_sink", with_ctes(
    "SELECT *, CAST(CAST(destination_insert_time AS DATE) AS VARCHAR) AS record_date FROM latency_metrics",
    "latency_metrics"))
def s12(spark, sf_dir):
    t = Tables(spark, sf_dir)
    path = _scratch(spark, "latency")
    io.write_latency(latency_metrics(t.events), path)
    return spark.read.parquet(path).withColumn("record_date", F.col("record_date").cast("string"))
