"""Derived inputs built from the shared test tables.

Each derived input exists twice: as a DataFrame function (what the Spark
queries read) and as SQL text (what a SQL engine inlines as a CTE to check the
Spark result).  Both are written from the same definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Tables:
    """Lazy accessor: ``Tables(spark, dir).orders`` reads orders.parquet."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return table(self.spark, self.sf_dir, name)


# ------------------------------------------------------------------ DataFrames

def change_feed(events: DataFrame) -> DataFrame:
    """insert = signup, delete = error, update (after image) = the rest."""
    et = F.col("event_type")
    return events.select(
        F.col("event_id").alias("lsn"),
        F.lit(0).alias("seqval"),
        F.when(et == "signup", 2).when(et == "error", 1).otherwise(4).alias("op_code"),
        "user_id", "event_type", "value",
        F.col("ts").alias("change_time"),
        F.when(F.col("event_id") % 3 == 0, "src_erp").otherwise("src_crm").alias("source_id"),
    )


def base_state(events: DataFrame) -> DataFrame:
    """Target before the feed: some fed keys plus keys the feed never touches."""
    users = events.select("user_id").distinct()
    fed = users.filter(F.col("user_id") % 3 == 0).select(
        "user_id", F.lit("seed").alias("event_type"), F.lit(0.0).alias("value"))
    untouched = users.filter(F.col("user_id") % 5 == 0).select(
        (F.col("user_id") + 1000000).alias("user_id"), F.lit("seed").alias("event_type"),
        F.lit(1.0).alias("value"))
    return fed.unionByName(untouched)


def customer_dest(customer: DataFrame) -> DataFrame:
    """Perturbed copy of customer: case, spaces, diacritics, changed value,
    null, missing and extra keys."""
    k = F.col("c_custkey")
    name = (F.when(k % 10 == 1, F.upper("c_name"))
             .when(k % 10 == 2, F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")))
             .when(k % 10 == 3, F.replace(F.col("c_name"), F.lit("u"), F.lit("ü")))
             .otherwise(F.col("c_name")))
    changed = customer.filter(k % 97 != 5).select(
        "c_custkey", name.alias("c_name"), "c_nationkey",
        F.when(k % 10 == 4, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(k % 10 == 5, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    extra = customer.filter(k % 89 == 0).select(
        (k + 10000000).alias("c_custkey"), "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return changed.unionByName(extra)


def orders_delta(orders: DataFrame) -> DataFrame:
    """Upsert source: changed existing keys and new keys."""
    k = F.col("o_orderkey")
    changed = orders.filter(k % 7 == 0).select(
        "o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_totalprice") + 1).alias("o_totalprice"))
    new = orders.filter(k % 11 == 0).select(
        (k + 10000000).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"), "o_totalprice")
    return changed.unionByName(new)


def latency_metrics(events: DataFrame) -> DataFrame:
    """Latency records: inserts and updates only."""
    return events.filter(F.col("event_type") != "error").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("map_"), (F.col("user_id") % 3).cast("string")).alias("mapping_id"),
        F.when(F.col("event_type") == "signup", "INSERT").otherwise("UPDATE").alias("operation_type"),
        F.col("ts").alias("destination_insert_time"),
        ((F.col("event_id") * 37) % 1000).alias("latency_ms"),
    )


def event_log(events: DataFrame) -> DataFrame:
    et = F.col("event_type")
    return events.select(
        "event_id",
        F.col("ts").alias("logged_at"),
        F.col("ts").cast("date").alias("event_date"),
        F.concat(F.lit("dbo.t"), (F.col("user_id") % 4).cast("string")).alias("source_table"),
        F.when(et == "signup", "INSERT").when(et == "error", "DELETE").otherwise("UPDATE").alias("operation"),
        F.when(F.col("event_id") % 10 == 0, "failed").otherwise("processed").alias("status"),
    )


# ------------------------------------------------------------------ SQL texts

SQL = {
    "change_feed": """
SELECT event_id AS lsn, 0 AS seqval,
       CASE event_type WHEN 'signup' THEN 2 WHEN 'error' THEN 1 ELSE 4 END AS op_code,
       user_id, event_type, value, ts AS change_time,
       CASE WHEN event_id % 3 = 0 THEN 'src_erp' ELSE 'src_crm' END AS source_id
FROM events""",
    "base_state": """
SELECT user_id, 'seed' AS event_type, CAST(0 AS DOUBLE) AS value
FROM (SELECT DISTINCT user_id FROM events) u WHERE user_id % 3 = 0
UNION ALL
SELECT user_id + 1000000 AS user_id, 'seed' AS event_type, CAST(1 AS DOUBLE) AS value
FROM (SELECT DISTINCT user_id FROM events) u WHERE user_id % 5 = 0""",
    "customer_dest": """
SELECT c_custkey,
       CASE WHEN c_custkey % 10 = 1 THEN upper(c_name)
            WHEN c_custkey % 10 = 2 THEN concat('  ', c_name, ' ')
            WHEN c_custkey % 10 = 3 THEN replace(c_name, 'u', 'ü')
            ELSE c_name END AS c_name,
       c_nationkey,
       CASE WHEN c_custkey % 10 = 4 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
       CASE WHEN c_custkey % 10 = 5 THEN NULL ELSE c_mktsegment END AS c_mktsegment
FROM customer WHERE c_custkey % 97 <> 5
UNION ALL
SELECT c_custkey + 10000000, c_name, c_nationkey, c_acctbal, c_mktsegment
FROM customer WHERE c_custkey % 89 = 0""",
    "orders_delta": """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice
FROM orders WHERE o_orderkey % 7 = 0
UNION ALL
SELECT o_orderkey + 10000000, o_custkey, 'N' AS o_orderstatus, o_totalprice
FROM orders WHERE o_orderkey % 11 = 0""",
    "latency_metrics": """
SELECT event_id AS id, concat('map_', CAST(user_id % 3 AS VARCHAR(10))) AS mapping_id,
       CASE event_type WHEN 'signup' THEN 'INSERT' ELSE 'UPDATE' END AS operation_type,
       ts AS destination_insert_time, (event_id * 37) % 1000 AS latency_ms
FROM events WHERE event_type <> 'error'""",
    "event_log": """
SELECT event_id, ts AS logged_at, CAST(ts AS DATE) AS event_date,
       concat('dbo.t', CAST(user_id % 4 AS VARCHAR(10))) AS source_table,
       CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS operation,
       CASE WHEN event_id % 10 = 0 THEN 'failed' ELSE 'processed' END AS status
FROM events""",
}


def with_ctes(body: str, *names: str) -> str:
    """Prefix ``body`` with the named derived inputs as CTEs."""
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({SQL[n].strip()})" for n in names)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
