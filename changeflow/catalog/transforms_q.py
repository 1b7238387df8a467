"""Checks for filters, routing, reshaping, windows and aggregations
(F1-F8, R1-R8, W1-W7, A1-A4, A13-A15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeflow.catalog import register
from changeflow.operators import transforms as tf
from changeflow.sources.fixtures import Tables

EV_ORDER = ["ts", "event_id"]


@register("f1_predicate_filter",
          "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000")
def f1(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tf.predicate_filter(t.orders, "o_orderstatus = 'O' AND o_totalprice > 100000") \
        .select("o_orderkey", "o_totalprice")


F2_SQL = """
SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate >= TIMESTAMP '2001-08-01 00:00:00' - INTERVAL '365' DAY
"""


@register("f2_relative_date_filter", F2_SQL)
def f2(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tf.relative_date_filter(t.orders, "o_orderdate", 365, "2001-08-01 00:00:00") \
        .select("o_orderkey", "o_orderdate")


F3_SQL = """
SELECT o_orderkey, 'high' AS route FROM orders WHERE coalesce(o_totalprice >= 150000, false)
UNION ALL
SELECT o_orderkey, 'normal' AS route FROM orders WHERE NOT coalesce(o_totalprice >= 150000, false)
"""


@register("f3_conditional_routing", F3_SQL)
def f3(spark, sf_dir):
    t = Tables(spark, sf_dir)
    hi, lo = tf.route(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice >= 150000")
    return hi.select("o_orderkey", F.lit("high").alias("route")) \
        .unionByName(lo.select("o_orderkey", F.lit("normal").alias("route")))


F4_SQL = """
SELECT a.o_orderstatus, a.orders, b.customers FROM
(SELECT o_orderstatus, count(*) AS orders FROM orders GROUP BY 1) a JOIN
(SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1) b
ON a.o_orderstatus = b.o_orderstatus
"""


@register("f4_fork_duplicate", F4_SQL)
def f4(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a, b = tf.fork(t.orders.select("o_orderstatus", "o_custkey"), 2)
    x = a.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))
    y = b.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"))
    return x.join(y, "o_orderstatus")


# which part a hash names is Spark's own; that the parts are disjoint and
# complete, and an equal key never parts, is not
@register("f5_fork_split", """
SELECT o_custkey, count(*) AS n_orders, CAST(1 AS BIGINT) AS n_parts FROM orders GROUP BY o_custkey
""")
def f5(spark, sf_dir):
    parts = tf.split_parts(Tables(spark, sf_dir).orders.select("o_custkey"), ["o_custkey"], 3, once=True)
    out = None
    for i, p in enumerate(parts):
        q = p.withColumn("part", F.lit(i))
        out = q if out is None else out.unionByName(q)
    return out.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.count_distinct("part").alias("n_parts"))


F7_SQL = """
SELECT event_id, user_id, event_type FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_type,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events) WHERE rn = 1 OR prev_type IS DISTINCT FROM event_type
"""


@register("f7_on_change_detector", F7_SQL)
def f7(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ev = t.events.select("event_id", "user_id", "event_type", "ts")
    return tf.on_change(ev, ["user_id"], EV_ORDER, ["event_type"]) \
        .select("event_id", "user_id", "event_type")


F8_SQL = """
SELECT l_orderkey, l_linenumber,
       concat_ws(',', CASE WHEN NOT coalesce(l_discount <= 0.08, false) THEN 'max_discount' END,
                      CASE WHEN NOT coalesce(l_quantity < 45, false) THEN 'max_quantity' END) AS errors
FROM lineitem
WHERE NOT coalesce(l_discount <= 0.08, false) OR NOT coalesce(l_quantity < 45, false)
"""


@register("f8_error_output", F8_SQL)
def f8(spark, sf_dir):
    t = Tables(spark, sf_dir)
    good, bad = tf.validate(t.lineitem.select("l_orderkey", "l_linenumber", "l_discount", "l_quantity"),
                            rules={"max_discount": "l_discount <= 0.08", "max_quantity": "l_quantity < 45"})
    return bad.select("l_orderkey", "l_linenumber", F.array_join("errors", ",").alias("errors"))


@register("f8_both_sides", """
SELECT l_orderkey, l_linenumber, coalesce(l_discount <= 0.08, false) AND coalesce(l_quantity < 45, false) AS good FROM lineitem
""")
def f8_both(spark, sf_dir):
    """Every row is on exactly one side."""
    rows = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_discount", "l_quantity")
    good, bad = tf.validate(rows, rules={"max_discount": "l_discount <= 0.08", "max_quantity": "l_quantity < 45"})
    return good.select("l_orderkey", "l_linenumber", F.lit(True).alias("good")).unionByName(
        bad.select("l_orderkey", "l_linenumber", F.lit(False).alias("good")))


R1_SQL = """
SELECT l_orderkey, l_linenumber, 'l_quantity' AS metric_name, l_quantity AS metric_value FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem
"""


@register("r1_unpivot", R1_SQL)
def r1(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tf.unpivot(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
R2_SQL = "SELECT user_id, " + ", ".join(
    f"max(CASE WHEN event_type = '{e}' THEN value END) AS {e}" for e in EVENT_TYPES) + \
    " FROM events GROUP BY user_id"


@register("r2_pivot", R2_SQL)
def r2(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tf.pivot(t.events, ["user_id"], "event_type", "value", EVENT_TYPES)


R3_SQL = """
SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'large' WHEN o_totalprice >= 100000 THEN 'medium'
                        ELSE 'small' END AS size_class FROM orders
"""


@register("r3_category_threshold", R3_SQL)
def r3(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.orders.select("o_orderkey", tf.categorize(
        "o_totalprice", [(300000, "large"), (100000, "medium")], "small").alias("size_class"))


R4_SQL = """
SELECT o_orderkey, extract(year FROM o_orderdate) AS year, extract(month FROM o_orderdate) AS month,
       extract(quarter FROM o_orderdate) AS quarter, date_trunc('month', o_orderdate) AS month_start
FROM orders
"""


@register("r4_date_parts", R4_SQL)
def r4(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tf.date_parts(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@register("r5_string_derivations",
          "SELECT c_custkey, upper(c_name) AS upper, CAST(length(c_name) AS BIGINT) AS length FROM customer")
def r5(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tf.string_parts(t.customer.select("c_custkey", "c_name"), "c_name").drop("c_name")


R6_SQL = """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN 'closed_big'
                        WHEN o_orderstatus = 'F' THEN 'closed'
                        WHEN o_orderpriority LIKE '1%' THEN 'urgent'
                        ELSE 'open' END AS status_label FROM orders
"""


@register("r6_status_logic", R6_SQL)
def r6(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.orders.select("o_orderkey", tf.status_logic([
        ("o_orderstatus = 'F' AND o_totalprice > 200000", "closed_big"),
        ("o_orderstatus = 'F'", "closed"),
        ("o_orderpriority LIKE '1%'", "urgent")], "open").alias("status_label"))


# the time itself is not known beforehand; that every row has it, and the same, is
@register("r7_processing_stamp", """
SELECT count(*) AS n_rows, CAST(1 AS BIGINT) AS n_stamps, count(*) AS n_recent FROM customer
""")
def r7(spark, sf_dir):
    stamped = tf.processing_stamp(Tables(spark, sf_dir).customer.select("c_custkey"))
    recent = F.abs(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("processed_at")) < 3600
    return stamped.agg(F.count("c_custkey").alias("n_rows"), F.count_distinct("processed_at").alias("n_stamps"),
                       F.count(F.when(recent, 1)).alias("n_recent"))


R8_SQL = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1
"""


@register("r8_parameterised_script", R8_SQL)
def r8(spark, sf_dir):
    t = Tables(spark, sf_dir)
    t.events.createOrReplaceTempView("events_src")
    return tf.run_script(spark, [
        ("ranked", "SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts DESC, event_id DESC) AS rn "
                   "FROM {source_table}"),
        ("deduped", "SELECT * EXCEPT (rn) FROM ranked WHERE rn = :keep")],
        variables={"source_table": "events_src", "key": "user_id"}, params={"keep": 1})


# ------------------------------------------------------------------ W1 - W7

W1_SQL = """
SELECT user_id, event_id, ts, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1
"""


@register("w1_keep_newest_per_key", W1_SQL)
def w1(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tf.keep_latest(t.events.select("user_id", "event_id", "ts", "event_type", "value"),
                          ["user_id"], EV_ORDER)


@register("w2_keep_first_per_key", W1_SQL.replace("ts DESC, event_id DESC", "ts, event_id"))
def w2(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tf.keep_latest(t.events.select("user_id", "event_id", "ts", "event_type", "value"),
                          ["user_id"], EV_ORDER, first=True)


@register("w3_drop_exact_duplicates", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def w3(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tf.drop_exact_duplicates(t.orders.select("o_custkey", "o_orderstatus"))


W4_SQL = """
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events
"""


@register("w4_row_number", W4_SQL)
def w4(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tf.with_row_number(t.events.select("event_id", "user_id", "ts"), ["user_id"], EV_ORDER) \
        .select("event_id", "user_id", "rn")


W5_SQL = """
SELECT event_id, user_id, rank() OVER (PARTITION BY user_id ORDER BY value) AS rnk FROM events
"""


@register("w5_rank", W5_SQL)
def w5(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tf.with_rank(t.events.select("event_id", "user_id", "value"), ["user_id"], ["value"]) \
        .select("event_id", "user_id", "rnk")


W6_SQL = """
SELECT event_id, user_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_value,
       lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_event_type FROM events
"""


@register("w6_lag", W6_SQL)
def w6(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tf.with_lag(t.events, ["user_id"], EV_ORDER, ["value", "event_type"]) \
        .select("event_id", "user_id", "prev_value", "prev_event_type")


W7_SQL = """
SELECT event_id, user_id, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_value,
       lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM events
"""


@register("w7_lead", W7_SQL)
def w7(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tf.with_lead(t.events, ["user_id"], EV_ORDER, ["value", "ts"]) \
        .select("event_id", "user_id", "next_value", "next_ts")

# null keys, null order values and repeated order values
SPARSE_SQL = """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS k,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 11 END AS p, event_type, value FROM events
"""


def sparse_events(t):
    e = F.col("event_id")
    return t.events.select("event_id", F.when(e % 7 != 0, F.col("user_id")).alias("k"),
                           F.when(e % 5 != 0, e % 11).alias("p"), "event_type", "value")


def w_nulls(columns: str) -> str:
    return f"SELECT * FROM (WITH s AS ({SPARSE_SQL}) SELECT event_id, k, {columns} FROM s)"


@register("w4_row_number_nulls", w_nulls("""row_number() OVER (PARTITION BY k ORDER BY p, event_id) AS rn,
   row_number() OVER (PARTITION BY k ORDER BY p DESC, event_id DESC) AS rn_desc,
   row_number() OVER (ORDER BY event_id) AS rn_all"""))
def w4_nulls(spark, sf_dir):
    df = tf.with_row_number(sparse_events(Tables(spark, sf_dir)), ["k"], ["p", "event_id"])
    df = tf.with_row_number(df, ["k"], ["p", "event_id"], "rn_desc", descending=True)
    return tf.with_row_number(df, [], ["event_id"], "rn_all").select("event_id", "k", "rn", "rn_desc", "rn_all")


@register("w5_rank_nulls", w_nulls("""rank() OVER (PARTITION BY k ORDER BY p) AS rnk,
   rank() OVER (PARTITION BY k ORDER BY p DESC) AS rnk_desc"""))
def w5_nulls(spark, sf_dir):
    df = tf.with_rank(sparse_events(Tables(spark, sf_dir)), ["k"], ["p"])
    return tf.with_rank(df, ["k"], ["p"], "rnk_desc", descending=True).select("event_id", "k", "rnk", "rnk_desc")


@register("w6_lag_nulls", w_nulls("""lag(value) OVER (PARTITION BY k ORDER BY p, event_id) AS prev_value,
   lag(event_type) OVER (PARTITION BY k ORDER BY p DESC, event_id DESC) AS desc_event_type"""))
def w6_nulls(spark, sf_dir):
    df = tf.with_lag(sparse_events(Tables(spark, sf_dir)), ["k"], ["p", "event_id"], ["value"])
    return tf.with_lag(df, ["k"], ["p", "event_id"], ["event_type"], "desc_", descending=True) \
        .select("event_id", "k", "prev_value", "desc_event_type")


@register("w7_lead_nulls", w_nulls("""lead(value) OVER (PARTITION BY k ORDER BY p, event_id) AS next_value,
   lead(event_id) OVER (ORDER BY event_id) AS next_event_id"""))
def w7_nulls(spark, sf_dir):
    df = tf.with_lead(sparse_events(Tables(spark, sf_dir)), ["k"], ["p", "event_id"], ["value"])
    return tf.with_lead(df, [], ["event_id"], ["event_id"]).select("event_id", "k", "next_value", "next_event_id")


@register("f7_on_change_nulls", f"""
SELECT event_id, k, event_type FROM (WITH s AS ({SPARSE_SQL})
  SELECT *, lag(event_type) OVER w AS prev_type, row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY k ORDER BY p, event_id))
WHERE rn = 1 OR prev_type IS DISTINCT FROM event_type
""")
def f7_nulls(spark, sf_dir):
    return tf.on_change(sparse_events(Tables(spark, sf_dir)), ["k"], ["p", "event_id"], ["event_type"]) \
        .select("event_id", "k", "event_type")


@register("f7_on_change_binary", F7_SQL)
def f7_binary(spark, sf_dir):
    """F7 over 10-byte positions: the timestamp's microseconds and the id."""
    t = Tables(spark, sf_dir)
    ev = t.events.withColumn("pos", F.unhex(F.concat(F.lpad(F.hex(F.unix_micros(F.col("ts").cast("timestamp"))), 14, "0"),
                                                     F.lpad(F.hex("event_id"), 6, "0"))))
    return tf.on_change(ev, ["user_id"], ["pos"], ["event_type"]).select("event_id", "user_id", "event_type")


# ------------------------------------------------------------------ A1 - A4, A13 - A15

A1_SQL = """
SELECT l_returnflag, l_linestatus, count(*) AS row_count,
       CAST(sum(CAST(l_quantity AS DECIMAL(38,6))) AS DOUBLE) AS sum_l_quantity,
       CAST(sum(CAST(l_quantity AS DECIMAL(38,6))) AS DOUBLE) / count(l_quantity) AS avg_l_quantity,
       min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity,
       count(DISTINCT l_orderkey) AS distinct_l_orderkey
FROM lineitem GROUP BY l_returnflag, l_linestatus
"""


@register("a1_group_summary", A1_SQL)
def a1(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tf.group_summary(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity",
                            distinct="l_orderkey")


A2_SQL = """
SELECT o_orderstatus, count(*) AS row_count,
       CAST(sum(CAST(o_totalprice AS DECIMAL(38,6))) AS DOUBLE) AS sum_o_totalprice,
       CAST(sum(CAST(o_totalprice AS DECIMAL(38,6))) AS DOUBLE) / count(o_totalprice) AS avg_o_totalprice,
       min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice,
       count(DISTINCT o_custkey) AS distinct_o_custkey
FROM orders GROUP BY o_orderstatus
"""


@register("a2_distinct_count", A2_SQL)
def a2(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tf.group_summary(t.orders, ["o_orderstatus"], "o_totalprice", distinct="o_custkey")


A3_SQL = """
SELECT date_trunc('month', o_orderdate) AS period, o_orderstatus, count(*) AS row_count,
       CAST(sum(CAST(o_totalprice AS DECIMAL(38,6))) AS DOUBLE) AS total
FROM orders GROUP BY 1, 2
"""


@register("a3_period_summary", A3_SQL)
def a3(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tf.period_summary(t.orders, "o_orderdate", "month", ["o_orderstatus"], "o_totalprice")


A4_SQL = """
SELECT o_custkey, count(*) AS order_count, total_value,
       CASE WHEN total_value >= 2000000 THEN 'platinum' WHEN total_value >= 1000000 THEN 'gold'
            ELSE 'standard' END AS tier,
       date_diff('day', CAST(first_ts AS DATE), CAST(last_ts AS DATE)) AS span_days
FROM (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(38,6))) AS DOUBLE) AS total_value,
             min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts FROM orders GROUP BY o_custkey) s
JOIN orders o USING (o_custkey)
GROUP BY o_custkey, total_value, first_ts, last_ts
"""


@register("a4_customer_value_tier", A4_SQL)
def a4(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tf.value_tiers(t.orders, "o_custkey", "o_totalprice", "o_orderdate",
                          [(2000000, "platinum"), (1000000, "gold")], "standard")


A13_SQL = """
SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS c_mktsegment_list
FROM customer GROUP BY c_nationkey
"""


@register("a13_string_aggregate", A13_SQL)
def a13(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tf.string_agg(t.customer, ["c_nationkey"], "c_mktsegment", distinct=True)


A14_SQL = """
SELECT c_nationkey, CAST(list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS VARCHAR) AS c_mktsegment_array
FROM customer GROUP BY c_nationkey
"""


@register("a14_array_aggregate", A14_SQL)
def a14(spark, sf_dir):
    """Array result, shown as text for the comparison."""
    t = Tables(spark, sf_dir)
    out = tf.array_agg(t.customer, ["c_nationkey"], "c_mktsegment", distinct=True)
    return out.select("c_nationkey", F.col("c_mktsegment_array").cast("string").alias("c_mktsegment_array"))


A15_SQL = """
SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS median_l_quantity FROM lineitem GROUP BY l_returnflag
"""


@register("a15_median", A15_SQL)
def a15(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return tf.median(t.lineitem, ["l_returnflag"], "l_quantity")


A13_ALL_SQL = """
SELECT c_nationkey, string_agg(c_mktsegment, ',' ORDER BY c_mktsegment) AS c_mktsegment_list
FROM customer GROUP BY c_nationkey
"""


@register("a13_string_aggregate_all", A13_ALL_SQL)
def a13_all(spark, sf_dir):
    return tf.string_agg(Tables(spark, sf_dir).customer, ["c_nationkey"], "c_mktsegment")


A14_ALL_SQL = """
SELECT c_nationkey, CAST(list(c_mktsegment ORDER BY c_mktsegment) AS VARCHAR) AS c_mktsegment_array
FROM customer GROUP BY c_nationkey
"""


@register("a14_array_aggregate_all", A14_ALL_SQL)
def a14_all(spark, sf_dir):
    """Duplicates kept; array result, shown as text for the comparison."""
    out = tf.array_agg(Tables(spark, sf_dir).customer, ["c_nationkey"], "c_mktsegment")
    return out.select("c_nationkey", F.col("c_mktsegment_array").cast("string").alias("c_mktsegment_array"))


# several percentiles of doubles, all exact
@register("a15_percentiles", """
SELECT o_orderstatus, quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.9) AS p90,
       quantile_cont(o_totalprice, 0.99) AS p99 FROM orders GROUP BY o_orderstatus
""")
def a15_percentiles(spark, sf_dir):
    return tf.exact_percentiles(Tables(spark, sf_dir).orders, ["o_orderstatus"], "o_totalprice",
                                {"p50": 0.5, "p90": 0.9, "p99": 0.99})


# parts by key modulo, every row in exactly one part
F5_SQL = "SELECT o_orderkey, o_orderkey % 3 AS part FROM orders"


@register("f5_fork_split_modulo", F5_SQL)
def f5_modulo(spark, sf_dir):
    parts = tf.split_parts(Tables(spark, sf_dir).orders.select("o_orderkey"), ["o_orderkey"], 3, by="modulo")
    out = None
    for i, p in enumerate(parts):
        q = p.select("o_orderkey", F.lit(i).cast("long").alias("part"))
        out = q if out is None else out.unionByName(q)
    return out


# scalar functions of the expression text: SUBSTRING, JSON_EXTRACT, UNNEST, LIST_VALUE, ISNULL
@register("fn_text_and_arrays", """
SELECT o_orderkey, tag, substring(o_orderstatus || '-' || o_orderkey, 3, 4) AS part,
       json_extract_string('{"k":"' || o_orderstatus || '"}', '$.k') AS js,
       coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END, -1) AS cust
FROM (SELECT *, unnest(list_value(o_orderstatus, 'x')) AS tag FROM orders)
""")
def fn_text(spark, sf_dir):
    return Tables(spark, sf_dir).orders.withColumn("tag", F.expr("explode(array(o_orderstatus, 'x'))")).selectExpr(
        "o_orderkey", "tag", "substring(concat(o_orderstatus, '-', o_orderkey), 3, 4) AS part",
        "get_json_object(concat('{\"k\":\"', o_orderstatus, '\"}'), '$.k') AS js",
        "coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END, -1) AS cust")
