"""Checks for load modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeflow.catalog import register
from changeflow.operators import load as ld
from changeflow.operators.mapping import ColumnMap, TableMap, apply_mapping
from changeflow.sources.fixtures import Tables, orders_delta, with_ctes

ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]

C3_SQL = with_ctes("""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders_delta WHERE o_orderkey IS NOT NULL)
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders_delta
""", "orders_delta")


@register("c3_upsert", C3_SQL)
def c3_upsert(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ld.upsert(t.orders.select(*ORDER_COLS), orders_delta(t.orders), ["o_orderkey"],
                     order=["o_totalprice"])


C4_SQL = with_ctes("""
SELECT count(*) FILTER (WHERE o.o_orderkey IS NULL) AS inserted,
       count(*) FILTER (WHERE o.o_orderkey IS NOT NULL) AS updated
FROM orders_delta d LEFT JOIN orders o ON o.o_orderkey = d.o_orderkey
""", "orders_delta")


@register("c4_upsert_counters", C4_SQL)
def c4_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    acts = ld.upsert_actions(t.orders.select(*ORDER_COLS), orders_delta(t.orders), ["o_orderkey"],
                             order=["o_totalprice"])
    return ld.upsert_counts(acts)


# C3 with column controls: o_orderstatus is ignore-changes (kept on update),
# a generated load tag is written on insert only
C3B_SQL = with_ctes("""
SELECT o.o_orderkey, d.o_custkey, o.o_orderstatus, d.o_totalprice, 'initial' AS load_tag
FROM orders o JOIN orders_delta d ON o.o_orderkey = d.o_orderkey
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 'initial' AS load_tag FROM orders
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders_delta)
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 'delta' AS load_tag FROM orders_delta
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)
""", "orders_delta")


@register("c3_upsert_column_controls", C3B_SQL)
def c3_controls(spark, sf_dir):
    """P8 + P10 on the insert / update branches of an upsert."""
    t = Tables(spark, sf_dir)
    target = t.orders.select(*ORDER_COLS, F.lit("initial").alias("load_tag"))
    return ld.upsert(target, orders_delta(t.orders), ["o_orderkey"], order=["o_totalprice"],
                     insert_only=["o_orderstatus", "load_tag"], generated={"load_tag": "'delta'"})


C1_SQL = """
SELECT c_custkey AS customer_id, upper(c_name) AS customer_name, c_nationkey AS nation_id FROM customer
"""

CUSTOMER_MAP = TableMap(columns=(
    ColumnMap("customer_id", "c_custkey"),
    ColumnMap("customer_name", kind="expression", expression="upper(c_name)"),
    ColumnMap("nation_id", "c_nationkey"),
), keys=("customer_id",))


@register("c1_full_load", C1_SQL)
def c1_full(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ld.load(None, apply_mapping(t.customer, CUSTOMER_MAP), "full")


C2_SQL = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'
"""


@register("c2_append_load", C2_SQL)
def c2_append(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t.orders.select(*ORDER_COLS)
    return ld.load(o, o.filter(F.col("o_orderstatus") == "F"), "append")


C2_ALL_SQL = "SELECT * FROM (SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT o_orderkey, o_custkey FROM orders)"


@register("c2_append_load_all", C2_ALL_SQL)
def c2_append_all(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey")
    return ld.load(o, o, "append")


C5_SQL = """
SELECT c_custkey AS customer_id, upper(c_name) AS customer_name, c_nationkey AS nation_id,
       (SELECT max(event_id) FROM events) AS snapshot_lsn
FROM customer
"""


@register("c5_initial_snapshot", C5_SQL)
def c5_snapshot(spark, sf_dir):
    """Snapshot rows tagged with the feed position taken before the copy."""
    from changeflow.sources.fixtures import change_feed
    t = Tables(spark, sf_dir)
    snap, mark = ld.initial_snapshot(t.customer, CUSTOMER_MAP, change_feed(t.events))
    return snap.withColumn("snapshot_lsn", F.lit(mark))


C18_SQL = """
SELECT c_custkey AS customer_id, upper(c_name) AS customer_name, c_nationkey AS nation_id FROM customer
WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL
SELECT s_suppkey AS customer_id, upper(s_name) AS customer_name, s_nationkey AS nation_id FROM supplier
"""


@register("c18_grouped_run", C18_SQL)
def c18_grouped(spark, sf_dir):
    """Two mappings into one destination (full, then upsert), one result per
    destination; a disabled third mapping is skipped."""
    t = Tables(spark, sf_dir)
    sup_map = TableMap(columns=(
        ColumnMap("customer_id", "s_suppkey"),
        ColumnMap("customer_name", kind="expression", expression="upper(s_name)"),
        ColumnMap("nation_id", "s_nationkey"),
    ), keys=("customer_id",))
    runs = [
        ld.MappingRun("cust", t.customer, CUSTOMER_MAP, "dim_party", "full"),
        ld.MappingRun("supp", t.supplier, sup_map, "dim_party", "upsert", order=("s_suppkey",)),
        ld.MappingRun("off", t.orders, CUSTOMER_MAP, "dim_party", "append", enabled=False),
    ]
    return ld.grouped_run(runs)["dim_party"]


# P8 through the mapping spec: a column generated on insert only
P8_SQL = with_ctes("""
SELECT d.o_orderkey, d.o_custkey, d.o_orderstatus, d.o_totalprice,
       CASE WHEN o.o_orderkey IS NULL THEN 'delta' ELSE 'initial' END AS load_tag
FROM orders_delta d LEFT JOIN orders o ON o.o_orderkey = d.o_orderkey
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 'initial' AS load_tag FROM orders
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders_delta)
""", "orders_delta")


@register("p8_generate_on_insert", P8_SQL)
def p8(spark, sf_dir):
    t = Tables(spark, sf_dir)
    m = TableMap(columns=tuple(ColumnMap(c, c) for c in ORDER_COLS)
                 + (ColumnMap("load_tag", on_insert="'delta'"),), keys=("o_orderkey",))
    target = t.orders.select(*ORDER_COLS, F.lit("initial").alias("load_tag"))
    mapped = apply_mapping(orders_delta(t.orders), m)
    gen = {c.target: c.generated for c in m.columns if c.generated}
    return ld.upsert(target, mapped, m.keys, ["o_totalprice"], insert_only=m.insert_only_columns, generated=gen)


# P8 where a source column is mapped to the generated one: its value is
# ignored, and the column is insert-only without being listed
@register("p8_generated_over_source", P8_SQL)
def p8_source(spark, sf_dir):
    t = Tables(spark, sf_dir)
    m = TableMap(columns=tuple(ColumnMap(c, c) for c in ORDER_COLS)
                 + (ColumnMap("load_tag", "o_orderstatus", on_insert="'delta'"),), keys=("o_orderkey",))
    target = t.orders.select(*ORDER_COLS, F.lit("initial").alias("load_tag"))
    return ld.upsert(target, apply_mapping(orders_delta(t.orders), m), m.keys, ["o_totalprice"], generated={"load_tag": "'delta'"})


# P8 with a sequence generator: new rows continue the target's row numbers
P8S_SQL = with_ctes("""
WITH t AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderkey * 10 AS row_no FROM orders)
SELECT d.o_orderkey, d.o_custkey, d.o_orderstatus, d.o_totalprice, t.row_no
FROM orders_delta d JOIN t ON t.o_orderkey = d.o_orderkey
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, row_no FROM t
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders_delta)
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       (SELECT max(row_no) FROM t) + row_number() OVER (ORDER BY o_orderkey) AS row_no
FROM orders_delta WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)
""", "orders_delta")


@register("p8_sequence_on_insert", P8S_SQL)
def p8s(spark, sf_dir):
    t = Tables(spark, sf_dir)
    target = t.orders.select(*ORDER_COLS, (F.col("o_orderkey") * 10).alias("row_no"))
    return ld.upsert(target, orders_delta(t.orders), ["o_orderkey"], order=["o_totalprice"], generated={"row_no": ld.SEQUENCE})
