"""Checks for column mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeflow.catalog import register
from changeflow.operators import mapping as mp
from changeflow.operators.changes import apply_strict
from changeflow.operators.mapping import ColumnMap, TableMap
from changeflow.sources.fixtures import (Tables, base_state, change_feed, customer_dest,
                                         with_ctes)


@register("p1_direct_mapping", "SELECT c_custkey AS customer_id, c_name AS name FROM customer")
def p1(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return mp.apply_mapping(t.customer, [ColumnMap("customer_id", "c_custkey"),
                                         ColumnMap("name", "c_name")])


P2_SQL = """
SELECT l_orderkey, l_linenumber,
       l_extendedprice * (1 - l_discount) * (1 + l_tax) AS final_price
FROM lineitem
"""


@register("p2_expression_mapping", P2_SQL)
def p2(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return mp.apply_mapping(t.lineitem, [
        ColumnMap("l_orderkey", "l_orderkey"), ColumnMap("l_linenumber", "l_linenumber"),
        ColumnMap("final_price", kind="expression",
                  expression="l_extendedprice * (1 - l_discount) * (1 + l_tax)")])


P3_SQL = """
SELECT c_custkey, json_object('name', c_name, 'segment', c_mktsegment, 'nation', c_nationkey) AS profile
FROM (SELECT c_custkey, c_name, c_nationkey,
             CASE WHEN c_custkey % 10 = 5 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer)
"""


@register("p3_json_object", P3_SQL)
def p3(spark, sf_dir):
    t = Tables(spark, sf_dir)
    src = t.customer.withColumn(
        "c_mktsegment", F.when(F.col("c_custkey") % 10 == 5, F.lit(None)).otherwise(F.col("c_mktsegment")))
    return mp.apply_mapping(src, [
        ColumnMap("c_custkey", "c_custkey"),
        ColumnMap("profile", kind="json", sources=("c_name", "c_mktsegment", "c_nationkey"),
                  json_names=("name", "segment", "nation"))])


P4_SQL = "SELECT p_partkey, json_array(p_name, p_brand, p_type) AS tags FROM part"


@register("p4_json_array", P4_SQL)
def p4(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return mp.apply_mapping(t.part, [
        ColumnMap("p_partkey", "p_partkey"),
        ColumnMap("tags", kind="json_array", sources=("p_name", "p_brand", "p_type"))])


P5_SQL = with_ctes("""
SELECT c_custkey, concat(coalesce(c_name, ''), ' / ', coalesce(c_mktsegment, '')) AS label
FROM customer_dest
""", "customer_dest")


@register("p5_concat_keep_nulls", P5_SQL)
def p5(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return mp.apply_mapping(customer_dest(t.customer), [
        ColumnMap("c_custkey", "c_custkey"),
        ColumnMap("label", kind="concat", sources=("c_name", "c_mktsegment"), separator=" / ")])


P6_SQL = "SELECT p_partkey, p_name || ' (' || p_brand || ')' AS title FROM part"


@register("p6_template_expression", P6_SQL)
def p6(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return mp.apply_mapping(t.part, [
        ColumnMap("p_partkey", "p_partkey"),
        ColumnMap("title", kind="template", sources=("p_name", "p_brand"),
                  expression="{col1} || ' (' || {col2} || ')'")])


P7_SQL = with_ctes("""
SELECT c_custkey, coalesce(c_mktsegment, 'UNKNOWN') AS segment FROM customer_dest
""", "customer_dest")


@register("p7_default_value", P7_SQL)
def p7(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return mp.apply_mapping(customer_dest(t.customer), [
        ColumnMap("c_custkey", "c_custkey"),
        ColumnMap("segment", "c_mktsegment", default="'UNKNOWN'")])


# P8-P10 on a strict change fold: event_type is ignore-changes (taken from
# the inserting row or kept from the target, never from later updates)
P10_SQL = with_ctes("""
WITH ev AS (SELECT * FROM change_feed WHERE op_code IN (1, 2, 4)),
s1 AS (SELECT user_id, max(CASE WHEN op_code = 1 THEN lsn END) AS ld FROM ev GROUP BY user_id),
s2 AS (SELECT e.user_id, min(CASE WHEN e.op_code = 2 THEN e.lsn END) AS f1,
              max(CASE WHEN e.op_code = 4 THEN e.lsn END) AS lu
       FROM ev e JOIN s1 ON e.user_id = s1.user_id
       WHERE s1.ld IS NULL OR e.lsn > s1.ld GROUP BY e.user_id),
d AS (SELECT s1.user_id, s1.ld, s2.f1, s2.lu,
             (b.user_id IS NOT NULL AND s1.ld IS NULL) AS live0
      FROM s1 LEFT JOIN s2 ON s1.user_id = s2.user_id
      LEFT JOIN base_state b ON b.user_id = s1.user_id),
pick AS (SELECT user_id, live0, f1,
                CASE WHEN live0 THEN lu
                     WHEN f1 IS NOT NULL THEN CASE WHEN lu > f1 THEN lu ELSE f1 END END AS pos
         FROM d)
SELECT b.user_id, b.event_type, b.value FROM base_state b
WHERE NOT EXISTS (SELECT 1 FROM pick p WHERE p.user_id = b.user_id AND NOT (p.live0 AND p.pos IS NULL))
UNION ALL
SELECT p.user_id, b.event_type, e.value FROM pick p JOIN ev e ON e.user_id = p.user_id AND e.lsn = p.pos
JOIN base_state b ON b.user_id = p.user_id WHERE p.live0
UNION ALL
SELECT p.user_id, i.event_type, e.value FROM pick p JOIN ev e ON e.user_id = p.user_id AND e.lsn = p.pos
JOIN ev i ON i.user_id = p.user_id AND i.lsn = p.f1 WHERE NOT p.live0
""", "change_feed", "base_state")


@register("p10_ignore_changes_on_fold", P10_SQL)
def p10(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return apply_strict(base_state(t.events), change_feed(t.events), ["user_id"],
                        insert_only=["event_type"])


P11_SQL = "SELECT c_custkey AS C_CUSTKEY, c_name AS C_Name FROM customer"


@register("p11_align_to_schema", P11_SQL)
def p11(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return mp.align_to_schema(t.customer.select("c_custkey", "c_name", "c_acctbal"),
                              ["C_Name", "C_CUSTKEY", "missing_col"])


P12_SQL = "SELECT p_partkey, p_name, p_size FROM part"


@register("p12_column_selector", P12_SQL)
def p12(spark, sf_dir):
    t = Tables(spark, sf_dir)
    kept = mp.select_columns(t.part, exclude=["p_brand", "p_type"])
    return mp.select_columns(kept, include=["p_partkey", "p_name", "p_size"])


P13_SQL = "SELECT c_custkey, c_name FROM customer"


@register("p13_reverse_mapping", P13_SQL)
def p13(spark, sf_dir):
    t = Tables(spark, sf_dir)
    m = TableMap((ColumnMap("customer_id", "c_custkey"), ColumnMap("name", "c_name"),
                  ColumnMap("name_up", kind="expression", expression="upper(c_name)")))
    return mp.reverse_mapping(mp.apply_mapping(t.customer, m), m)


P14_SQL = with_ctes("SELECT user_id, event_type, value FROM change_feed", "change_feed")


@register("p14_strip_change_metadata", P14_SQL)
def p14(spark, sf_dir):
    t = Tables(spark, sf_dir)
    raw = change_feed(t.events).select(
        F.col("lsn").alias("__$start_lsn"), F.col("seqval").alias("__$seqval"),
        F.col("op_code").alias("__$operation"), "user_id", "event_type", "value",
        F.col("source_id").alias("_source_id"))
    return mp.strip_change_metadata(raw, drop_source_tags=True)


P17_SQL = """
SELECT c_custkey, concat_ws('|', CAST(c_custkey AS VARCHAR), CAST(c_nationkey AS VARCHAR)) AS record_id
FROM customer
"""


@register("p17_record_id", P17_SQL)
def p17(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return mp.with_record_id(t.customer, ["c_custkey", "c_nationkey"]).select("c_custkey", "record_id")
