"""Checks for reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeflow.catalog import register
from changeflow.operators import digests as dg
from changeflow.operators import reconcile as rc
from changeflow.operators.mapping import ColumnMap, TableMap, apply_mapping
from changeflow.sources.fixtures import Tables, customer_dest, with_ctes

CUST_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]

A5_SQL = with_ctes("""
SELECT s.source_count, d.destination_count, s.source_count = d.destination_count AS counts_match
FROM (SELECT count(*) AS source_count FROM customer) s CROSS JOIN
     (SELECT count(*) AS destination_count FROM customer_dest) d
""", "customer_dest")


@register("a5_row_count_compare", A5_SQL)
def a5(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rc.row_count_compare(t.customer, customer_dest(t.customer))


J9_SQL = with_ctes("""
SELECT (SELECT count(*) FROM customer c WHERE c.c_custkey IS NULL OR NOT EXISTS
          (SELECT 1 FROM customer_dest d WHERE d.c_custkey = c.c_custkey)) AS missing_in_destination,
       (SELECT count(*) FROM customer_dest d WHERE d.c_custkey IS NULL OR NOT EXISTS
          (SELECT 1 FROM customer c WHERE d.c_custkey = c.c_custkey)) AS missing_in_source
""", "customer_dest")


@register("j9_missing_both_ways", J9_SQL)
def j9(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rc.missing_both_ways(t.customer, customer_dest(t.customer), ["c_custkey"])


Q1_SQL = with_ctes("""
WITH c AS (SELECT
  (SELECT count(*) FROM customer) AS source_count,
  (SELECT count(*) FROM customer_dest) AS destination_count,
  (SELECT count(*) FROM customer c WHERE NOT EXISTS
     (SELECT 1 FROM customer_dest d WHERE d.c_custkey = c.c_custkey)) AS missing_in_destination,
  (SELECT count(*) FROM customer_dest d WHERE NOT EXISTS
     (SELECT 1 FROM customer c WHERE d.c_custkey = c.c_custkey)) AS missing_in_source)
SELECT source_count, destination_count, source_count = destination_count AS counts_match,
       missing_in_destination, missing_in_source,
       source_count = destination_count AND missing_in_destination = 0 AND missing_in_source = 0 AS tables_match
FROM c
""", "customer_dest")


@register("q1_table_compare", Q1_SQL)
def q1(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rc.table_compare(t.customer, customer_dest(t.customer), ["c_custkey"])


J10_SQL = with_ctes("""
SELECT d.c_custkey, d.c_custkey IN (SELECT c_custkey FROM customer) AS "exists" FROM customer_dest d
""", "customer_dest")


@register("j10_key_exists_probe", J10_SQL)
def j10(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rc.key_exists(customer_dest(t.customer).select("c_custkey"), t.customer, ["c_custkey"])


J11_SQL = with_ctes("""
SELECT o.o_orderkey, o.o_custkey, f.c_name AS dst_c_name, f.c_acctbal AS dst_c_acctbal
FROM orders o LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY c_name, c_acctbal) AS rn
                 FROM customer_dest) WHERE rn = 1) f
ON o.o_custkey = f.c_custkey
""", "customer_dest")


@register("j11_record_lookup", J11_SQL)
def j11(spark, sf_dir):
    """Look up each order's customer in the perturbed copy (first row by
    name, balance)."""
    t = Tables(spark, sf_dir)
    sample = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    dest = customer_dest(t.customer).select("c_custkey", "c_name", "c_acctbal")
    out = rc.record_lookup(sample, dest, ["c_custkey"], ["c_name", "c_acctbal"])
    return out.select("o_orderkey", F.col("c_custkey").alias("o_custkey"), "dst_c_name", "dst_c_acctbal")


T6_SQL = """
SELECT c_custkey, c_name FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 100
"""


@register("t6_random_sample", T6_SQL)
def t6(spark, sf_dir):
    """Repeatable sample of 100 rows (a sampling operator: the limit is the feature)."""
    t = Tables(spark, sf_dir)
    return rc.sample_rows(t.customer.select("c_custkey", "c_name"), 100, "hash", ["c_custkey"])


def _trim_text(x):
    return f"regexp_replace(CAST({x} AS VARCHAR), '^\\s+|\\s+$', '', 'g')"


_DIFF_COLS = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_DIFF_LIST = "concat_ws(',', " + ", ".join(
    f"CASE WHEN {_trim_text('s.' + c)} IS DISTINCT FROM {_trim_text('d.' + c)} THEN '{c}' END"
    for c in _DIFF_COLS) + ")"

Q3_SQL = with_ctes(f"""
SELECT coalesce(s.c_custkey, d.c_custkey) AS c_custkey,
       CASE WHEN s.c_custkey IS NULL THEN 'missing_in_source'
            WHEN d.c_custkey IS NULL THEN 'missing_in_destination'
            WHEN {_DIFF_LIST} = '' THEN 'matched' ELSE 'different' END AS status,
       CASE WHEN s.c_custkey IS NOT NULL AND d.c_custkey IS NOT NULL THEN {_DIFF_LIST} END AS differences
FROM customer s FULL JOIN customer_dest d ON s.c_custkey = d.c_custkey
""", "customer_dest")


def _diff_text(df):
    return df.withColumn("differences", F.array_join(F.transform("differences", lambda x: x["column"]), ","))


@register("q3_full_verification", Q3_SQL)
def q3(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return _diff_text(rc.verify_rows(t.customer.select(*CUST_COLS), customer_dest(t.customer), ["c_custkey"]))


@register("q3_verification_by_digests", f"SELECT * FROM ({Q3_SQL}) WHERE status <> 'matched'")
def q3_digests(spark, sf_dir):
    """The same without the matched rows, whose buckets are not shuffled."""
    t = Tables(spark, sf_dir)
    return _diff_text(dg.verify_by_digests(t.customer.select(*CUST_COLS), customer_dest(t.customer), ["c_custkey"], leaf_rows=50))


Q1D_SQL = with_ctes("""
SELECT 'copy' AS destination, true AS agrees UNION ALL
SELECT 'perturbed', NOT EXISTS (SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer EXCEPT ALL
                                SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer_dest)
""", "customer_dest")


@register("q1_tables_agree_by_digests", Q1D_SQL)
def q1_digests(spark, sf_dir):
    t = Tables(spark, sf_dir)
    source = t.customer.select(*CUST_COLS)
    dealt = source.repartition(7)
    found = [("copy", dg.tables_agree(source, dealt, ["c_custkey"])),
             ("perturbed", dg.tables_agree(source, customer_dest(t.customer).select(*CUST_COLS), ["c_custkey"]))]
    return spark.createDataFrame(found, "destination string, agrees boolean")


Q4_SQL = with_ctes(f"""
SELECT s.c_custkey, {_DIFF_LIST} AS differences
FROM customer s JOIN customer_dest d ON s.c_custkey = d.c_custkey
WHERE {_DIFF_LIST} <> ''
""", "customer_dest")


@register("q4_record_diff", Q4_SQL)
def q4(spark, sf_dir):
    t = Tables(spark, sf_dir)
    s = t.customer.select("c_custkey", *[F.col(c).alias("s_" + c) for c in _DIFF_COLS])
    d = customer_dest(t.customer).select("c_custkey", *[F.col(c).alias("d_" + c) for c in _DIFF_COLS])
    diff = rc.record_diff("s_", "d_", _DIFF_COLS)
    out = s.join(d, "c_custkey").select("c_custkey", diff.alias("differences")) \
        .filter(F.size("differences") > 0)
    return _diff_text(out)


Q2_SQL = with_ctes(f"""
WITH sample AS (SELECT * FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 100)
SELECT s.c_custkey,
       CASE WHEN d.c_custkey IS NULL THEN 'missing_in_destination'
            WHEN {_DIFF_LIST} = '' THEN 'matched' ELSE 'different' END AS status,
       CASE WHEN d.c_custkey IS NOT NULL THEN {_DIFF_LIST} END AS differences
FROM sample s LEFT JOIN customer_dest d ON s.c_custkey = d.c_custkey
""", "customer_dest")


@register("q2_sampled_verification", Q2_SQL)
def q2(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = rc.sampled_verification(t.customer.select(*CUST_COLS), customer_dest(t.customer),
                                   ["c_custkey"], n=100)
    return _diff_text(rows)


Q5_SQL = with_ctes("""
WITH d AS (SELECT c_custkey AS customer_id FROM customer_dest
           ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 10)
SELECT count(*) AS reverse_checked,
       avg(CASE WHEN customer_id IN (SELECT c_custkey FROM customer) THEN 1.0 ELSE 0.0 END) AS reverse_success_rate
FROM d
""", "customer_dest")


@register("q5_reverse_check", Q5_SQL)
def q5(spark, sf_dir):
    t = Tables(spark, sf_dir)
    m = TableMap((ColumnMap("customer_id", "c_custkey"), ColumnMap("name", "c_name")))
    dest = apply_mapping(customer_dest(t.customer), m)
    return rc.reverse_check(dest, t.customer, {"customer_id": "c_custkey"}, n=10)


Q2S_SQL = with_ctes(f"""
WITH sample AS (SELECT * FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 100),
r AS (SELECT CASE WHEN d.c_custkey IS NULL THEN 'missing_in_destination'
                  WHEN {_DIFF_LIST} = '' THEN 'matched' ELSE 'different' END AS status
      FROM sample s LEFT JOIN customer_dest d ON s.c_custkey = d.c_custkey)
SELECT (SELECT count(*) FROM customer) AS source_count,
       (SELECT count(*) FROM customer_dest) AS destination_count,
       (SELECT count(*) FROM customer) = (SELECT count(*) FROM customer_dest) AS counts_match,
       count(*) AS samples_checked, count(*) FILTER (WHERE status = 'matched') AS samples_matched
FROM r
""", "customer_dest")


@register("q2_verification_summary", Q2S_SQL)
def q2s(spark, sf_dir):
    """The Q2 report: counts of both tables and of checked / matched samples."""
    t = Tables(spark, sf_dir)
    dest = customer_dest(t.customer)
    rows = rc.sampled_verification(t.customer.select(*CUST_COLS), dest, ["c_custkey"], n=100)
    summary, _ = rc.verification_summary(rows, t.customer, dest, ["c_custkey"])
    return summary
