"""Checks for multi-source merges, lookups and set operations (S3, J1-J8,
J13, U1-U8, C14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeflow.catalog import register
from changeflow.operators import merge as mg
from changeflow.operators.merge import MergeSpec, Source, Step
from changeflow.sources.fixtures import Tables, customer_dest, with_ctes


def _crm_erp(t, how):
    return MergeSpec(
        sources=(Source("crm", t.customer), Source("erp", t.orders, where="o_totalprice > 100000")),
        steps=(Step(how, "erp", "crm.c_custkey = erp.o_custkey"),),
        # order_id is null on unmatched rows: shown as double so both engines
        # hand the same representation to the comparison
        output=(("crm.c_custkey", "customer_id"), ("crm.c_name", "customer_name"),
                ("CAST(erp.o_orderkey AS DOUBLE)", "order_id"), ("erp.o_totalprice", "amount")))


def _join_sql(how):
    return f"""
SELECT crm.c_custkey AS customer_id, crm.c_name AS customer_name,
       CAST(erp.o_orderkey AS DOUBLE) AS order_id, erp.o_totalprice AS amount
FROM customer crm {how} JOIN (SELECT * FROM orders WHERE o_totalprice > 100000) erp
ON crm.c_custkey = erp.o_custkey
"""


for _name, _how, _sql in (("j1_inner_merge", "inner", "INNER"), ("j2_left_merge", "left", "LEFT"),
                          ("j3_right_merge", "right", "RIGHT"), ("j4_full_merge", "full", "FULL")):
    def _q(spark, sf_dir, _how=_how):
        t = Tables(spark, sf_dir)
        return mg.run_merge(spark, _crm_erp(t, _how))
    register(_name, _join_sql(_sql))(_q)


def _join_all_sql(how):
    return _join_sql(how).replace("WHERE o_totalprice > 100000", "")


for _name, _how, _sql in (("j1_inner_merge_all", "inner", "INNER"), ("j2_left_merge_all", "left", "LEFT"),
                          ("j3_right_merge_all", "right", "RIGHT"), ("j4_full_merge_all", "full", "FULL")):
    def _all(spark, sf_dir, _how=_how):
        t = Tables(spark, sf_dir)
        spec = _crm_erp(t, _how)
        return mg.run_merge(spark, MergeSpec((spec.sources[0], Source("erp", t.orders)), spec.steps, spec.output))
    register(_name, _join_all_sql(_sql))(_all)


# The join key of each source, read off the first join condition
@register("c13_join_keys", """
SELECT 'crm' AS source, 'c_custkey' AS join_key, count(DISTINCT c_custkey) AS keys FROM customer
UNION ALL SELECT 'erp', 'o_custkey', count(DISTINCT o_custkey) FROM orders
""")
def c13(spark, sf_dir):
    t = Tables(spark, sf_dir)
    spec = _crm_erp(t, "inner")
    out = None
    for alias, df in (("crm", t.customer), ("erp", t.orders)):
        key = mg.join_key_of(spec, alias)
        q = df.agg(F.count_distinct(key).alias("keys")).select(F.lit(alias).alias("source"), F.lit(key).alias("join_key"), "keys")
        out = q if out is None else out.unionByName(q)
    return out


S3_SQL = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 50000"


@register("s3_aliased_filtered_source", S3_SQL)
def s3(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return Source("erp", t.orders, where="o_orderstatus = 'O' AND o_totalprice > 50000").frame() \
        .select("erp.o_orderkey", "erp.o_custkey", "erp.o_totalprice")


# The documented crm / erp / support chain, support = an aggregate of
# open line items per customer
J5_SQL = """
WITH support AS (
  SELECT o.o_custkey AS customer_id, 'open' AS status, count(*) AS open_count
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  WHERE l.l_linestatus = 'O' GROUP BY o.o_custkey)
SELECT crm.c_custkey AS customer_id, crm.c_name AS customer_name,
       erp.o_totalprice AS lifetime_value, CAST(sup.open_count AS DOUBLE) AS active_tickets
FROM customer crm
LEFT JOIN orders erp ON crm.c_custkey = erp.o_custkey
LEFT JOIN support sup ON crm.c_custkey = sup.customer_id AND sup.status = 'open'
"""


def _support(t):
    li = t.lineitem.filter(F.col("l_linestatus") == "O")
    o = t.orders
    return li.join(o, li.l_orderkey == o.o_orderkey) \
        .groupBy(F.col("o_custkey").alias("customer_id")) \
        .agg(F.lit("open").alias("status"), F.count(F.lit(1)).alias("open_count"))


@register("j5_chained_merge", J5_SQL)
def j5(spark, sf_dir):
    t = Tables(spark, sf_dir)
    spec = MergeSpec(
        sources=(Source("crm", t.customer), Source("erp", t.orders),
                 Source("sup", _support(t), where="status = 'open'")),
        steps=(Step("left", "erp", "crm.c_custkey = erp.o_custkey"),
               Step("left", "sup", "crm.c_custkey = sup.customer_id")),
        output=(("crm.c_custkey", "customer_id"), ("crm.c_name", "customer_name"),
                ("erp.o_totalprice", "lifetime_value"),
                ("CAST(sup.open_count AS DOUBLE)", "active_tickets")))
    return mg.run_merge(spark, spec)


J6_SQL = """
SELECT o.o_orderkey, c.c_custkey, o.o_totalprice, c.c_acctbal
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 20
"""


@register("j6_theta_merge", J6_SQL)
def j6(spark, sf_dir):
    t = Tables(spark, sf_dir)
    spec = MergeSpec(
        sources=(Source("o", t.orders), Source("c", t.customer)),
        steps=(Step("inner", "c", "o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 20"),),
        output=(("o.o_orderkey", "o_orderkey"), ("c.c_custkey", "c_custkey"),
                ("o.o_totalprice", "o_totalprice"), ("c.c_acctbal", "c_acctbal")))
    return mg.run_merge(spark, spec)


J7_SQL = """
SELECT c.c_custkey, c.c_name, n.n_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
"""


@register("j7_lookup_enrichment", J7_SQL)
def j7(spark, sf_dir):
    t = Tables(spark, sf_dir)
    nat = t.nation.withColumnRenamed("n_nationkey", "c_nationkey")
    return mg.lookup_enrich(t.customer, nat, "c_nationkey", ["n_name"]) \
        .select("c_custkey", "c_name", "n_name")


J8_SQL = """
SELECT s.s_suppkey, s.s_name, n.n_name, r.r_name
FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
"""


@register("j8_multi_lookup", J8_SQL)
def j8(spark, sf_dir):
    t = Tables(spark, sf_dir)
    nat = t.nation.withColumnRenamed("n_nationkey", "s_nationkey")
    reg = t.region.withColumnRenamed("r_regionkey", "n_regionkey")
    out = mg.multi_lookup(t.supplier, [(nat, "s_nationkey", ["n_name", "n_regionkey"]),
                                       (reg, "n_regionkey", ["r_name"])])
    return out.select("s_suppkey", "s_name", "n_name", "r_name")


J13_SQL = """
SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, NULL::VARCHAR AS src FROM customer
UNION ALL
SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, 'supplier' AS src FROM supplier
"""


@register("j13_workflow_join_union", J13_SQL)
def j13(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
                          F.col("c_acctbal").alias("balance"))
    b = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"),
                          F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("src"))
    return mg.workflow_join(a, b, "union")


J13M_SQL = """
SELECT o.o_orderkey, o.o_totalprice, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""


@register("j13_workflow_join_merge", J13M_SQL)
def j13m(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return mg.workflow_join(t.orders, c, "merge", "o_custkey").select("o_orderkey", "o_totalprice", "c_name")


# ------------------------------------------------------------------ set operations

def _set_spec(t, op):
    return MergeSpec(
        sources=(Source("c", t.customer.select(F.col("c_nationkey").alias("nationkey"))),
                 Source("s", t.supplier.select(F.col("s_nationkey").alias("nationkey")))),
        steps=(Step(op, "s"),), output=(("nationkey", "nationkey"),))


for _name, _op, _sql in (
        ("u1_union_all", "union_all", "SELECT c_nationkey AS nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
        ("u2_union_distinct", "union", "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier"),
        ("u3_intersect", "intersect", "SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
        ("u4_except", "except", "SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders")):
    def _q(spark, sf_dir, _op=_op, _name=_name):
        t = Tables(spark, sf_dir)
        if _name == "u4_except":
            spec = MergeSpec(
                sources=(Source("c", t.customer.select(F.col("c_custkey").alias("custkey"))),
                         Source("o", t.orders.select(F.col("o_custkey").alias("custkey")))),
                steps=(Step("except", "o"),), output=(("custkey", "custkey"),))
            return mg.run_merge(spark, spec)
        return mg.run_merge(spark, _set_spec(t, _op))
    register(_name, _sql)(_q)


U5_SQL = """
WITH previous_result AS (
  SELECT crm.c_custkey, crm.c_nationkey, erp.o_totalprice FROM customer crm
  JOIN orders erp ON crm.c_custkey = erp.o_custkey)
SELECT p.c_nationkey AS nationkey, count(*) AS orders, CAST(sum(CAST(p.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM previous_result p GROUP BY p.c_nationkey
"""


@register("u5_custom_sql_step", U5_SQL)
def u5(spark, sf_dir):
    t = Tables(spark, sf_dir)
    spec = MergeSpec(
        sources=(Source("crm", t.customer), Source("erp", t.orders)),
        steps=(Step("inner", "erp", "crm.c_custkey = erp.o_custkey"),
               Step("custom", sql="""
SELECT p.c_nationkey AS nationkey, count(*) AS orders,
       CAST(sum(CAST(p.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM previous_result p GROUP BY p.c_nationkey""")))
    return mg.run_merge(spark, spec)


U8_SQL = """
SELECT crm.c_custkey AS customer_id, erp.o_orderkey AS order_id FROM customer crm
JOIN orders erp ON crm.c_custkey = erp.o_custkey ORDER BY customer_id, order_id LIMIT 50
"""


@register("u8_merge_preview", U8_SQL)
def u8(spark, sf_dir):
    """Preview of a merge: first 50 rows in key order (a top-k report)."""
    t = Tables(spark, sf_dir)
    spec = MergeSpec(sources=(Source("crm", t.customer), Source("erp", t.orders)),
                     steps=(Step("inner", "erp", "crm.c_custkey = erp.o_custkey"),),
                     output=(("crm.c_custkey", "customer_id"), ("erp.o_orderkey", "order_id")))
    return mg.merge_preview(mg.run_merge(spark, spec), ["customer_id", "order_id"], 50)


# ------------------------------------------------------------------ C14

C14_SQL = with_ctes("""
WITH old AS (SELECT crm.c_custkey AS customer_id, crm.c_name AS customer_name, nat.n_name AS nation_name
             FROM customer_dest crm LEFT JOIN nation nat ON crm.c_nationkey = nat.n_nationkey),
affected AS (SELECT DISTINCT c_custkey FROM customer_dest WHERE c_mktsegment IS NULL OR c_custkey >= 10000000),
new AS (SELECT crm.c_custkey AS customer_id, crm.c_name AS customer_name, nat.n_name AS nation_name
        FROM customer crm LEFT JOIN nation nat ON crm.c_nationkey = nat.n_nationkey
        WHERE crm.c_custkey IN (SELECT c_custkey FROM affected))
SELECT * FROM old WHERE customer_id NOT IN (SELECT c_custkey FROM affected)
UNION ALL SELECT * FROM new
""", "customer_dest")


def c14_spec(t, crm_df):
    """The merge re-run for affected keys: crm keyed by customer, nation a lookup."""
    return MergeSpec(
        sources=(Source("crm", crm_df, key="c_custkey"), Source("nat", t.nation)),
        steps=(Step("left", "nat", "crm.c_nationkey = nat.n_nationkey"),),
        output=(("crm.c_custkey", "customer_id"), ("crm.c_name", "customer_name"),
                ("nat.n_name", "nation_name")))


@register("c14_remerge_affected_keys", C14_SQL)
def c14(spark, sf_dir):
    """The destination was merged from the perturbed copy; the keys touched
    by changes are re-merged from the current customers and replaced."""
    t = Tables(spark, sf_dir)
    dest_src = customer_dest(t.customer)
    old = mg.run_merge(spark, c14_spec(t, dest_src))
    changed = dest_src.filter(F.col("c_mktsegment").isNull() | (F.col("c_custkey") >= 10000000)) \
        .select("c_custkey")
    return mg.remerge_affected(spark, c14_spec(t, t.customer), changed, "c_custkey", old, "customer_id")


U6_SQL = """
SELECT crm.c_custkey AS customer_id, upper(nat.n_name) || '-' || crm.c_mktsegment AS label,
       crm.c_acctbal * 2 AS double_balance
FROM customer crm LEFT JOIN nation nat ON crm.c_nationkey = nat.n_nationkey
"""


@register("u6_output_projection", U6_SQL)
def u6(spark, sf_dir):
    """Output columns as alias-qualified columns and expressions."""
    t = Tables(spark, sf_dir)
    spec = MergeSpec(sources=(Source("crm", t.customer), Source("nat", t.nation)),
                     steps=(Step("left", "nat", "crm.c_nationkey = nat.n_nationkey"),),
                     output=(("crm.c_custkey", "customer_id"),
                             ("upper(nat.n_name) || '-' || crm.c_mktsegment", "label"),
                             ("crm.c_acctbal * 2", "double_balance")))
    return mg.run_merge(spark, spec)
