"""Checks for cross-source matching and mismatch patterns (J12, Q6-Q14,
A12, S13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeflow.catalog import register
from changeflow.operators import patterns as pt
from changeflow.session import written
from changeflow.sources.fixtures import Tables, customer_dest, with_ctes

COLUMNS = {"name": {"crm": "c_name", "dw": "c_name"},
           "balance": {"crm": "c_acctbal", "dw": "c_acctbal"},
           "segment": {"crm": "c_mktsegment", "dw": "c_mktsegment"}}


def _sources(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return [("crm", t.customer), ("dw", customer_dest(t.customer))]


def _analysis(spark, sf_dir, columns=COLUMNS):
    return pt.analyze_sources(_sources(spark, sf_dir), columns, ["c_custkey"])


def _mismatches(spark, sf_dir):
    return pt.analyze_mismatches(_sources(spark, sf_dir), COLUMNS, ["c_custkey"])


# ------------------------------------------------------------------ SQL side

def _trim(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _words(x):
    return (f"CASE WHEN {_trim(x)} = '' THEN 0 "
            f"ELSE len(string_split_regex({_trim(x)}, '\\s+')) END")


def _ws(x):
    return f"regexp_replace({_trim(x)}, '\\s+', ' ', 'g')"


def _detectors(a, b):
    """(id, condition, message) per detector, in detector order."""
    both = f"({a} <> '' AND {b} <> '')"
    return [
        ("column_swap",
         f"{both} AND lower({a}) <> lower({b}) AND NOT ({_words(a)} = 1 AND {_words(b)} = 1) "
         f"AND regexp_matches({a}, '\\p{{Lu}}') <> regexp_matches({b}, '\\p{{Lu}}')",
         f"concat('Columns may be swapped: ''', {a}, ''' <-> ''', {b}, '''')"),
        ("character_normalization",
         f"{both} AND strip_accents({a}) = strip_accents({b}) AND {a} <> {b}",
         f"concat('Diacritic mismatch detected: ''', {a}, ''' vs ''', {b}, ''' (normalized: ''', "
         f"strip_accents({a}), ''')')"),
        ("case_normalization", f"{both} AND lower({a}) = lower({b}) AND {a} <> {b}",
         f"concat('Case mismatch: ''', {a}, ''' vs ''', {b}, '''')"),
        ("whitespace_normalization", f"{both} AND {_ws(a)} = {_ws(b)} AND {a} <> {b}",
         f"concat('Whitespace mismatch: ''', {a}, ''' vs ''', {b}, '''')"),
    ]


def _col_sql(name, c, numeric):
    v1, v2 = f"CAST(c.{c} AS VARCHAR)", f"CAST(d.{c} AS VARCHAR)"
    if numeric:
        t1 = f"CASE WHEN c.{c} IS NULL OR c.{c} = 0 THEN '' ELSE {v1} END"
        t2 = f"CASE WHEN d.{c} IS NULL OR d.{c} = 0 THEN '' ELSE {v2} END"
    else:
        t1 = f"coalesce(c.{c}, '')"
        t2 = f"coalesce(d.{c}, '')"
    dets = _detectors(t1, t2)
    ids = "concat_ws(',', " + ", ".join(f"CASE WHEN {cond} THEN '{i}' END" for i, cond, _ in dets) + ")"
    fix = "CASE " + " ".join(f"WHEN {cond} THEN {msg}" for _, cond, msg in dets) + " END"
    return f"""
SELECT concat('{{''c_custkey'': ', CAST(c.c_custkey AS VARCHAR), '}}') AS row_id, c.c_custkey,
       '{name}' AS column_name,
       {v1} IS NOT NULL AND {v2} IS NOT NULL AND {v1} <> {v2} AS differs,
       json_object('crm', {v1}, 'dw', {v2}) AS "values", {v1} AS v_crm, {v2} AS v_dw,
       {ids} AS detected_patterns, {fix} AS suggested_fix
FROM customer c JOIN customer_dest d ON c.c_custkey IS NOT DISTINCT FROM d.c_custkey"""


ENTRIES_CTE = "entries AS (" + " UNION ALL ".join(
    _col_sql(n, c["crm"], n == "balance") for n, c in COLUMNS.items()) + ")"

Q6_SQL = with_ctes(f"""
WITH {ENTRIES_CTE}
SELECT row_id, c_custkey, NOT bool_or(differs) AS matched, CAST(count(*) FILTER (WHERE differs) AS BIGINT) AS n_mismatches
FROM entries GROUP BY row_id, c_custkey
""", "customer_dest")


@register("q6_multi_source_analysis", Q6_SQL)
def q6(spark, sf_dir):
    a = _analysis(spark, sf_dir)
    return a.select("row_id", "c_custkey", "matched", "n_mismatches")


Q12_SQL = with_ctes(f"""
WITH {ENTRIES_CTE}
SELECT row_id, column_name, "values", detected_patterns, suggested_fix FROM entries WHERE differs
""", "customer_dest")


@register("q12_pattern_labels", Q12_SQL)
def q12(spark, sf_dir):
    return _mismatches(spark, sf_dir).select(
        "row_id", "column_name", F.to_json("values", {"ignoreNullFields": "false"}).alias("values"),
        F.array_join("detected_patterns", ",").alias("detected_patterns"), "suggested_fix")


A12_SQL = with_ctes(f"""
WITH {ENTRIES_CTE},
r AS (SELECT row_id, NOT bool_or(differs) AS matched, count(*) FILTER (WHERE differs) AS n FROM entries GROUP BY row_id),
s AS (SELECT count(*) AS rows_compared, count(*) FILTER (WHERE matched) AS matched_records,
             CAST(sum(n) AS BIGINT) AS unmatched_records FROM r)
SELECT matched_records + unmatched_records AS total_records, matched_records, unmatched_records, rows_compared,
       CASE WHEN matched_records + unmatched_records > 0
            THEN round(matched_records * 100.0 / (matched_records + unmatched_records), 2) ELSE 0.0 END
            AS match_percentage,
       CASE WHEN rows_compared > 0 THEN round(matched_records * 100.0 / rows_compared, 2) ELSE 0.0 END
            AS row_match_percentage
FROM s
""", "customer_dest")


GATE_BOUND = 75.0      # between the two analyses: about 60 % match in all columns, 90 % in balances

Q15_SQL = with_ctes(f"""
WITH {ENTRIES_CTE},
e AS (SELECT 'all' AS analysis, row_id, differs FROM entries
      UNION ALL SELECT 'balance', row_id, differs FROM entries WHERE column_name = 'balance'),
r AS (SELECT analysis, row_id, NOT bool_or(differs) AS matched, count(*) FILTER (WHERE differs) AS n
      FROM e GROUP BY analysis, row_id),
s AS (SELECT analysis, count(*) AS rows_compared, count(*) FILTER (WHERE matched) AS matched_records,
             CAST(sum(n) AS BIGINT) AS unmatched_records FROM r GROUP BY analysis),
p AS (SELECT *, CASE WHEN matched_records + unmatched_records > 0
                THEN round(matched_records * 100.0 / (matched_records + unmatched_records), 2) ELSE 0.0 END
                AS match_percentage FROM s)
SELECT analysis, matched_records, unmatched_records, match_percentage, match_percentage >= {GATE_BOUND} AS passed FROM p
""", "customer_dest")


@register("q15_preload_gate", Q15_SQL)
def q15(spark, sf_dir):
    """The gate's verdict on an analysis below its bound and on one above,
    both from one written analysis."""
    analysis = written(_analysis(spark, sf_dir), "analysis")

    def verdict(name, held):
        return pt.gate_verdict(held, GATE_BOUND).select(
            F.lit(name).alias("analysis"), "matched_records", "unmatched_records", "match_percentage", "passed")
    return verdict("all", analysis).unionByName(verdict("balance", pt.only_columns(analysis, ["balance"])))


@register("a12_match_statistics", A12_SQL)
def a12(spark, sf_dir):
    return pt.match_statistics(_analysis(spark, sf_dir))


S13_SQL = with_ctes(f"""
WITH {ENTRIES_CTE}
SELECT row_id, column_name, 'crm' AS source, v_crm AS value, replace(detected_patterns, ',', ';') AS detected_patterns
FROM entries WHERE differs
UNION ALL
SELECT row_id, column_name, 'dw' AS source, v_dw AS value, replace(detected_patterns, ',', ';') AS detected_patterns
FROM entries WHERE differs
""", "customer_dest")


@register("s13_mismatch_export", S13_SQL)
def s13(spark, sf_dir):
    return pt.export_long(_mismatches(spark, sf_dir))


J12_SQL = with_ctes("""
SELECT c.c_custkey AS crm__c_custkey, c.c_name AS crm__c_name, d.c_name AS dw__c_name,
       f.n_orders AS fin__n_orders
FROM customer c
JOIN customer_dest d ON c.c_custkey IS NOT DISTINCT FROM d.c_custkey
JOIN (SELECT o_custkey AS c_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) f
  ON c.c_custkey IS NOT DISTINCT FROM f.c_custkey
""", "customer_dest")


@register("j12_n_way_match", J12_SQL)
def j12(spark, sf_dir):
    t = Tables(spark, sf_dir)
    fin = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    m = pt.n_way_match([("crm", t.customer.select("c_custkey", "c_name")),
                        ("dw", customer_dest(t.customer).select("c_custkey", "c_name")),
                        ("fin", fin)], ["c_custkey"], order={"dw": ["c_name"]})
    return m.select("crm__c_custkey", "crm__c_name", "dw__c_name", "fin__n_orders")


# ------------------------------------------------------------------ detectors, one by one

def _pair_sql(cond_index):
    _, cond, _ = _detectors("coalesce(c.c_name, '')", "coalesce(d.c_name, '')")[cond_index]
    return with_ctes(f"""
SELECT c.c_custkey FROM customer c JOIN customer_dest d ON c.c_custkey = d.c_custkey WHERE {cond}
""", "customer_dest")


def _pair_query(kind):
    def q(spark, sf_dir):
        t = Tables(spark, sf_dir)
        d = customer_dest(t.customer).select("c_custkey", F.col("c_name").alias("d_name"))
        j = t.customer.select("c_custkey", "c_name").join(d, "c_custkey")
        a = pt.detector_text(F.col("c_name"), j.schema["c_name"].dataType)
        b = pt.detector_text(F.col("d_name"), j.schema["d_name"].dataType)
        hit, _ = pt.detect(pt.Detector(kind, kind), a, b)
        return j.filter(hit).select("c_custkey")
    return q


for _i, (_name, _kind) in enumerate((("q10_column_swap_hint", pt.SWAP),
                                     ("q7_diacritic_mismatch", pt.DIACRITICS),
                                     ("q8_case_mismatch", pt.CASE),
                                     ("q9_whitespace_mismatch", pt.WHITESPACE))):
    register(_name, _pair_sql(_i))(_pair_query(_kind))


Q11_SQL = with_ctes("""
SELECT c_custkey, lower(c_name) AS lower_name,
       regexp_replace(regexp_replace(c_name, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS ws_name,
       strip_accents(c_name) AS plain_name, c_name AS same_name
FROM customer_dest
""", "customer_dest")


@register("q11_normalisers", Q11_SQL)
def q11(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = customer_dest(t.customer)
    return d.select("c_custkey",
                    pt.normalizer(pt.CASE, "c_name").alias("lower_name"),
                    pt.normalizer(pt.WHITESPACE, "c_name").alias("ws_name"),
                    pt.normalizer(pt.DIACRITICS, "c_name").alias("plain_name"),
                    pt.normalizer(pt.SWAP, "c_name").alias("same_name"))


Q14_SQL = with_ctes("""
SELECT count(*) AS samples_checked,
       count(*) FILTER (WHERE c.c_name <> '' AND d.c_name <> '' AND lower(c.c_name) = lower(d.c_name)
                        AND c.c_name <> d.c_name) AS samples_matched
FROM customer c JOIN customer_dest d ON c.c_custkey = d.c_custkey
""", "customer_dest")


@register("q14_pattern_trial", Q14_SQL)
def q14(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = customer_dest(t.customer).select("c_custkey", F.col("c_name").alias("d_name"))
    pairs = t.customer.select("c_custkey", "c_name").join(d, "c_custkey")
    return pt.pattern_trial(pairs, "c_name", "d_name", pt.Detector("case_check", pt.CASE))


# Q10 on data where columns really are swapped: one source holds the part
# name where the other holds the brand.
Q10P_SQL = f"""
SELECT p_partkey FROM part WHERE {_detectors("coalesce(p_name, '')", "coalesce(p_brand, '')")[0][1]}
"""


@register("q10_column_swap_on_swapped_columns", Q10P_SQL)
def q10p(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = t.part
    a = pt.detector_text(F.col("p_name"), p.schema["p_name"].dataType)
    b = pt.detector_text(F.col("p_brand"), p.schema["p_brand"].dataType)
    hit, _ = pt.detect(pt.Detector(pt.SWAP, pt.SWAP), a, b)
    return p.filter(hit).select("p_partkey")
