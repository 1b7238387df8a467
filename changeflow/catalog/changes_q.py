"""Checks for change feeds and their application (S5, S6, F6, P15, C6-C9,
C12, C20, C22, A16, T1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeflow.catalog import register
from changeflow.operators import changes as ch
from changeflow.sources.fixtures import Tables, base_state, change_feed, with_ctes

KEYS = ["user_id"]

# ------------------------------------------------------------------ C6

C6_SQL = with_ctes("""
WITH ev AS (SELECT * FROM change_feed WHERE op_code IN (1, 2, 4) AND user_id IS NOT NULL),
s1 AS (SELECT user_id, max(CASE WHEN op_code = 1 THEN lsn END) AS ld FROM ev GROUP BY user_id),
s2 AS (SELECT e.user_id, min(CASE WHEN e.op_code = 2 THEN e.lsn END) AS f1,
              max(CASE WHEN e.op_code = 4 THEN e.lsn END) AS lu
       FROM ev e JOIN s1 ON e.user_id = s1.user_id
       WHERE s1.ld IS NULL OR e.lsn > s1.ld GROUP BY e.user_id),
d AS (SELECT s1.user_id, s1.ld, s2.f1, s2.lu,
             (b.user_id IS NOT NULL AND s1.ld IS NULL) AS live0
      FROM s1 LEFT JOIN s2 ON s1.user_id = s2.user_id
      LEFT JOIN base_state b ON b.user_id = s1.user_id),
pick AS (SELECT user_id, live0,
                CASE WHEN live0 THEN lu
                     WHEN f1 IS NOT NULL THEN CASE WHEN lu > f1 THEN lu ELSE f1 END END AS pos
         FROM d)
SELECT b.user_id, b.event_type, b.value FROM base_state b
WHERE NOT EXISTS (SELECT 1 FROM pick p WHERE p.user_id = b.user_id
                  AND NOT (p.live0 AND p.pos IS NULL))
UNION ALL
SELECT e.user_id, e.event_type, e.value FROM pick p JOIN ev e ON e.user_id = p.user_id AND e.lsn = p.pos
""", "change_feed", "base_state")


def c6_strict(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ch.apply_strict(base_state(t.events), change_feed(t.events), KEYS)


register("c6_strict_apply", C6_SQL)(c6_strict)

# ------------------------------------------------------------------ C7

C7_SQL = with_ctes("""
WITH ev AS (SELECT * FROM change_feed WHERE op_code IN (1, 2, 4) AND user_id IS NOT NULL),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lsn DESC, seqval DESC) AS rn
                        FROM ev) WHERE rn = 1)
SELECT user_id, event_type, value FROM base_state
WHERE user_id NOT IN (SELECT user_id FROM last)
UNION ALL
SELECT user_id, event_type, value FROM last WHERE op_code <> 1
""", "change_feed", "base_state")


@register("c7_last_wins_apply", C7_SQL)
def c7_last_wins(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ch.apply_last_wins(base_state(t.events), change_feed(t.events), KEYS)


# Conflict "latest wins" across two sources = last-wins over the union
C15_SQL = with_ctes("""
WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lsn DESC) AS rn
                             FROM change_feed WHERE op_code IN (1, 2, 4)) WHERE rn = 1)
SELECT user_id, source_id, event_type, value FROM last
""", "change_feed")


@register("c15_conflict_latest", C15_SQL)
def c15_latest(spark, sf_dir):
    from changeflow.operators.merge import resolve_conflicts
    t = Tables(spark, sf_dir)
    feed = change_feed(t.events).filter(F.col("op_code").isin(1, 2, 4))
    return resolve_conflicts(feed, KEYS, "latest", source_col="source_id",
                             columns=["source_id", "event_type", "value"])


C16_SQL = with_ctes("""
SELECT user_id, source_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id
            ORDER BY CASE source_id WHEN 'src_erp' THEN 0 WHEN 'src_crm' THEN 1 ELSE 2 END, lsn DESC) AS rn
  FROM change_feed WHERE op_code IN (1, 2, 4)) WHERE rn = 1
""", "change_feed")


@register("c16_conflict_priority", C16_SQL)
def c16_priority(spark, sf_dir):
    from changeflow.operators.merge import resolve_conflicts
    t = Tables(spark, sf_dir)
    feed = change_feed(t.events).filter(F.col("op_code").isin(1, 2, 4))
    return resolve_conflicts(feed, KEYS, "priority", source_col="source_id",
                             priority=["src_erp", "src_crm"],
                             columns=["source_id", "event_type", "value"])


C17_SQL = with_ctes("""
SELECT user_id, max(value) AS value, count(*) AS n_events FROM change_feed
WHERE op_code IN (1, 2, 4) GROUP BY user_id
""", "change_feed")


@register("c17_conflict_custom", C17_SQL)
def c17_custom(spark, sf_dir):
    """Custom rule: per column SQL over ``old`` / ``new`` structs - here the
    larger value wins and events are counted."""
    from changeflow.operators.merge import resolve_conflicts
    t = Tables(spark, sf_dir)
    feed = change_feed(t.events).filter(F.col("op_code").isin(1, 2, 4)) \
        .withColumn("n_events", F.lit(1).cast("long"))
    return resolve_conflicts(feed, KEYS, "custom", columns=["value", "n_events"],
                             rules={"value": "greatest(old.value, new.value)",
                                    "n_events": "old.n_events + new.n_events"},
                             order=ch.ORDER, associative=True)


# a rule whose result depends on the order of the events
C17_ORDER_SQL = with_ctes("""
SELECT user_id, string_agg(event_type, '|' ORDER BY lsn, seqval) AS event_type FROM change_feed
WHERE op_code IN (1, 2, 4) GROUP BY user_id
""", "change_feed")


@register("c17_conflict_custom_ordered", C17_ORDER_SQL)
def c17_ordered(spark, sf_dir):
    """Texts joined in change order, over binary positions, in small blocks."""
    from changeflow.operators.merge import resolve_conflicts
    feed = binary_lsn(change_feed(Tables(spark, sf_dir).events)).filter(F.col("op_code").isin(1, 2, 4))
    return resolve_conflicts(feed, KEYS, "custom", columns=["event_type"], order=ch.ORDER, block=7, associative=True,
                             rules={"event_type": "concat(old.event_type, '|', new.event_type)"})


@register("c16_conflict_priority_binary", C16_SQL)
def c16_binary(spark, sf_dir):
    from changeflow.operators.merge import resolve_conflicts
    feed = binary_lsn(change_feed(Tables(spark, sf_dir).events)).filter(F.col("op_code").isin(1, 2, 4))
    return resolve_conflicts(feed, KEYS, "priority", source_col="source_id", priority=["src_erp", "src_crm"],
                             order=ch.ORDER, columns=["source_id", "event_type", "value"])


# ------------------------------------------------------------------ S5 / S6 / F6 / P15

S5_SQL = with_ctes("""
SELECT lsn, seqval, op_code, user_id, event_type, value FROM change_feed
WHERE op_code IN (1, 2, 4) AND lsn >= 2000 AND lsn <= 7000
""", "change_feed")


@register("s5_feed_range", S5_SQL)
def s5_range(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ch.feed_range(change_feed(t.events), 2000, 7000) \
        .select("lsn", "seqval", "op_code", "user_id", "event_type", "value")


S6_SQL = with_ctes("""
SELECT p.source_id, p.min_lsn, p.max_lsn, o.max_lsn_overall, o.max_lsn_overall + 1 AS next_lsn
FROM (SELECT source_id, min(lsn) AS min_lsn, max(lsn) AS max_lsn FROM change_feed GROUP BY source_id) p
CROSS JOIN (SELECT max(lsn) AS max_lsn_overall FROM change_feed) o
""", "change_feed")


@register("s6_feed_bounds", S6_SQL)
def s6_bounds(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ch.feed_bounds(change_feed(t.events), source_col="source_id")


F6_SQL = with_ctes("""
SELECT user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lsn DESC) AS rn
  FROM change_feed WHERE op_code IN (2, 3, 4)) WHERE rn = 1
""", "change_feed")


@register("f6_operation_flags", F6_SQL)
def f6_flags(spark, sf_dir):
    """Deletes switched off, then the newest remaining event per key."""
    t = Tables(spark, sf_dir)
    feed = ch.enabled_operations(change_feed(t.events), deletes=False)
    return ch.latest_per_key(feed, KEYS, columns=["event_type", "value"])


P15_SQL = with_ctes("""
SELECT lsn, op_code, CASE WHEN op_code = 1 THEN 'DELETE' WHEN op_code IN (3, 4) THEN 'UPDATE'
                          ELSE 'INSERT' END AS operation
FROM change_feed
""", "change_feed")


@register("p15_operation_decode", P15_SQL)
def p15_decode(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ch.decode_feed(change_feed(t.events)).select("lsn", "op_code", "operation")


# ------------------------------------------------------------------ A16 / T1

A16_SQL = with_ctes("""
SELECT user_id, lsn, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lsn DESC, seqval DESC) AS rn
  FROM change_feed) WHERE rn = 1
""", "change_feed")


@register("a16_latest_event_per_key", A16_SQL)
def a16_latest(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ch.latest_per_key(change_feed(t.events), KEYS, columns=["lsn", "event_type", "value"])


T1_SQL = with_ctes("""
SELECT lsn, seqval, op_code, user_id FROM change_feed ORDER BY lsn, seqval LIMIT 100
""", "change_feed")


@register("t1_change_order", T1_SQL)
def t1_order(spark, sf_dir):
    """The first 100 changes in (lsn, seq) order: a top-k report."""
    t = Tables(spark, sf_dir)
    return change_feed(t.events).orderBy("lsn", "seqval").limit(100) \
        .select("lsn", "seqval", "op_code", "user_id")


@register("t1_change_order_whole", with_ctes("""
SELECT lsn, seqval, op_code, user_id, row_number() OVER (ORDER BY lsn, seqval) AS place FROM change_feed
""", "change_feed"))
def t1_whole(spark, sf_dir):
    """Every change with its place in the change order."""
    from changeflow.operators.sequence import sequence_ids
    feed = change_feed(Tables(spark, sf_dir).events).select("lsn", "seqval", "op_code", "user_id")
    return sequence_ids(feed, ["lsn", "seqval"], "place")


# ------------------------------------------------------------------ C9 batch form

C9_SQL = with_ctes("""
SELECT user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lsn DESC) AS rn
  FROM change_feed WHERE lsn > (SELECT max(lsn) FROM change_feed WHERE change_time < TIMESTAMP '2024-01-15 00:00:00')
    AND op_code IN (1, 2, 4)) WHERE rn = 1 AND op_code <> 1
""", "change_feed")


@register("c9_incremental_batch", C9_SQL)
def c9_incremental(spark, sf_dir):
    """Incremental read after a high-water mark, then last-wins per key.

    The mark is the position reached by an earlier run (here: everything
    captured before 2024-01-15); the read is exclusive of it."""
    t = Tables(spark, sf_dir)
    feed = change_feed(t.events)
    mark = feed.filter(F.col("change_time") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")) \
        .agg(F.max("lsn")).first()[0]
    newer = ch.feed_range(feed, mark, exclusive_from=True)     # one number: the filter reaches the scan
    latest = ch.latest_per_key(newer, KEYS, columns=["op_code", "event_type", "value"])
    return latest.filter(F.col("op_code") != 1).select("user_id", "event_type", "value")


# ------------------------------------------------------------------ C12 / C20 / C22

C12_SQL = with_ctes("""
SELECT lsn, user_id, _source_id, _source_alias FROM (
  SELECT lsn, user_id, 'erp' AS _source_id, 'erp_alias' AS _source_alias FROM change_feed WHERE source_id = 'src_erp'
  UNION ALL
  SELECT lsn, user_id, 'crm' AS _source_id, 'crm_alias' AS _source_alias FROM change_feed WHERE source_id = 'src_crm')
""", "change_feed")


@register("c12_multi_source_feed", C12_SQL)
def c12_tagged(spark, sf_dir):
    t = Tables(spark, sf_dir)
    feed = change_feed(t.events).select("lsn", "user_id", "source_id")
    tagged = ch.tag_sources({"erp": feed.filter(F.col("source_id") == "src_erp"),
                             "crm": feed.filter(F.col("source_id") == "src_crm")},
                            {"erp": "erp_alias", "crm": "crm_alias"})
    return tagged.select("lsn", "user_id", "_source_id", "_source_alias")


# versions are inserts and after-images; a delete ends the version before it
C20_SQL = with_ctes("""
SELECT row_number() OVER (ORDER BY lsn, seqval) AS surrogate_key,
       user_id, lsn, event_type, effective_date, expiration_date, next_lsn IS NULL AS is_current FROM (
  SELECT *, change_time AS effective_date,
         lead(change_time) OVER (PARTITION BY user_id ORDER BY lsn, seqval) AS expiration_date,
         lead(lsn) OVER (PARTITION BY user_id ORDER BY lsn, seqval) AS next_lsn
  FROM change_feed WHERE op_code <> 3)
WHERE op_code <> 1
""", "change_feed")


@register("c20_dimension_history", C20_SQL)
def c20_scd2(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ch.dimension_history(change_feed(t.events), KEYS, columns=["lsn", "event_type"],
                                surrogate="surrogate_key")


def binary_lsn(feed):
    """The feed with 10-byte positions that sort as the numeric ones do."""
    return feed.withColumn("lsn_no", F.col("lsn")).withColumn("lsn", F.unhex(F.lpad(F.hex("lsn_no"), 20, "0")))


C20_NULLS_SQL = C20_SQL.replace("user_id, lsn, event_type", "k AS user_id, lsn, event_type").replace(
    "PARTITION BY user_id", "PARTITION BY k").replace(
    "SELECT *, change_time", "SELECT *, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END AS k, change_time").replace(
    "PARTITION BY k", "PARTITION BY CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END")


@register("c20_dimension_history_nulls", C20_NULLS_SQL)
def c20_nulls(spark, sf_dir):
    """Null keys are a key of their own; positions are binary."""
    feed = binary_lsn(change_feed(Tables(spark, sf_dir).events))
    feed = feed.withColumn("user_id", F.when(F.col("user_id") % 5 != 0, F.col("user_id")))
    out = ch.dimension_history(feed, KEYS, columns=["lsn_no", "event_type"], surrogate="surrogate_key")
    return out.withColumnRenamed("lsn_no", "lsn")


C22_SQL = with_ctes("""
WITH ev AS (SELECT *,
   max(CASE WHEN op_code = 1 THEN lsn END) OVER (PARTITION BY user_id ORDER BY lsn, seqval
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ldp,
   max(CASE WHEN op_code = 2 THEN lsn END) OVER (PARTITION BY user_id ORDER BY lsn, seqval
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lip
   FROM change_feed),
j AS (SELECT ev.*, b.user_id IS NOT NULL AS e0 FROM ev LEFT JOIN base_state b ON b.user_id = ev.user_id),
l AS (SELECT *, CASE WHEN ldp IS NULL THEN e0 OR lip IS NOT NULL ELSE coalesce(lip > ldp, false) END AS live FROM j)
SELECT lsn, user_id, op_code,
       CASE WHEN op_code IN (1, 3) OR (op_code = 2 AND NOT live) OR (op_code = 4 AND live)
            THEN 'processed' ELSE 'failed' END AS status
FROM l
""", "change_feed", "base_state")


@register("c22_event_outcomes", C22_SQL)
def c22_outcomes(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = ch.strict_outcomes(change_feed(t.events), base_state(t.events), KEYS)
    return out.select("lsn", "user_id", "op_code", "status")


# null keys never match a row: inserts and deletes are processed, updates fail
C22_NULLS_SQL = C22_SQL.rstrip() + """ WHERE user_id % 5 <> 0
UNION ALL SELECT lsn, NULL, op_code, CASE WHEN op_code = 4 THEN 'failed' ELSE 'processed' END
FROM change_feed WHERE user_id % 5 = 0
"""


@register("c22_event_outcomes_nulls", C22_NULLS_SQL)
def c22_nulls(spark, sf_dir):
    """Events with null keys, on binary positions."""
    t = Tables(spark, sf_dir)
    feed = binary_lsn(change_feed(t.events))
    feed = feed.withColumn("user_id", F.when(F.col("user_id") % 5 != 0, F.col("user_id")))
    out = ch.strict_outcomes(feed, base_state(t.events), KEYS)
    return out.select(F.col("lsn_no").alias("lsn"), "user_id", "op_code", "status")


# Deletes switched off for the mapping, then the strict fold
C8_SQL = C6_SQL.replace("op_code IN (1, 2, 4)", "op_code IN (2, 4)")
assert C8_SQL != C6_SQL


@register("c8_operation_flags_strict", C8_SQL)
def c8(spark, sf_dir):
    t = Tables(spark, sf_dir)
    feed = ch.enabled_operations(change_feed(t.events), deletes=False)
    return ch.apply_strict(base_state(t.events), feed, KEYS)


# A column generated on first insert and locked afterwards, on the fold
P9_SQL = with_ctes("""
WITH ev AS (SELECT * FROM change_feed WHERE op_code IN (1, 2, 4)),
s1 AS (SELECT user_id, max(CASE WHEN op_code = 1 THEN lsn END) AS ld FROM ev GROUP BY user_id),
s2 AS (SELECT e.user_id, min(CASE WHEN e.op_code = 2 THEN e.lsn END) AS f1,
              max(CASE WHEN e.op_code = 4 THEN e.lsn END) AS lu
       FROM ev e JOIN s1 ON e.user_id = s1.user_id
       WHERE s1.ld IS NULL OR e.lsn > s1.ld GROUP BY e.user_id),
d AS (SELECT s1.user_id, s1.ld, s2.f1, s2.lu, (b.user_id IS NOT NULL AND s1.ld IS NULL) AS live0
      FROM s1 LEFT JOIN s2 ON s1.user_id = s2.user_id LEFT JOIN base_state b ON b.user_id = s1.user_id),
pick AS (SELECT user_id, live0, CASE WHEN live0 THEN lu
                WHEN f1 IS NOT NULL THEN CASE WHEN lu > f1 THEN lu ELSE f1 END END AS pos FROM d)
SELECT b.user_id, b.event_type, b.value, 'seed' AS first_seen FROM base_state b
WHERE NOT EXISTS (SELECT 1 FROM pick p WHERE p.user_id = b.user_id AND NOT (p.live0 AND p.pos IS NULL))
UNION ALL
SELECT e.user_id, e.event_type, e.value, CASE WHEN p.live0 THEN 'seed' ELSE 'generated' END AS first_seen
FROM pick p JOIN ev e ON e.user_id = p.user_id AND e.lsn = p.pos
""", "change_feed", "base_state")


@register("p9_generate_on_init", P9_SQL)
def p9(spark, sf_dir):
    t = Tables(spark, sf_dir)
    target = base_state(t.events).withColumn("first_seen", F.lit("seed"))
    return ch.apply_strict(target, change_feed(t.events), KEYS, insert_only=["first_seen"],
                           generated={"first_seen": "'generated'"})


# C11 path for one mapping: switches, column mapping, fold
C11M_SQL = with_ctes(f"""
WITH folded AS ({C6_SQL.strip()})
SELECT user_id AS customer_id, upper(event_type) AS kind, value * 2 AS amount FROM folded
""")


@register("c11_mapped_change_apply", C11M_SQL)
def c11_mapped(spark, sf_dir):
    from changeflow.operators.mapping import ColumnMap, TableMap, apply_mapping
    t = Tables(spark, sf_dir)
    m = TableMap((ColumnMap("customer_id", "user_id"),
                  ColumnMap("kind", kind="expression", expression="upper(event_type)"),
                  ColumnMap("amount", kind="expression", expression="value * 2")),
                 keys=("customer_id",))
    target = apply_mapping(base_state(t.events), m)
    return ch.apply_mapped_changes(target, change_feed(t.events), m)


# P9 on the fold where the feed carries a value for the generated column
@register("p9_generated_over_source", P9_SQL)
def p9_source(spark, sf_dir):
    """The feed's own value is ignored; the column need not be listed as
    insert-only."""
    t = Tables(spark, sf_dir)
    target = base_state(t.events).withColumn("first_seen", F.lit("seed"))
    feed = change_feed(t.events).withColumn("first_seen", F.lit("from the feed"))
    return ch.apply_strict(target, feed, KEYS, generated={"first_seen": "'generated'"})
