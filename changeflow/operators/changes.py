"""Change feeds: range scans, bounds, and set-based application (S5, S6, F6,
C6, C7, C9 batch form, C12, C20, A16).

A change feed is a DataFrame with position columns (``lsn``, ``seqval``), an
operation code (1 delete, 2 insert, 3 update before-image, 4 update
after-image) and the payload columns of the target.

Application never loops over events.  ``apply_strict`` (C6) reproduces the
outcome of applying events one by one with strict semantics (insert into a
live key fails, update of a missing key is a no-op) through two aggregations
keyed by the table key; ``apply_last_wins`` (C7) is one ``max_by``
aggregation.  Both aggregations combine map-side, so a key that holds a third
of the feed is reduced before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ByteType, DecimalType, IntegerType, IntegralType, ShortType,
                               StructType)

from changeflow.functions.columns import (OP_DELETE, OP_INSERT, OP_UPDATE_AFTER,
                                          OP_UPDATE_BEFORE, decode_operation)
from changeflow.operators.skew import DEFAULT_HOT_ROWS, null_key, salted_key_join
from changeflow.session import written

ORDER = ("lsn", "seqval")

# Row filters of a change-range scan
ROW_FILTERS = {
    "all": (OP_DELETE, OP_INSERT, OP_UPDATE_AFTER),
    "all update old": (OP_DELETE, OP_INSERT, OP_UPDATE_BEFORE, OP_UPDATE_AFTER),
    "all update new": (OP_DELETE, OP_INSERT, OP_UPDATE_AFTER),
}


def position(order: Sequence[str] = ORDER, schema: StructType | None = None) -> Column:
    """Total change order (lsn, then sequence) as one comparable value.

    With the schema known, integral positions become one number - the
    position itself, or ``lsn * 2^32 + (seqval + 2^31)`` as ``decimal(38,0)``
    for a long lsn and an int sequence - so aggregations over positions run
    as hash aggregations (fixed-width buffers).  Otherwise (binary LSNs, long
    sequences) a struct, which compares field by field but aggregates by
    sorting."""
    if schema is not None:
        types = [schema[c].dataType for c in order]
        if len(order) == 1 and isinstance(types[0], (IntegralType, DecimalType)):
            return F.col(order[0])
        if (len(order) == 2 and isinstance(types[0], IntegralType)
                and isinstance(types[1], (IntegerType, ShortType, ByteType))):
            return (F.col(order[0]).cast("decimal(38,0)") * F.lit(4294967296)
                    + (F.col(order[1]).cast("long") + F.lit(2147483648))).cast("decimal(38,0)")
    return F.struct(*[F.col(c) for c in order])


# ---------------------------------------------------------------- S5 / S6 / F6

def feed_range(feed: DataFrame, from_lsn=None, to_lsn=None, row_filter: str = "all",
               lsn_col: str = "lsn", op_col: str = "op_code",
               exclusive_from: bool = False) -> DataFrame:
    """Rows with position in [from, to] (or (from, to] for incremental
    reads), restricted by the row filter.  Filters stay simple comparisons on
    the position column so they reach the Parquet scan as pushed filters."""
    if row_filter not in ROW_FILTERS:
        raise ValueError(f"unknown row filter {row_filter!r}")
    out = feed.filter(F.col(op_col).isin(*ROW_FILTERS[row_filter]))
    if from_lsn is not None:
        out = out.filter(F.col(lsn_col) > from_lsn if exclusive_from else F.col(lsn_col) >= from_lsn)
    if to_lsn is not None:
        out = out.filter(F.col(lsn_col) <= to_lsn)
    return out


def feed_bounds(feed: DataFrame, lsn_col: str = "lsn", source_col: str | None = None) -> DataFrame:
    """Min position per feed (per source when given), max overall and the
    next position to read from (an exclusive incremental read starts after
    the max; for integral positions ``next_lsn`` = max + 1)."""
    integral = isinstance(feed.schema[lsn_col].dataType, IntegralType)
    if source_col:
        per = feed.groupBy(source_col).agg(F.min(lsn_col).alias("min_lsn"),
                                           F.max(lsn_col).alias("max_lsn"))
        # one row a source: the overall maximum is taken from those rows
        out = per.withColumn("max_lsn_overall", F.max("max_lsn").over(Window.partitionBy(F.lit(0))))
        top = "max_lsn_overall"
    else:
        out = feed.agg(F.min(lsn_col).alias("min_lsn"), F.max(lsn_col).alias("max_lsn"))
        top = "max_lsn"
    return out.withColumn("next_lsn", F.col(top) + 1) if integral else out


def enabled_operations(feed: DataFrame, inserts: bool = True, updates: bool = True,
                       deletes: bool = True, op_col: str = "op_code") -> DataFrame:
    """Drop events of disabled operations (before any reduction)."""
    ops = []
    if deletes:
        ops.append(OP_DELETE)
    if inserts:
        ops.append(OP_INSERT)
    if updates:
        ops += [OP_UPDATE_BEFORE, OP_UPDATE_AFTER]
    return feed.filter(F.col(op_col).isin(*ops))


def decode_feed(feed: DataFrame, op_col: str = "op_code") -> DataFrame:
    """P15 over a feed: add the operation name."""
    return feed.withColumn("operation", decode_operation(op_col))


# ---------------------------------------------------------------- helpers

def _payload(target: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in target.columns if c not in keys]


def _conform(feed: DataFrame, target: DataFrame, keys: Sequence[str],
             generated: Mapping[str, str]) -> DataFrame:
    """Give the feed every target column: generated columns the feed does
    not carry become typed nulls (filled by their generator on insert)."""
    missing = [c for c in _payload(target, keys) if c not in feed.columns]
    bad = [c for c in missing if c not in generated]
    if bad:
        raise ValueError(f"feed lacks destination columns {bad}")
    for c in missing:
        feed = feed.withColumn(c, F.lit(None).cast(target.schema[c].dataType))
    return feed


def _null_key_inserts(feed: DataFrame, keys: Sequence[str], payload: Sequence[str],
                      op_col: str, generated: Mapping[str, str]) -> DataFrame:
    """Inserts with a null key part: never match a row, always added."""
    rows = feed.filter(null_key(keys) & (F.col(op_col) == OP_INSERT))
    return rows.select(*keys, *[(F.expr(generated[c]) if c in generated else F.col(c)).alias(c)
                                 for c in payload])


def _finish(target: DataFrame, keys: Sequence[str], decided: DataFrame,
            new_row: Column, keep_target: Column, insert_only: Sequence[str],
            generated: Mapping[str, str], is_update: Column,
            insert_row: Column | None = None) -> DataFrame:
    """Join per-key decisions with the target (1:1 on key) and build rows.

    ``decided`` carries one row per key; ``new_row`` is the struct to write
    (null = no row from the feed), ``keep_target`` whether the target row
    stays unchanged, ``is_update`` whether the write updates a live row (so
    insert-only columns keep their target value).  ``insert_row`` is the
    row of the inserting event, source of insert-only columns otherwise."""
    payload = _payload(target, keys)
    tnull = null_key(keys)
    t_null = target.filter(tnull)                       # never matched
    t = target.filter(~tnull).select(*keys, F.struct(*payload).alias("_t"),
                                     F.lit(True).alias("_in_target"))
    j = t.join(decided, list(keys), "full_outer")
    j = j.withColumn("_in_target", F.coalesce(F.col("_in_target"), F.lit(False)))
    j = j.withColumn("_new", new_row).withColumn("_keep", keep_target) \
         .withColumn("_upd", is_update) \
         .withColumn("_ins", insert_row if insert_row is not None else F.col("_new"))
    j = j.filter(F.col("_keep") | F.col("_new").isNotNull())
    cols = []
    for c in payload:
        from_new = F.col(f"_new.{c}")
        if c in insert_only or c in generated:
            # a generated column is insert-only; a source value for it is ignored
            ins_val = F.expr(generated[c]) if c in generated else F.col(f"_ins.{c}")
            val = F.when(F.col("_upd"), F.col(f"_t.{c}")).otherwise(ins_val)
        else:
            val = from_new
        cols.append(F.when(F.col("_keep"), F.col(f"_t.{c}")).otherwise(val).alias(c))
    out = j.select(*keys, *cols)
    return out.unionByName(t_null)


# ---------------------------------------------------------------- C6 strict

def strict_decisions(feed: DataFrame, keys: Sequence[str], payload: Sequence[str],
                     order: Sequence[str] = ORDER, op_col: str = "op_code",
                     hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """Per key: last delete ``_ld``, first insert after it ``_f1`` with its row,
    and last update after the last delete ``_lu`` with its row.

    Stage 1 (``max`` of delete positions, count) combines map-side.  Stage 2
    needs ``_ld`` on each event: a salted key join (hot keys spread over
    buckets), then a second map-side combinable aggregation."""
    keys = list(keys)
    op = F.col(op_col)
    ev = feed.filter(op.isin(OP_DELETE, OP_INSERT, OP_UPDATE_AFTER)) \
             .select(*keys, *order, op_col, F.struct(*payload).alias("_row"))
    pos = position(order, feed.schema)
    stage1 = ev.groupBy(*keys).agg(
        F.max(F.when(op == OP_DELETE, pos)).alias("_ld"),
        F.count(F.lit(1)).alias("_n"),
    )
    # read by the hot-key check and by the join: written once
    stage1 = written(stage1, "last-deletes")
    j = salted_key_join(ev, stage1, keys, "_n", spread=list(order), hot_rows=hot_rows)
    after = F.col("_ld").isNull() | (pos > F.col("_ld"))
    ins = after & (op == OP_INSERT)
    upd = after & (op == OP_UPDATE_AFTER)
    return j.groupBy(*keys).agg(
        F.max("_ld").alias("_ld"),
        F.min(F.when(ins, pos)).alias("_f1"),
        F.min_by(F.when(ins, F.col("_row")), F.when(ins, pos)).alias("_ins_row"),
        F.max(F.when(upd, pos)).alias("_lu"),
        F.max_by(F.when(upd, F.col("_row")), F.when(upd, pos)).alias("_upd_row"),
    )


def apply_strict(target: DataFrame, feed: DataFrame, keys: Sequence[str],
                 order: Sequence[str] = ORDER, op_col: str = "op_code",
                 insert_only: Sequence[str] = (), generated: Mapping[str, str] | None = None,
                 hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """State after applying the feed event by event with strict rules.

    Rules for one key, events in (lsn, seq) order: DELETE removes the row;
    INSERT into a live key fails; UPDATE of a missing key does nothing.
    Update before-images (op 3) carry old values and are skipped.  Events with
    a null key never match a row: their inserts are added, the rest ignored.
    ``insert_only`` columns (generated / ignore-changes) keep the value of the
    inserting row or the target."""
    keys = list(keys)
    payload = _payload(target, keys)
    generated = dict(generated or {})
    feed = _conform(feed, target, keys, generated)
    nk = null_key(keys)
    d = strict_decisions(feed.filter(~nk), keys, payload, order, op_col, hot_rows)
    live0 = F.col("_in_target") & F.col("_ld").isNull()
    has_events = F.col("_f1").isNotNull() | F.col("_lu").isNotNull() | F.col("_ld").isNotNull()
    new_row = (F.when(live0, F.col("_upd_row"))
                .when(F.col("_f1").isNotNull(),
                      F.when(F.col("_lu") > F.col("_f1"), F.col("_upd_row"))
                       .otherwise(F.col("_ins_row"))))
    # keep the target row: no event for the key, or live with no update
    keep = F.col("_in_target") & (~has_events | (live0 & F.col("_lu").isNull()))
    is_update = live0
    out = _finish(target, keys, d, new_row, keep, insert_only, generated, is_update,
                  insert_row=F.col("_ins_row"))
    return out.unionByName(_null_key_inserts(feed, keys, payload, op_col, generated))


def strict_outcomes(feed: DataFrame, target: DataFrame, keys: Sequence[str],
                    order: Sequence[str] = ORDER, op_col: str = "op_code",
                    partitions: int | None = None) -> DataFrame:
    """C6 event outcomes (for C22 / F8): every event with ``status``
    processed or failed and an ``error`` text.

    An event needs the live flag of its key just before it, i.e. running
    maxima of delete and insert places.  These are computed as a two-level
    prefix scan over the blocks of ``ordered.ordered_blocks`` (range
    partitions of (key, position)), so no task sorts a whole hot key and
    positions may be of any type.  The target's keys are joined to the block
    summaries, one row per (key, block), not to the events.  A null key never
    matches a row: its inserts and deletes are processed, its updates fail."""
    from changeflow.operators.ordered import ordered_blocks
    keys = list(keys)
    op = F.col(op_col)
    ev = ordered_blocks(feed, keys, order, partitions=partitions)
    place = F.col("_mid")
    dpos = F.when(op == OP_DELETE, place)
    ipos = F.when(op == OP_INSERT, place)
    blocks = ev.groupBy("_k", "_blk").agg(F.max(dpos).alias("_bd"), F.max(ipos).alias("_bi"))
    wb = Window.partitionBy("_k").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_k", "_blk", F.max("_bd").over(wb).alias("_pd"), F.max("_bi").over(wb).alias("_pi"))
    live0 = (target.filter(~null_key(keys)).select(F.struct(*keys).alias("_k")).distinct()
             .withColumn("_e0", F.lit(True)))
    # the target's key columns may have other types than the feed's
    kt = feed.select(F.struct(*keys).alias("_k")).schema["_k"].dataType
    blocks = blocks.join(live0.withColumn("_k", F.col("_k").cast(kt)), "_k", "left")
    j = ev.join(blocks, ["_k", "_blk"], "inner")
    wr = Window.partitionBy("_k", "_blk").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    j = j.withColumn("_ldp", F.greatest(F.col("_pd"), F.max(dpos).over(wr))) \
         .withColumn("_lip", F.greatest(F.col("_pi"), F.max(ipos).over(wr)))
    live = (F.when(F.col("_ldp").isNull(), F.coalesce(F.col("_e0"), F.lit(False)) | F.col("_lip").isNotNull())
             .otherwise(F.coalesce(F.col("_lip") > F.col("_ldp"), F.lit(False)))) & ~null_key(keys)
    ok = ((op == OP_DELETE) | (op == OP_UPDATE_BEFORE)
          | ((op == OP_INSERT) & ~live) | ((op == OP_UPDATE_AFTER) & live))
    err = (F.when(ok, F.lit(None).cast("string"))
            .when(op == OP_INSERT, F.lit("insert into an existing key"))
            .otherwise(F.lit("update of a missing key")))
    return j.select(*feed.columns,
                    F.when(ok, "processed").otherwise("failed").alias("status"),
                    err.alias("error"))


def last_wins_outcomes(feed: DataFrame) -> DataFrame:
    """C7 event outcomes: under last-wins no event can fail."""
    return feed.withColumn("status", F.lit("processed")).withColumn("error", F.lit(None).cast("string"))


# ---------------------------------------------------------------- C7 / A16

def latest_per_key(feed: DataFrame, keys: Sequence[str], order: Sequence[str] = ORDER,
                   columns: Sequence[str] | None = None, op_col: str = "op_code") -> DataFrame:
    """A16 / W1 by aggregation: newest row per key via ``max_by`` (partial
    aggregation map-side; no window sort of a whole key group).  Before-images
    share their position with the after-image and are skipped."""
    keys = list(keys)
    cols = list(columns) if columns is not None else [c for c in feed.columns if c not in keys]
    if op_col in feed.columns:
        feed = feed.filter(F.col(op_col).isNull() | (F.col(op_col) != OP_UPDATE_BEFORE))
    agg = feed.groupBy(*keys).agg(F.max_by(F.struct(*cols), position(order, feed.schema)).alias("_r"))
    return agg.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def apply_last_wins(target: DataFrame, feed: DataFrame, keys: Sequence[str],
                    order: Sequence[str] = ORDER, op_col: str = "op_code",
                    insert_only: Sequence[str] = (),
                    generated: Mapping[str, str] | None = None) -> DataFrame:
    """The newest event per key decides: a DELETE removes the key,
    anything else writes its row."""
    keys = list(keys)
    payload = _payload(target, keys)
    generated = dict(generated or {})
    feed = _conform(feed, target, keys, generated)
    nk = null_key(keys)
    ev = feed.filter(~nk & F.col(op_col).isin(OP_DELETE, OP_INSERT, OP_UPDATE_AFTER))
    d = ev.groupBy(*keys).agg(F.max_by(F.struct(F.col(op_col).alias("_op"),
                                                F.struct(*payload).alias("_row")),
                                       position(order, feed.schema)).alias("_last"))
    d = d.select(*keys, F.col("_last._op").alias("_op"), F.col("_last._row").alias("_row"))
    new_row = F.when(F.col("_op") != OP_DELETE, F.col("_row"))
    keep = F.col("_in_target") & F.col("_op").isNull()
    is_update = F.col("_in_target")
    out = _finish(target, keys, d, new_row, keep, insert_only, generated, is_update)
    return out.unionByName(_null_key_inserts(feed, keys, payload, op_col, generated))


# ---------------------------------------------------------------- C12 / C20

def tag_sources(feeds: Mapping[str, DataFrame], aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Union several feeds, each tagged with source id and alias."""
    out = None
    for sid, df in feeds.items():
        t = df.withColumn("_source_id", F.lit(sid)) \
              .withColumn("_source_alias", F.lit((aliases or {}).get(sid, sid)))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    if out is None:
        raise ValueError("no feeds given")
    return out


def dimension_history(feed: DataFrame, keys: Sequence[str], time_col: str = "change_time",
                      order: Sequence[str] = ORDER, columns: Sequence[str] | None = None,
                      surrogate: str | None = None, op_col: str = "op_code",
                      partitions: int | None = None) -> DataFrame:
    """C20: SCD type 2 rows from a feed - effective from the change time,
    expiring at the next change of the key, current when none follows.

    Inserts and after-images are versions; a delete expires the version
    before it and is none itself; before-images are skipped.  The next change
    comes from the block-wise ``lead`` (no window over a whole key, null keys
    kept); ``surrogate`` adds a dense surrogate key in change order."""
    from changeflow.operators.ordered import keyed_neighbor
    from changeflow.operators.sequence import sequence_ids
    keys = list(keys)
    cols = list(columns) if columns is not None else [c for c in feed.columns if c not in keys]
    events = feed.filter(F.col(op_col).isin(OP_DELETE, OP_INSERT, OP_UPDATE_AFTER))
    base = events.select(*keys, *{c: None for c in [*cols, *order, time_col, op_col] if c not in keys})
    nb = keyed_neighbor(base.withColumn("_follows", F.lit(True)), keys, list(order), [time_col, "_follows"], "next",
                        prefix="_next_", partitions=partitions)
    out = nb.filter(F.col(op_col) != OP_DELETE).select(
        *keys, *cols, *[c for c in order if c not in cols and c not in keys],
        F.col(time_col).alias("effective_date"), F.col(f"_next_{time_col}").alias("expiration_date"),
        F.col("_next__follows").isNull().alias("is_current"))
    if surrogate:
        out = sequence_ids(out, list(order), surrogate)
    return out.select(*([surrogate] if surrogate else []), *keys, *cols,
                      "effective_date", "expiration_date", "is_current")


# ---------------------------------------------------------------- C11 pipeline

def apply_mapped_changes(target: DataFrame, feed: DataFrame, mapping, mode: str = "strict",
                         order: Sequence[str] = ORDER, op_col: str = "op_code") -> DataFrame:
    """The per-mapping change path: operation switches of the mapping (F6),
    the column mapping of the change rows (P1-P7, generated columns left for
    the insert branch), then the strict (C6) or last-wins (C7) fold with the
    mapping's keys and insert-only columns (P8-P10)."""
    from changeflow.operators.mapping import apply_mapping
    feed = enabled_operations(feed, mapping.sync_inserts, mapping.sync_updates,
                              mapping.sync_deletes, op_col)
    mapped = apply_mapping(feed, mapping, keep=[*order, op_col])
    gen = {c.target: c.generated for c in mapping.columns if c.generated}
    fold = apply_strict if mode == "strict" else apply_last_wins
    if mode not in ("strict", "last_wins"):
        raise ValueError(f"unknown apply mode {mode!r}")
    return fold(target, mapped, list(mapping.keys), order, op_col,
                mapping.insert_only_columns, gen)
