"""Load modes (C1-C5, C18): full, append, upsert, initial snapshot and
grouped runs.  Each returns the new state of the destination as a
DataFrame; writing it is a separate step (``sources.io.write_table``) so
the state can be written once, to a new location, never over what is read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.operators.mapping import TableMap, apply_mapping
from changeflow.operators.skew import null_key

MODES = ("full", "append", "upsert")


def full_load(source: DataFrame) -> DataFrame:
    """The destination becomes the source result."""
    return source


def append_load(target: DataFrame, source: DataFrame) -> DataFrame:
    """All source rows added to the destination (by column name)."""
    return target.unionByName(source)


def _source_order(order: Sequence[str] | Column | None) -> Column:
    if order is None:
        raise ValueError("an upsert needs an order: which of several source rows with one key is the last")
    if isinstance(order, Column):
        return order
    return F.struct(*[F.col(c) for c in order])


def upsert_actions(target: DataFrame, source: DataFrame, keys: Sequence[str],
                   order: Sequence[str] | Column | None = None,
                   insert_only: Sequence[str] = (),
                   generated: Mapping[str, str] | None = None) -> DataFrame:
    """C3 with the action per output row in ``_action``: insert, update or keep.

    * the source is reduced to the last row per key in ``order`` (a
      ``max_by`` aggregation, combined map-side - duplicates of a hot key are
      folded before the shuffle);
    * rows with a null key part never match: source ones are inserted,
      target ones kept - they bypass the join so they cannot pile up in the
      single partition that null keys hash to;
    * matched keys take the source's non-key columns, except insert-only
      columns, which keep the target value; new keys are inserted with their
      generated values.  A generated column is insert-only, and a source
      value for it is ignored.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("upsert needs key columns")
    generated = dict(generated or {})
    payload = [c for c in target.columns if c not in keys]
    missing = [c for c in payload if c not in source.columns and c not in generated]
    if missing:
        raise ValueError(f"source lacks destination columns {missing}")
    src_cols = [c for c in payload if c in source.columns and c not in generated]
    nk = null_key(keys)
    src = source.filter(~nk).withColumn("_ord", _source_order(order))
    row = F.struct(*src_cols) if src_cols else F.struct(F.lit(True).alias("_any"))
    dedup = src.groupBy(*keys).agg(F.max_by(row, F.col("_ord")).alias("_s"))
    dedup = dedup.withColumn("_in_source", F.lit(True))
    t = target.filter(~nk).select(*keys, F.struct(*payload).alias("_t"),
                                  F.lit(True).alias("_in_target"))
    j = t.join(dedup, keys, "full_outer")
    in_s = F.coalesce(F.col("_in_source"), F.lit(False))
    in_t = F.coalesce(F.col("_in_target"), F.lit(False))
    action = F.when(in_s & in_t, "update").when(in_s, "insert").otherwise("keep")
    cols = []
    for c in payload:
        s_val = F.col(f"_s.{c}") if c in src_cols else F.lit(None)
        ins_val = F.expr(generated[c]) if c in generated else s_val
        if c in insert_only or c in generated:
            upd_val = F.col(f"_t.{c}")
        else:
            upd_val = s_val
        cols.append(F.when(action == "keep", F.col(f"_t.{c}"))
                     .when(action == "update", upd_val)
                     .otherwise(ins_val).cast(target.schema[c].dataType).alias(c))
    out = j.select(*keys, *cols, action.alias("_action"))
    src_null = source.filter(nk).select(
        *keys, *[(F.expr(generated[c]) if c in generated else F.col(c))
                 .cast(target.schema[c].dataType).alias(c) for c in payload],
        F.lit("insert").alias("_action"))
    t_null = target.filter(nk).withColumn("_action", F.lit("keep"))
    return out.unionByName(src_null).unionByName(t_null)


# generator marker: continue a sequence column (``NEXT VALUE FOR`` a sequence)
SEQUENCE = "NEXT VALUE FOR SEQUENCE"


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str],
           order: Sequence[str] | Column | None = None, insert_only: Sequence[str] = (),
           generated: Mapping[str, str] | None = None) -> DataFrame:
    """Destination after the upsert.

    A generated column whose generator is ``SEQUENCE`` continues the target's
    numbering on inserted rows only (``max + 1, ...`` in key order, assigned
    with ``sequence.next_values`` - no single-partition window)."""
    generated = dict(generated or {})
    seq = [c for c, g in generated.items() if g == SEQUENCE]
    if not seq:
        return upsert_actions(target, source, keys, order, insert_only, generated).drop("_action")
    from changeflow.operators.sequence import next_values
    from changeflow.session import written
    gen = {c: (f"CAST(NULL AS {target.schema[c].dataType.simpleString()})" if c in seq else g)
           for c, g in generated.items()}
    # read twice below: written once to the shared folder
    acts = written(upsert_actions(target, source, keys, order, [*insert_only, *seq], gen), "upsert-actions")
    inserted = acts.filter(F.col("_action") == "insert").drop("_action")
    for c in seq:
        inserted = next_values(inserted.drop(c), target, c, list(keys)).select(*target.columns)
    return acts.filter(F.col("_action") != "insert").drop("_action").unionByName(inserted)


def upsert_counts(actions: DataFrame) -> DataFrame:
    """C4: inserted / updated counters over :func:`upsert_actions` output."""
    return actions.agg(
        F.count(F.when(F.col("_action") == "insert", 1)).alias("inserted"),
        F.count(F.when(F.col("_action") == "update", 1)).alias("updated"),
    )


def load(target: DataFrame | None, source: DataFrame, mode: str,
         keys: Sequence[str] = (), order=None, insert_only: Sequence[str] = (),
         generated: Mapping[str, str] | None = None) -> DataFrame:
    """Dispatch on the load mode."""
    if mode not in MODES:
        raise ValueError(f"unknown load mode {mode!r}")
    if mode == "full" or target is None:
        return full_load(source)
    if mode == "append":
        return append_load(target, source)
    return upsert(target, source, keys, order, insert_only, generated)


def initial_snapshot(source: DataFrame, mapping: TableMap, feed: DataFrame | None = None,
                     lsn_col: str = "lsn") -> tuple[DataFrame, object | None]:
    """Mapped full copy of the source, with the feed's high-water mark.

    The mark (max position, one value) is read here, before anything of the
    source is: rows changed during the copy are then replayed by a feed read
    strictly after it (upsert / strict fold make that replay harmless)."""
    mark = feed.agg(F.max(lsn_col)).first()[0] if feed is not None else None
    return apply_mapping(source, mapping, generate=True), mark


@dataclass(frozen=True)
class MappingRun:
    """One mapping of a grouped run."""
    name: str
    source: DataFrame
    mapping: TableMap
    destination: str
    mode: str = "full"
    enabled: bool = True
    order: Sequence[str] | None = None      # source columns; needed for an upsert


def grouped_run(runs: Sequence[MappingRun], targets: Mapping[str, DataFrame] | None = None
                ) -> dict[str, DataFrame]:
    """Fold all enabled mappings of each destination into one DataFrame,
    so every destination is written once (all or nothing per destination).

    Mappings are applied in the given order; a full load resets the
    destination state, append adds rows, upsert merges by the mapping keys."""
    states: dict[str, DataFrame] = {}
    targets = dict(targets or {})
    for r in runs:
        if not r.enabled:
            continue
        if r.mode not in MODES:
            raise ValueError(f"{r.name}: unknown load mode {r.mode!r}")
        if r.mode == "upsert" and not r.order:
            raise ValueError(f"{r.name}: an upsert needs an order")
        # the order is carried under names of its own, as the mapping may rename its columns
        order = [f"_order_{i}" for i in range(len(r.order or ()))] if r.mode == "upsert" else []
        source = r.source.withColumns({o: F.col(c) for o, c in zip(order, r.order or ())})
        mapped = apply_mapping(source, r.mapping, generate=(r.mode != "upsert"), keep=order)
        current = states.get(r.destination, targets.get(r.destination))
        gen = {c.target: c.generated for c in r.mapping.columns if c.generated}
        if current is None:
            mapped = mapped.drop(*order)
        states[r.destination] = load(current, mapped, r.mode, r.mapping.keys, order or None,
                                     insert_only=r.mapping.insert_only_columns,
                                     generated=gen)
    return states
