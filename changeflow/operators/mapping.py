"""Column mapping (P1-P17): a declarative spec compiled to one ``select``.

A :class:`ColumnMap` says how one destination column is produced.  A
:class:`TableMap` is an ordered list of them plus the destination key.  The
compiled projection is a single narrow ``select`` - no shuffle, and Catalyst
prunes every source column the mapping does not use.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.functions.columns import (concat_keep_nulls, decode_operation,
                                          fill_template, json_array, json_object,
                                          record_id)

KINDS = ("direct", "expression", "json", "json_array", "concat", "template")


@dataclass(frozen=True)
class ColumnMap:
    """How one destination column is produced.

    kind        direct | expression | json | json_array | concat | template
    source      source column (direct)
    sources     source columns (json, json_array, concat, template)
    expression  Spark SQL text (expression) or ``{colN}`` template (template)
    default     SQL expression used when the produced value is null (P7)
    on_insert   SQL expression generated for new rows only (P8)
    on_init     SQL expression generated on first insert, locked after (P9)
    ignore_changes  value written on insert, kept from the target on update (P10)
    """

    target: str
    source: str | None = None
    kind: str = "direct"
    sources: tuple[str, ...] = ()
    expression: str | None = None
    separator: str = ", "
    json_names: tuple[str, ...] | None = None
    default: str | None = None
    on_insert: str | None = None
    on_init: str | None = None
    ignore_changes: bool = False

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown mapping kind {self.kind!r}")
        if self.ignore_changes and (self.on_insert or self.on_init):
            raise ValueError(f"{self.target}: ignore_changes cannot be combined with a generated value")
        if self.kind == "direct" and not (self.source or self.on_insert or self.on_init):
            raise ValueError(f"{self.target}: direct mapping needs a source column")
        if self.kind == "expression" and not self.expression:
            raise ValueError(f"{self.target}: expression mapping needs an expression")
        if self.kind in ("json", "json_array", "concat", "template") and not self.sources:
            raise ValueError(f"{self.target}: {self.kind} mapping needs source columns")

    @property
    def generated(self) -> str | None:
        return self.on_insert or self.on_init

    @property
    def insert_only(self) -> bool:
        """Value is taken from the inserting row and never changed by updates."""
        return bool(self.generated) or self.ignore_changes


@dataclass(frozen=True)
class TableMap:
    columns: tuple[ColumnMap, ...]
    keys: tuple[str, ...] = ()
    # operation switches
    sync_inserts: bool = True
    sync_updates: bool = True
    sync_deletes: bool = True

    def __post_init__(self):
        names = [c.target for c in self.columns]
        if len(set(n.lower() for n in names)) != len(names):
            raise ValueError("duplicate destination column in mapping")
        missing = [k for k in self.keys if k not in names]
        if missing:
            raise ValueError(f"key columns not produced by the mapping: {missing}")

    @property
    def targets(self) -> list[str]:
        return [c.target for c in self.columns]

    @property
    def insert_only_columns(self) -> list[str]:
        return [c.target for c in self.columns if c.insert_only]


def compile_column(m: ColumnMap) -> Column:
    """The Column expression for one mapping (without generation)."""
    if m.kind == "direct":
        c = F.col(m.source) if m.source else F.lit(None)
    elif m.kind == "expression":
        c = F.expr(m.expression)
    elif m.kind == "json":
        c = json_object(list(m.sources), list(m.json_names or m.sources))
    elif m.kind == "json_array":
        c = json_array(list(m.sources))
    elif m.kind == "concat":
        c = concat_keep_nulls(list(m.sources), m.separator)
    else:  # template
        c = F.expr(fill_template(m.expression or "", list(m.sources)))
    if m.default is not None:
        c = F.coalesce(c, F.expr(m.default))
    return c


def apply_mapping(df: DataFrame, mapping: TableMap | Sequence[ColumnMap],
                  generate: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Project ``df`` through the mapping (one narrow ``select``).

    With ``generate=True`` generated columns (P8/P9) take their generator
    expression - use this for rows known to be inserts.  Otherwise a generated
    column is left null, to be filled by the load operator on its insert
    branch; a source column mapped to it is ignored.  ``keep`` carries extra columns through unchanged
    (change positions and operation codes of a feed).
    """
    cols = mapping.columns if isinstance(mapping, TableMap) else tuple(mapping)
    out = [F.col(k) for k in keep]
    for m in cols:
        if m.generated:
            c = F.expr(m.generated) if generate else F.lit(None)
        else:
            c = compile_column(m)
        out.append(c.alias(m.target))
    return df.select(*out)


# ---------------------------------------------------------------- P11 - P17

def align_to_schema(df: DataFrame, target_columns: Sequence[str]) -> DataFrame:
    """Case-insensitive name match of source to target columns, in source
    order, under the target spelling; unmatched columns are left out."""
    lookup = {t.lower(): t for t in target_columns}
    cols = [F.col(f"`{c}`").alias(lookup[c.lower()]) for c in df.columns if c.lower() in lookup]
    if not cols:
        raise ValueError("no source column matches the target schema")
    return df.select(*cols)


def select_columns(df: DataFrame, include: Sequence[str] | None = None,
                   exclude: Sequence[str] | None = None) -> DataFrame:
    """Keep an include list, or drop an exclude list."""
    if include and exclude:
        raise ValueError("give include or exclude, not both")
    if include:
        return df.select(*include)
    if exclude:
        return df.drop(*exclude)
    return df


def reverse_mapping(df: DataFrame, mapping: TableMap | Sequence[ColumnMap]) -> DataFrame:
    """Destination -> source names, for 1:1 direct mappings only."""
    cols = mapping.columns if isinstance(mapping, TableMap) else tuple(mapping)
    pairs = [(m.target, m.source) for m in cols if m.kind == "direct" and m.source]
    return df.select(*[F.col(t).alias(s.split(".")[-1]) for t, s in pairs])


def strip_change_metadata(df: DataFrame, drop_source_tags: bool = False) -> DataFrame:
    """Drop change-capture columns (``__$...``), optionally ``_source...`` too."""
    drop = [c for c in df.columns
            if c.startswith("__$") or (drop_source_tags and c.startswith("_source"))]
    return df.drop(*drop)


def with_operation(df: DataFrame, op_col: str = "op_code", name: str = "operation") -> DataFrame:
    """Add the decoded operation name."""
    return df.withColumn(name, decode_operation(op_col))


def with_record_id(df: DataFrame, keys: Sequence[str], name: str = "record_id") -> DataFrame:
    """Add the ``|``-joined key text."""
    return df.withColumn(name, record_id(list(keys)))
