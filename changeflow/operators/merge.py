"""Multi-source merge (J1-J8, J13, U1-U8) and conflict resolution
(C13-C17).

A merge is a left fold over DataFrames: the first source starts the
result, each step joins or set-combines the next source (or runs free SQL
over the sources and the previous result).  DataFrame aliases survive the
joins, so output expressions may say ``crm.name`` and Catalyst still prunes
columns and pushes each source's predicate into its scan.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.operators.skew import DEFAULT_BROADCAST_ROWS, broadcast_if_small

JOIN_TYPES = {"inner": "inner", "left": "left", "right": "right", "full": "full_outer"}
SET_OPS = ("union_all", "union", "intersect", "except")


@dataclass(frozen=True)
class Source:
    """S3: an aliased source with an optional predicate (SQL text)."""
    alias: str
    df: DataFrame
    where: str | None = None
    key: str | None = None          # join key column (C13, C14)

    def frame(self) -> DataFrame:
        out = self.df if not self.where else self.df.filter(F.expr(self.where))
        return out.alias(self.alias)


@dataclass(frozen=True)
class Step:
    """One merge step: a join (``inner/left/right/full`` + condition), a set
    operation with a source, or custom SQL over sources and ``previous_result``."""
    op: str
    source: str | None = None
    on: str | None = None
    sql: str | None = None

    def __post_init__(self):
        if self.op in JOIN_TYPES:
            if not (self.source and self.on):
                raise ValueError(f"{self.op} join needs a source and a condition")
        elif self.op in SET_OPS:
            if not self.source:
                raise ValueError(f"{self.op} needs a source")
        elif self.op == "custom":
            if not self.sql:
                raise ValueError("custom step needs SQL text")
        else:
            raise ValueError(f"unknown merge step {self.op!r}")


@dataclass(frozen=True)
class MergeSpec:
    sources: tuple[Source, ...]
    steps: tuple[Step, ...]
    output: tuple[tuple[str, str], ...] = ()    # (expression, output name)

    def __post_init__(self):
        aliases = [s.alias for s in self.sources]
        if len(aliases) < 2:
            raise ValueError("a merge needs at least two sources")
        if len(set(aliases)) != len(aliases):
            raise ValueError("duplicate source alias")
        for st in self.steps:
            if st.source and st.source not in aliases:
                raise ValueError(f"unknown source {st.source!r}")

    def source(self, alias: str) -> Source:
        for s in self.sources:
            if s.alias == alias:
                return s
        raise KeyError(alias)


_ALIAS_REF = re.compile(r"\b([A-Za-z_][A-Za-z0-9_]*)\.[A-Za-z_`]")


def run_merge(spark: SparkSession, spec: MergeSpec) -> DataFrame:
    """Fold the steps; then the output projection."""
    frames = {s.alias: s.frame() for s in spec.sources}
    result = frames[spec.sources[0].alias]
    aliases_live = True
    for st in spec.steps:
        if st.op in JOIN_TYPES:
            result = result.join(frames[st.source], F.expr(st.on), JOIN_TYPES[st.op])
        elif st.op == "union_all":
            result, aliases_live = result.union(frames[st.source]), False
        elif st.op == "union":
            result, aliases_live = result.union(frames[st.source]).distinct(), False
        elif st.op == "intersect":
            result, aliases_live = result.intersect(frames[st.source]), False
        elif st.op == "except":
            result, aliases_live = result.subtract(frames[st.source]), False
        else:  # custom SQL: sources and the previous result as temp views
            for a, f in frames.items():
                f.createOrReplaceTempView(a)
            result.createOrReplaceTempView("previous_result")
            result, aliases_live = spark.sql(st.sql), False
    if not spec.output:
        return result
    if not aliases_live:
        for expr, _ in spec.output:
            m = _ALIAS_REF.search(expr)
            if m and m.group(1) in frames:
                raise ValueError(f"output {expr!r} names source {m.group(1)!r}, "
                                 "which is out of scope after a set operation")
    return result.select(*[F.expr(e).alias(n) for e, n in spec.output])


def merge_preview(df: DataFrame, order: Sequence[str], n: int = 100) -> DataFrame:
    """U8: first ``n`` rows in a declared order (a top-k, not a full sort)."""
    return df.orderBy(*order).limit(n)


# ---------------------------------------------------------------- J7 / J8 / J13

def lookup_enrich(df: DataFrame, ref: DataFrame, on: Sequence[str] | str,
                  columns: Sequence[str], prefix: str = "",
                  max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
                  dedupe: bool = True) -> DataFrame:
    """Left join a reference table and add chosen columns.

    The reference is reduced to one row per key (so the join cannot multiply
    rows) and broadcast only when it provably fits; otherwise it is a normal
    shuffle join that AQE may still turn into a broadcast at run time."""
    keys = [on] if isinstance(on, str) else list(on)
    r = ref.select(*keys, *columns)
    if dedupe:
        # one whole reference row per key (the smallest), never values mixed from rows
        r = r.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("_r")) \
             .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in columns])
    if prefix:
        r = r.select(*keys, *[F.col(c).alias(prefix + c) for c in columns])
    return df.join(broadcast_if_small(r, max_broadcast_rows), keys, "left")


def multi_lookup(df: DataFrame, lookups: Sequence[tuple[DataFrame, Sequence[str] | str, Sequence[str]]]
                 ) -> DataFrame:
    """Chained lookups."""
    for ref, on, cols in lookups:
        df = lookup_enrich(df, ref, on, cols)
    return df


def workflow_join(left: DataFrame, right: DataFrame, mode: str = "merge",
                  key: Sequence[str] | str | None = None, how: str = "inner") -> DataFrame:
    """``merge`` by key, or ``union`` by column name."""
    if mode == "union":
        return left.unionByName(right, allowMissingColumns=True)
    if mode != "merge" or not key:
        raise ValueError("merge needs a key; mode is merge or union")
    return left.join(right, [key] if isinstance(key, str) else list(key), how)


# ---------------------------------------------------------------- C13 / C14

_EQ = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)\.([A-Za-z_][A-Za-z0-9_]*)\s*=\s*"
                 r"([A-Za-z_][A-Za-z0-9_]*)\.([A-Za-z_][A-Za-z0-9_]*)")


def join_key_of(spec: MergeSpec, alias: str) -> str:
    """The declared key of a source, else the column of ``alias`` in the
    first equality of the first join condition."""
    src = spec.source(alias)
    if src.key:
        return src.key
    for st in spec.steps:
        if st.op in JOIN_TYPES and st.on:
            m = _EQ.search(st.on)
            if m:
                if m.group(1) == alias:
                    return m.group(2)
                if m.group(3) == alias:
                    return m.group(4)
            break
    raise ValueError(f"no join key for source {alias!r}")


def aliases_in(text: str) -> set[str]:
    """Qualifiers of ``qualifier.column`` in SQL text."""
    return {m.group(1) for m in _ALIAS_REF.finditer(text)}


_COLUMN = re.compile(r"\s*([A-Za-z_][A-Za-z0-9_]*)\.([A-Za-z_][A-Za-z0-9_]*)\s*")
_NOT_ALL_HOLD = re.compile(r"\b(or|not|case|when|if|coalesce)\b", re.IGNORECASE)


def output_column(spec: MergeSpec, name: str) -> tuple[str, str] | None:
    """(alias, column) if the output column is just a source's column."""
    for expr, out in spec.output:
        if out == name:
            m = _COLUMN.fullmatch(expr)
            return (m.group(1), m.group(2)) if m else None
    return None


def _equal_columns(spec: MergeSpec, column: tuple[str, str]) -> dict[str, str]:
    """alias -> the column that the join conditions make equal to ``column``
    wherever the source takes part in a row.  Conditions that need not hold
    as a whole (OR, NOT, CASE) say nothing."""
    equal = {column}
    pairs = [((m.group(1), m.group(2)), (m.group(3), m.group(4))) for st in spec.steps
             if st.op in JOIN_TYPES and not _NOT_ALL_HOLD.search(st.on) for m in _EQ.finditer(st.on)]
    while True:
        more = {y for x, y in [*pairs, *((y, x) for x, y in pairs)] if x in equal} - equal
        if not more:
            return dict(sorted(equal))
        equal |= more


def key_equivalents(spec: MergeSpec, dest_key: str) -> dict[str, str]:
    """alias -> column for the sources that hold the destination key: the one
    its output column comes from and those tied to it by equalities."""
    held = output_column(spec, dest_key)
    known = {s.alias for s in spec.sources}
    return {a: c for a, c in _equal_columns(spec, held).items() if a in known} if held and held[0] in known else {}


def restrict_to_keys(spec: MergeSpec, keys: DataFrame, key_col: str,
                     aliases: Sequence[str] | None = None, dest_key: str | None = None) -> MergeSpec:
    """C14 step 1: semi-join sources to the affected keys before the merge,
    so only those keys are re-merged.  By default these are the sources that
    hold the destination key: the column behind ``dest_key``, or without one
    the first declared key, and what the join conditions make equal to it.  A
    source keyed in another domain (a lookup) stays whole, declared key or not."""
    kd = keys.select(F.col(key_col).alias("_k")).distinct()
    if aliases is not None:
        chosen = {a: join_key_of(spec, a) for a in aliases}
    else:
        chosen = key_equivalents(spec, dest_key) if dest_key else {}
        first = next((s for s in spec.sources if s.key), None)
        if not chosen and first is not None:
            chosen = _equal_columns(spec, (first.alias, first.key))
    new_sources = []
    for s in spec.sources:
        if s.alias not in chosen:
            new_sources.append(s)
            continue
        base = s.df if not s.where else s.df.filter(F.expr(s.where))
        restricted = base.join(kd, base[chosen[s.alias]] == kd["_k"], "left_semi")
        new_sources.append(Source(s.alias, restricted, None, s.key))
    return MergeSpec(tuple(new_sources), spec.steps, spec.output)


def remerge_affected(spark: SparkSession, spec: MergeSpec, changed: DataFrame, key_col: str,
                     destination: DataFrame, dest_key: str,
                     aliases: Sequence[str] | None = None) -> DataFrame:
    """C14: re-run the merge for the destination keys touched by a batch of
    changes and replace those keys in the destination.  Keys that no longer
    come out of the merge are removed (merged deletes take effect).  Changes
    keyed otherwise go through ``propagate``."""
    affected = changed.select(F.col(key_col).alias(dest_key)).distinct()
    merged = run_merge(spark, restrict_to_keys(spec, affected, dest_key, aliases, dest_key))
    kept = destination.join(affected, dest_key, "left_anti")
    return kept.unionByName(merged.join(affected, dest_key, "left_semi").select(*destination.columns))


# ---------------------------------------------------------------- C15 - C17

def resolve_conflicts(events: DataFrame, keys: Sequence[str], rule: str = "latest",
                      columns: Sequence[str] | None = None, order: Sequence[str] = ("lsn",),
                      source_col: str = "_source_id", priority: Sequence[str] = (),
                      rules: Mapping[str, str] | None = None, block: int = 1024,
                      associative: bool = False) -> DataFrame:
    """One row per key from competing events.

    latest    newest event wins (``max_by`` on the change order)            C15
    priority  first source in ``priority`` wins, unlisted sources last, the
              newest event within a source                                  C16
    custom    per-column SQL over ``old`` and ``new`` (an ordered fold; the
              rule must be associative, e.g. greatest, sum, concat, and
              declared so with ``associative=True``)                        C17

    ``order`` is the full change order; its columns may be of any type."""
    keys = list(keys)
    cols = list(columns) if columns is not None else [c for c in events.columns if c not in keys]
    if rule == "latest":
        r = events.groupBy(*keys).agg(
            F.max_by(F.struct(*cols), F.struct(*[F.col(c) for c in order])).alias("_r"))
    elif rule == "priority":
        rank = F.lit(len(priority))
        for i, s in reversed(list(enumerate(priority))):
            rank = F.when(F.col(source_col) == s, F.lit(i)).otherwise(rank)
        r = events.groupBy(*keys).agg(
            F.max_by(F.struct(*cols), F.struct((-rank).alias("_rank"), *[F.col(c) for c in order])).alias("_r"))
    elif rule == "custom":
        return ordered_fold(events, keys, cols, dict(rules or {}), order, block, associative)
    else:
        raise ValueError(f"unknown conflict rule {rule!r}")
    return r.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def ordered_fold(events: DataFrame, keys: Sequence[str], cols: Sequence[str],
                 rules: Mapping[str, str], order: str | Sequence[str], block: int = 1024,
                 associative: bool = False) -> DataFrame:
    """Fold events of each key in change order with ``old``/``new`` rules.

    Bounded multi-level reduction: events are numbered per key in ``order``
    (block-wise, any type of position), level i folds ``block`` consecutive
    results of the level before, so a group never holds more than ``block``
    of them, whatever the key's size and however often positions repeat.
    That is one answer for every ``block`` only if the rules are associative:
    a caller must declare it, other rules are refused."""
    from changeflow.operators.ordered import keyed_row_number
    keys = list(keys)
    if not associative:
        raise ValueError("declare the rules associative: rule(rule(a, b), c) = rule(a, rule(b, c)) must hold")
    missing = [c for c in cols if c not in rules]
    if missing:
        raise ValueError(f"no rule for columns {missing}")
    fields = ", ".join(f"'{c}', {rules[c]}" for c in cols)
    merge = f"(old, new) -> named_struct('_p', new._p, {fields})"
    by = [order] if isinstance(order, str) else list(order)
    numbered = keyed_row_number(events.select(*keys, *{c: None for c in [*by, *cols] if c not in keys}), keys, by, "_p")
    cur = numbered.select(F.struct(*keys).alias("_k"), F.struct((F.col("_p") - 1).alias("_p"),
                                                                *[F.col(c) for c in cols]).alias("_e"))
    most = numbered.agg(F.max("_p")).first()[0] or 1     # events of the largest key: one number
    size = block
    while True:
        last = size >= most
        grp = ["_k"] if last else ["_k", F.floor(F.col("_e._p") / F.lit(size)).alias("_b")]
        cur = cur.groupBy(*grp).agg(F.array_sort(F.collect_list("_e")).alias("_a"))
        cur = cur.select("_k", F.expr(
            f"aggregate(slice(_a, 2, greatest(size(_a) - 1, 0)), _a[0], {merge})").alias("_e"))
        if last:
            break
        size *= block
    return cur.select(*[F.col(f"_k.{k}").alias(k) for k in keys], *[F.col(f"_e.{c}").alias(c) for c in cols])
