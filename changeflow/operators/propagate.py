"""Change propagation through a merge.

A destination row is merged from rows of several sources, each with keys of
its own.  When rows of any source change, the destination keys they
contributed to, or contribute to now, are found by joining the changed rows
outward along the merge's join conditions, from the changed source to the one
that holds the destination key.  Only those keys are merged again and
replaced.

The trace takes both images of a change, so rows that moved from one key to
another touch both, and joins them with the other sources' current rows *and*
their changed images of the same batch, so changes of several sources may
arrive together.  It starts from the changed rows: every join on the way has
a side that is as small as the batch.  The keys found may be more than those
whose result differs (they are merged again to what they were), never less.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.operators.merge import (JOIN_TYPES, SET_OPS, MergeSpec, Source, Step, aliases_in, key_equivalents,
                                        output_column, run_merge)
from changeflow.session import written


def _conditions(spec: MergeSpec) -> list[tuple[set[str], Step]]:
    """The join steps with the sources that their conditions name."""
    known = {s.alias for s in spec.sources}
    out = []
    for st in spec.steps:
        if st.op not in JOIN_TYPES:
            raise ValueError(f"keys cannot be traced through a {st.op} step beside joins")
        out.append(((aliases_in(st.on) & known) | {st.source}, st))
    return out


def _needed(spec: MergeSpec, start: str, goal: str) -> set[str]:
    """Sources on the way between two: a step's condition needs all it names."""
    conditions, needed = _conditions(spec), {start, goal}
    while True:
        more = set().union(*(named for named, st in conditions if st.source in needed)) - needed
        if not more:
            return needed
        needed |= more


def _with_images(source: Source, images: DataFrame | None) -> DataFrame:
    """A source's current rows, and its changed images of the batch."""
    rows = source.df if images is None else source.df.unionByName(images.select(*source.df.columns))
    return (rows.filter(F.expr(source.where)) if source.where else rows).alias(source.alias)


def trace_keys(spec: MergeSpec, alias: str, images: Mapping[str, DataFrame], dest_key: str) -> DataFrame:
    """(dest_key): destination keys that the changed rows ``images[alias]``
    meet through the joins."""
    held = output_column(spec, dest_key)
    if held is None:
        raise ValueError(f"{dest_key!r} is not one source's column in the output")
    source = spec.source(alias)
    needed = _needed(spec, alias, held[0])
    changed = images[alias].select(*source.df.columns)
    out = (changed.filter(F.expr(source.where)) if source.where else changed).alias(alias)
    reached, open_ = {alias}, [c for c in _conditions(spec) if c[1].source in needed]
    while held[0] not in reached:
        # the next source that a condition ties to those reached
        ready = set().union(*(named - reached for named, _ in open_ if named & reached and len(named - reached) == 1))
        if not ready:
            raise ValueError(f"no chain of join conditions leads from {alias!r} to {dest_key!r}")
        nxt = next(s.alias for s in spec.sources if s.alias in ready)
        reached.add(nxt)
        own = [st.on for named, st in open_ if named <= reached]
        open_ = [c for c in open_ if not c[0] <= reached]
        out = out.join(_with_images(spec.source(nxt), images.get(nxt)), F.expr(" AND ".join(f"({c})" for c in own)), "inner")
    return out.select(F.col(f"{held[0]}.{held[1]}").alias(dest_key)).distinct()


def _set_keys(spec: MergeSpec, alias: str, images: DataFrame, dest_key: str) -> DataFrame:
    """Keys of a source of set operations: the column in the key's place."""
    first = spec.sources[0].df.columns
    source = spec.source(alias)
    column = next((e for e, n in spec.output if n == dest_key), dest_key)
    if column not in first:
        raise ValueError(f"{dest_key!r} is not a column of the first source")
    rows = images.select(*source.df.columns)
    rows = rows.filter(F.expr(source.where)) if source.where else rows
    return rows.select(F.col(source.df.columns[first.index(column)]).alias(dest_key)).distinct()


def affected_keys(spec: MergeSpec, images: Mapping[str, DataFrame], dest_key: str) -> DataFrame:
    """(dest_key): the distinct destination keys touched by a batch.

    ``images`` maps a source's alias to its changed rows, before and after
    images alike, with the source's columns; the sources of ``spec`` are in the
    state after the batch.  With right or full joins the null key is always
    among them: which unmatched rows come and go cannot be told from keys."""
    if not images:
        raise ValueError("no source has changed")
    sets = bool(spec.steps) and all(st.op in SET_OPS for st in spec.steps)
    out = None
    for alias, rows in images.items():
        keys = _set_keys(spec, alias, rows, dest_key) if sets else trace_keys(spec, alias, images, dest_key)
        out = keys if out is None else out.unionByName(keys)
    if _keeps_unmatched(spec):
        out = out.unionByName(out.sparkSession.range(1).select(F.lit(None).cast(out.schema[dest_key].dataType).alias(dest_key)))
    return out.distinct()


def _keeps_unmatched(spec: MergeSpec) -> bool:
    """Whether rows may come out that met no row of the first source."""
    return any(st.op in ("right", "full") for st in spec.steps)


def merge_keys(spark: SparkSession, spec: MergeSpec, keys: DataFrame, dest_key: str) -> DataFrame:
    """The merge's rows of the destination keys ``keys`` (dest_key), null
    included.  Sources that hold the key, by an equality of the joins, are
    restricted to it before the joins; the others are met through them.  Rows
    of a null key that a right or full join keeps are those of the whole merge."""
    if _keeps_unmatched(spec):
        whole = run_merge(spark, spec)
        null = keys.filter(F.col(dest_key).isNull()).select(F.lit(True).alias("_any")).limit(1)
        unmatched = whole.filter(F.col(dest_key).isNull()).join(null, F.col("_any"), "left_semi")
        return _merge_held(spark, spec, keys.filter(F.col(dest_key).isNotNull()), dest_key).unionByName(unmatched)
    return _merge_held(spark, spec, keys, dest_key)


def _merge_held(spark: SparkSession, spec: MergeSpec, keys: DataFrame, dest_key: str) -> DataFrame:
    named = keys.select(F.col(dest_key).alias("_k"))
    sets = bool(spec.steps) and all(st.op in SET_OPS for st in spec.steps)
    same = {} if sets else key_equivalents(spec, dest_key)
    sources = []
    for s in spec.sources:
        if s.alias in same:
            base = s.df.filter(F.expr(s.where)) if s.where else s.df
            sources.append(replace(s, df=base.join(named, base[same[s.alias]].eqNullSafe(named["_k"]), "left_semi"), where=None))
        else:
            sources.append(s)
    merged = run_merge(spark, replace(spec, sources=tuple(sources)))
    return merged.join(named, merged[dest_key].eqNullSafe(named["_k"]), "left_semi")


def propagate(spark: SparkSession, spec: MergeSpec, images: Mapping[str, DataFrame], destination: DataFrame,
              dest_key: str) -> DataFrame:
    """The destination after a batch of changes of any sources: rows of the
    affected keys are merged again, all others stay.  Keys that no longer come
    out of the merge disappear."""
    keys = written(affected_keys(spec, images, dest_key), "affected-keys")
    k = keys.select(F.col(dest_key).alias("_k"))
    kept = destination.join(k, destination[dest_key].eqNullSafe(k["_k"]), "left_anti")
    return kept.unionByName(merge_keys(spark, spec, keys, dest_key).select(*destination.columns))
