"""Registered checks: every operator as a (Spark query, SQL oracle) pair.

Each entry is a callable ``(spark, sf_dir) -> DataFrame`` that reads the
shared tables (or data Spark derives from them) and applies one operator of
the package, plus - when the operator is expressible in SQL - the equivalent
SQL text run by an independent engine over the same files.  Column names
are aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register ``fn`` under ``name`` with its SQL oracle."""
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate check {name!r}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    # importing the modules fills the registries
    import importlib
    for m in MODULES:
        importlib.import_module(f"changeflow.catalog.{m}")


MODULES = ("changes_q", "load_q", "mapping_q", "merge_q", "transforms_q", "reconcile_q", "patterns_q", "telemetry_q", "io_q", "stream_q", "propagate_q", "graph_q")
