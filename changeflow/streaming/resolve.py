"""Conflict resolution while changes arrive (C15 - C17 streaming).

``ResolvedTable`` keeps one resolved row per key as merge-on-read state: a
base of resolved rows, and what later batches brought.  Its rows carry the
change order and the source they were resolved by, so resolving a base with
later rows equals resolving all events at once, however they were split.

latest, priority  ``start_resolution`` is a stateful query: each key's
                  winning row lives in the state store (RocksDB unless the
                  session names another), a batch emits the keys whose events
                  it saw, and the table appends one row for each of them.
custom            rules are SQL over ``old`` and ``new`` and may depend on the
                  order of events; batches append events and the table folds
                  them when it is read or compacted.  An event that is not
                  after the base's last one of its key is an error, unless
                  the rules are declared commutative.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from changeflow.operators.merge import resolve_conflicts
from changeflow.streaming.stream import _Compacted, _read_batches, _write_batch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
LATE = "an event is not after the last one of its key; declare the rules commutative or compact less often"


@dataclass
class ResolvedTable(_Compacted):
    """Resolved rows as base + later rows; ``schema`` holds the keys, the
    value columns, the change order and, if it counts, the source column."""
    keys: Sequence[str] = ()
    rule: str = "latest"
    order: Sequence[str] = ("lsn",)
    source_col: str = "_source_id"
    priority: Sequence[str] = ()
    rules: Mapping[str, str] = field(default_factory=dict)
    commutative: bool = False
    block: int = 1024

    @property
    def rows_path(self) -> str:
        return os.path.join(self.root, "rows")

    def delta_paths(self) -> list[str]:
        return [self.rows_path]

    def resolve(self, events: DataFrame) -> DataFrame:
        """One row per key with all columns of the table; lazy, batch or, for
        latest and priority, streaming."""
        values = [c for c in self.schema.fieldNames() if c not in self.keys]
        rules = {**{c: f"new.{c}" for c in self.order}, **self.rules}
        return resolve_conflicts(events, self.keys, self.rule, values, self.order, self.source_col, self.priority,
                                 rules, self.block, associative=True).select(*self.schema.fieldNames())

    def append(self, spark: SparkSession, rows: DataFrame, batch_id: int) -> None:
        _write_batch(rows.select(*self.schema.fieldNames()), self.rows_path, batch_id)

    def current(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        base, v = self.base(spark)
        later = _read_batches(spark, self.rows_path, v, upto)
        if later is None:
            return base
        if self.rule == "custom" and not self.commutative and v is not None:
            later = self._after(base, later)
        return self.resolve(base.unionByName(later.select(*self.schema.fieldNames())))

    def _after(self, base: DataFrame, later: DataFrame) -> DataFrame:
        """``later``; reading an event that the base already passed raises."""
        same, at = F.lit(True), F.struct(*[F.col(f"_at.{c}") for c in self.order])
        last = base.select(*[F.col(k).alias(f"_k_{k}") for k in self.keys], F.struct(*self.order).alias("_at"))
        for k in self.keys:
            same = same & later[k].eqNullSafe(last[f"_k_{k}"])
        late = F.col("_at").isNotNull() & (F.struct(*self.order) <= at)
        checked = F.when(late, F.raise_error(F.lit(LATE)).cast("string")).otherwise(F.lit(""))
        return (later.join(last, same, "left").withColumn("_checked", checked).filter("_checked = ''")
                .select(*later.columns))


def start_resolution(stream: DataFrame, table: ResolvedTable, checkpoint: str, compact_every: int = 8,
                     trigger: Mapping[str, object] | None = None) -> StreamingQuery:
    """Resolve a feed of one or more sources (``tag_stream``) into ``table``."""
    spark = stream.sparkSession
    if table.rule == "custom":
        out, mode = stream, "append"
    else:
        if spark.conf.get(STATE_STORE).endswith("HDFSBackedStateStoreProvider"):
            spark.conf.set(STATE_STORE, ROCKSDB)
        out, mode = table.resolve(stream), "update"

    def fn(batch: DataFrame, batch_id: int) -> None:
        table.append(spark, batch, batch_id)
        if compact_every and (batch_id + 1) % compact_every == 0:
            table.compact(spark, batch_id)

    w = out.writeStream.outputMode(mode).foreachBatch(fn).option("checkpointLocation", checkpoint)
    return w.trigger(**(dict(trigger) if trigger else {"availableNow": True})).start()
