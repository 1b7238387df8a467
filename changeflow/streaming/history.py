"""Dimension history kept while changes arrive (C20 streaming).

``HistoryTable`` stores every version of a key with the interval it is valid
in, deletes included as versions without a row, so the intervals of a key
tile its time line.  A batch's events split the intervals they fall into: the
history of the keys it touches is drawn again from their stored versions and
the events, all other keys are copied.  Events may arrive in any order; a late
one takes its place between the versions around it.

Versions are ordered block-wise (``operators.ordered``), so a key may have any
number of them.  Batches are appended as deltas and folded when the table is
read or compacted, as in ``streaming.stream``; deltas are written by batch id, so
a replayed batch changes nothing.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType

from changeflow.functions.columns import OP_DELETE, OP_INSERT, OP_UPDATE_AFTER
from changeflow.operators import changes as ch
from changeflow.operators.ordered import keyed_neighbor
from changeflow.streaming.stream import _Compacted, _read_batches, _write_batch

INTERVAL = ("expiration_date", "is_current")


def history_schema(feed: StructType, time_col: str = "change_time") -> StructType:
    """The stored form of a feed: its columns, and a version's end."""
    return StructType([*feed.fields, StructField(INTERVAL[0], feed[time_col].dataType), StructField(INTERVAL[1], BooleanType())])


@dataclass
class HistoryTable(_Compacted):
    """SCD type 2 versions; ``schema`` is ``history_schema`` of the feed."""
    keys: Sequence[str] = ()
    time_col: str = "change_time"
    order: Sequence[str] = ch.ORDER
    op_col: str = "op_code"

    @property
    def events_path(self) -> str:
        return os.path.join(self.root, "events")

    def delta_paths(self) -> list[str]:
        return [self.events_path]

    def event_columns(self) -> list[str]:
        return [c for c in self.schema.fieldNames() if c not in INTERVAL]

    def append(self, spark: SparkSession, feed: DataFrame, batch_id: int) -> None:
        events = feed.filter(F.col(self.op_col).isin(OP_DELETE, OP_INSERT, OP_UPDATE_AFTER))
        _write_batch(events.select(*self.event_columns()), self.events_path, batch_id)

    def fold(self, versions: DataFrame, events: DataFrame) -> DataFrame:
        """The versions after ``events``: keys without any are copied."""
        touched = events.select(*[F.col(k).alias(f"_k_{k}") for k in self.keys]).distinct()
        same = F.lit(True)
        for k in self.keys:
            same = same & versions[k].eqNullSafe(touched[f"_k_{k}"])
        cols = self.event_columns()
        drawn = versions.join(touched, same, "left_semi").select(*cols).unionByName(events.select(*cols))
        after = keyed_neighbor(drawn.withColumn("_follows", F.lit(True)), list(self.keys), list(self.order),
                               [self.time_col, "_follows"], "next", prefix="_next_")
        after = after.select(*cols, F.col(f"_next_{self.time_col}").alias(INTERVAL[0]), F.col("_next__follows").isNull().alias(INTERVAL[1]))
        return versions.join(touched, same, "left_anti").unionByName(after).select(*self.schema.fieldNames())

    def current(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """All versions, deletes included."""
        base, v = self.base(spark)
        later = _read_batches(spark, self.events_path, v, upto)
        return base if later is None else self.fold(base, later)

    def history(self, spark: SparkSession) -> DataFrame:
        """The feed's columns but the operation, effective_date,
        expiration_date and is_current of every version that has a row."""
        cols = [c for c in self.event_columns() if c not in (self.op_col, self.time_col)]
        return self.current(spark).filter(F.col(self.op_col) != OP_DELETE).select(
            *cols, F.col(self.time_col).alias("effective_date"), *INTERVAL)


def start_history(stream: DataFrame, table: HistoryTable, checkpoint: str, compact_every: int = 8,
                  trigger: Mapping[str, object] | None = None) -> StreamingQuery:
    """Keep ``table`` from a stream of changes."""
    spark = stream.sparkSession

    def fn(batch: DataFrame, batch_id: int) -> None:
        table.append(spark, batch, batch_id)
        if compact_every and (batch_id + 1) % compact_every == 0:
            table.compact(spark, batch_id)

    w = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    return w.trigger(**(dict(trigger) if trigger else {"availableNow": True})).start()
