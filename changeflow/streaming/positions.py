"""The change feed read by positions.

``FeedPositions`` keeps, for every source of a feed, the position (lsn,
seqval, ...) up to which it has been consumed.  ``poll_feed`` reads the range
(last, now] of each source, exclusive below and inclusive above, with the
bounds as predicates of the scan, hands it to ``apply`` as one batch and then
commits the positions: an append of one small file per batch.

A batch that was handed over but not committed is read again with the same id
and the same upper bounds, which are written before it is applied; sinks that
write by batch id (``ChangeTable.append``) therefore end in the same state.
Rows that turn up later at or before a committed position, late files
included, are not read again.  A source that was never read starts at its
first position; a source without news keeps its position.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from changeflow.operators import changes as ch
from changeflow.streaming.stream import _read_if_any

NO_SOURCE = ""


class FeedPositions:
    """Positions per source under ``root``: ``planned`` holds the upper bounds
    of every batch, ``done`` the batches that were applied.  Both have a row
    per source and batch; the positions of a batch reach the driver, one row
    a source."""

    def __init__(self, spark: SparkSession, root: str, order: Sequence[str] = ch.ORDER, source_col: str | None = None):
        self.spark, self.root, self.order, self.source_col = spark, root, list(order), source_col

    def _log(self, name: str) -> DataFrame | None:
        return _read_if_any(self.spark, os.path.join(self.root, name))

    def last_batch(self, name: str = "done") -> int:
        log = self._log(name)
        return -1 if log is None else log.agg(F.max("batch_id")).first()[0]

    def bounds(self, batch_id: int) -> dict[str, tuple]:
        """Source -> upper position after batch ``batch_id``."""
        log = self._log("planned")
        if log is None or batch_id < 0:
            return {}
        last = log.filter(F.col("batch_id") <= batch_id).groupBy("source").agg(F.max_by("upto", "batch_id").alias("upto"))
        return {r.source: tuple(r.upto) for r in last.collect()}

    def plan(self, feed: DataFrame, batch_id: int) -> dict[str, tuple]:
        """Upper bounds of the next batch, written before it is applied: the
        last position of every source with rows after its committed one."""
        source = F.col(self.source_col).cast("string") if self.source_col else F.lit(NO_SOURCE)
        news = feed.filter(self._after(self.bounds(batch_id - 1), feed.schema))
        upto = (news.groupBy(F.coalesce(source, F.lit(NO_SOURCE)).alias("source"))
                .agg(F.max(F.struct(*self.order)).alias("upto")).withColumn("batch_id", F.lit(batch_id).cast("long")))
        upto.coalesce(1).write.mode("overwrite").parquet(os.path.join(self.root, "planned", f"b={batch_id:012d}"))
        return self.bounds(batch_id)

    def commit(self, batch_id: int) -> None:
        self.spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id")).coalesce(1).write.mode("overwrite") \
            .parquet(os.path.join(self.root, "done", f"b={batch_id:012d}"))

    def _compare(self, position: tuple, schema: StructType, beyond: bool) -> Column:
        """Whether a row's position is beyond ``position``, or not: by columns,
        so that the first reaches the scan as a predicate."""
        cond = F.lit(not beyond)
        for name, value in reversed(list(zip(self.order, position))):
            v = F.lit(value).cast(schema[name].dataType)
            strict = F.col(name) > v if beyond else F.col(name) < v
            cond = strict | ((F.col(name) == v) & cond)
        first = F.lit(position[0]).cast(schema[self.order[0]].dataType)
        return (F.col(self.order[0]) >= first if beyond else F.col(self.order[0]) <= first) & cond

    def _of(self, source: str) -> Column:
        if not self.source_col:
            return F.lit(True)
        c = F.col(self.source_col).cast("string")
        return c.isNull() | (c == NO_SOURCE) if source == NO_SOURCE else c == source

    def _after(self, bounds: dict[str, tuple], schema: StructType) -> Column:
        if not bounds:
            return F.lit(True)
        known, cond = F.lit(False), F.lit(False)
        for source, position in bounds.items():
            known = known | F.coalesce(self._of(source), F.lit(False))
            cond = cond | (self._of(source) & self._compare(position, schema, True))
        return cond | ~known

    def batch(self, feed: DataFrame, batch_id: int) -> DataFrame:
        """The rows of a planned batch: (last, now] of every source."""
        upto, cond = self.bounds(batch_id), F.lit(False)
        for source, position in upto.items():
            cond = cond | (self._of(source) & self._compare(position, feed.schema, False))
        return feed.filter(self._after(self.bounds(batch_id - 1), feed.schema)).filter(cond)


def poll_feed(positions: FeedPositions, feed: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None],
              max_batches: int | None = None) -> int:
    """Apply what is new in ``feed()`` batch by batch until nothing is; the
    number of batches.  ``feed`` is called for each batch, so that files that
    arrived meanwhile are seen."""
    n = 0
    while max_batches is None or n < max_batches:
        done = positions.last_batch()
        batch_id, rows = done + 1, feed()
        planned = positions.last_batch("planned") if positions._log("planned") is not None else -1
        if planned is None or planned <= done:
            before = positions.bounds(done)
            if positions.plan(rows, batch_id) == before:
                return n
        apply(positions.batch(rows, batch_id), batch_id)
        positions.commit(batch_id)
        n += 1
    return n
