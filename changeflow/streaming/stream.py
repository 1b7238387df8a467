"""Structured Streaming change application (C9, C11, C12, C14 streaming).

A change table directory is read with ``readStream``; the stream's
checkpoint replaces the reference's position file (progress is committed
only after a batch's writes, so a failed batch is replayed, never skipped).

The destination is **merge-on-read**, so a micro-batch costs work in
proportion to the batch, not to the destination:

* each batch appends its (already filtered) change rows under
  ``<root>/changes/batch_id=<b>`` with dynamic partition overwrite - a
  replayed batch rewrites its own partition, so appends are idempotent;
* the current state is ``fold(base, changes after the base)`` with the batch
  operators of ``operators.changes``, in arrival order: by batch, then by
  position within the batch, as positions of two sources do not compare.  The
  strict fold composes, so folding many batches at once equals folding them
  one by one, whatever ``compact_every`` is;
* generated values are drawn once, when a batch is appended;
* every ``compact_every`` batches the state is folded into a new base
  version ``<root>/base/v=<b>`` - a new location, never the one being read -
  and the version is appended to a small Parquet log.  A replay of a
  compacted batch skips the compaction.  Deltas and bases that only states
  before the previous version need are then removed; readers have one whole
  compaction period to finish with them.

Per-event outcomes (C22) are produced at compaction for the compacted
batches and latency records (C21) per batch; both are written to
``batch_id`` partitions with dynamic overwrite, so they are idempotent too.
C14 re-merges use the same layout with "replace these keys" deltas.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from changeflow.operators import changes as ch
from changeflow.operators.merge import MergeSpec, restrict_to_keys, run_merge
from changeflow.session import remove_paths


def read_feed_stream(spark: SparkSession, path: str, schema: StructType | str,
                     files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """The change table directory as a stream (new files are new changes)."""
    r = spark.readStream.schema(schema).format("parquet")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(files_per_trigger))
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


def tag_stream(stream: DataFrame, source_id: str, alias: str | None = None) -> DataFrame:
    """Tag a source's stream; union tagged streams with ``unionByName``."""
    return stream.withColumn("_source_id", F.lit(source_id)) \
                 .withColumn("_source_alias", F.lit(alias or source_id))


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite") \
      .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def _read_if_any(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet data under ``path``, None if nothing was written yet.  Any
    other failure to read is raised: state must never silently start empty."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None        # no folder, or a folder without a data file
        raise


def _read_batches(spark: SparkSession, path: str, after: int | None, upto: int | None
                  ) -> DataFrame | None:
    """Rows of batches in (after, upto]; ``batch_id`` prunes partitions."""
    df = _read_if_any(spark, path)
    if df is None or "batch_id" not in df.columns:
        return None
    df = df.withColumn("batch_id", F.col("batch_id").cast("long"))
    if after is not None:
        df = df.filter(F.col("batch_id") > after)
    if upto is not None:
        df = df.filter(F.col("batch_id") <= upto)
    return df


def _children(spark: SparkSession, path: str, prefix: str) -> dict[int, str]:
    """Number -> path of the folders ``<prefix><number>`` under ``path``."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return {}
    names = [st.getPath().getName() for st in fs.listStatus(top)]
    return {int(n[len(prefix):]): os.path.join(path, n) for n in names
            if n.startswith(prefix) and n[len(prefix):].isdigit()}


@dataclass
class _Compacted:
    """Base versions plus per-batch deltas under ``root``."""
    root: str
    schema: StructType

    @property
    def log_path(self) -> str:
        return os.path.join(self.root, "_base_log")

    def base_path(self, version: int) -> str:
        return os.path.join(self.root, "base", f"v={version + 1:012d}")

    def base_version(self, spark: SparkSession) -> int | None:
        log = _read_if_any(spark, self.log_path)
        return None if log is None else log.agg(F.max("version")).first()[0]

    def init(self, spark: SparkSession, df: DataFrame, version: int = -1) -> None:
        """Write the starting state (e.g. the initial snapshot, C5)."""
        df.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(self.base_path(version))
        spark.createDataFrame([(version,)], "version long").write.mode("append").parquet(self.log_path)

    def base(self, spark: SparkSession) -> tuple[DataFrame, int | None]:
        v = self.base_version(spark)
        if v is None:
            return spark.createDataFrame([], self.schema), None
        return spark.read.schema(self.schema).parquet(self.base_path(v)), v

    def current(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        raise NotImplementedError

    def compact(self, spark: SparkSession, upto: int) -> bool:
        """Fold the deltas up to batch ``upto`` into a new base version."""
        v = self.base_version(spark)
        if v is not None and v >= upto:
            return False          # already compacted (replayed batch)
        self.current(spark, upto).write.mode("overwrite").parquet(self.base_path(upto))
        spark.createDataFrame([(upto,)], "version long").write.mode("append").parquet(self.log_path)
        self.expire(spark, v)
        return True

    def delta_paths(self) -> list[str]:
        return []

    def expire(self, spark: SparkSession, version: int | None) -> None:
        """Remove what only states before ``version`` (the base before the
        current one) need: the deltas folded into it and the bases before it."""
        if version is None:
            return
        old = [p for d in self.delta_paths() for b, p in _children(spark, d, "batch_id=").items() if b <= version]
        old += [p for b, p in _children(spark, os.path.join(self.root, "base"), "v=").items() if b - 1 < version]
        remove_paths(spark, old)


@dataclass
class ChangeTable(_Compacted):
    """Destination state as base + change deltas (C6 / C7 semantics)."""
    keys: Sequence[str] = ()
    mode: str = "strict"                    # strict (C6) | last_wins (C7)
    order: Sequence[str] = ch.ORDER
    op_col: str = "op_code"
    insert_only: Sequence[str] = ()
    generated: Mapping[str, str] = field(default_factory=dict)

    @property
    def changes_path(self) -> str:
        return os.path.join(self.root, "changes")

    def delta_paths(self) -> list[str]:
        return [self.changes_path]

    def append(self, spark: SparkSession, feed: DataFrame, batch_id: int) -> None:
        """Store a batch; generated values are drawn here, once, and a source
        value for them is ignored."""
        for c, g in self.generated.items():
            feed = feed.withColumn(c, F.expr(g).cast(self.schema[c].dataType))
        _write_batch(feed, self.changes_path, batch_id)

    def fold(self, state: DataFrame, deltas: DataFrame) -> DataFrame:
        if self.mode not in ("strict", "last_wins"):
            raise ValueError(f"unknown apply mode {self.mode!r}")
        apply = ch.apply_strict if self.mode == "strict" else ch.apply_last_wins
        insert_only = [*self.insert_only, *(c for c in self.generated if c not in self.insert_only)]
        out = apply(state, deltas, self.keys, ["batch_id", *self.order], self.op_col, insert_only)
        return out.select(*self.schema.fieldNames())

    def current(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        base, v = self.base(spark)
        deltas = _read_batches(spark, self.changes_path, v, upto)
        return base if deltas is None else self.fold(base, deltas)

    def outcomes(self, spark: SparkSession, upto: int) -> DataFrame | None:
        """C22 for the batches after the current base, up to ``upto``, by the
        rules of the table's mode."""
        base, v = self.base(spark)
        deltas = _read_batches(spark, self.changes_path, v, upto)
        if deltas is None:
            return None
        if self.mode == "last_wins":
            return ch.last_wins_outcomes(deltas)
        return ch.strict_outcomes(deltas, base, self.keys, ["batch_id", *self.order], self.op_col)


@dataclass
class ApplySpec:
    """Per-batch settings: operation switches (C8), compaction period and
    optional outcome (C22) and latency (C21) sinks."""
    inserts: bool = True
    updates: bool = True
    deletes: bool = True
    compact_every: int = 8
    outcomes_path: str | None = None
    latency: tuple[str, str] | None = None  # (path, source time column)


def apply_batch(spark: SparkSession, batch: DataFrame, batch_id: int, table: ChangeTable,
                spec: ApplySpec) -> None:
    """C11: one micro-batch - F6, append the deltas, latency records; every
    ``compact_every`` batches the outcomes and a new base version."""
    feed = ch.enabled_operations(batch, spec.inserts, spec.updates, spec.deletes, table.op_col)
    table.append(spark, feed, batch_id)
    if spec.latency:
        from changeflow.operators.telemetry import capture_latency
        path, src_time = spec.latency
        lat = capture_latency(ch.decode_feed(feed, table.op_col)
                              .withColumn("_written_at", F.current_timestamp()), src_time, "_written_at")
        _write_batch(lat, path, batch_id)
    if spec.compact_every and (batch_id + 1) % spec.compact_every == 0:
        compact(spark, table, batch_id, spec)


def compact(spark: SparkSession, table: ChangeTable, upto: int, spec: ApplySpec) -> None:
    """Outcomes of the batches since the last base, then the new base."""
    v = table.base_version(spark)
    if v is not None and v >= upto:
        return
    if spec.outcomes_path:
        out = table.outcomes(spark, upto)
        if out is not None:
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
               .partitionBy("batch_id").parquet(spec.outcomes_path)
    table.compact(spark, upto)


def start_apply(stream: DataFrame, table: ChangeTable, spec: ApplySpec, checkpoint: str,
                trigger: Mapping[str, object] | None = None) -> StreamingQuery:
    """C9 + C11: run ``apply_batch`` for every micro-batch.  ``trigger``
    defaults to ``availableNow`` (process what is there, then stop); use
    ``{"processingTime": "5 seconds"}`` for a continuous poller."""
    spark = stream.sparkSession

    def fn(batch: DataFrame, batch_id: int) -> None:
        apply_batch(spark, batch, batch_id, table, spec)

    w = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    w = w.trigger(**(dict(trigger) if trigger else {"availableNow": True}))
    return w.start()


# ---------------------------------------------------------------- C14

@dataclass
class KeyReplaceTable(_Compacted):
    """Destination whose deltas replace whole keys: each batch stores the
    affected keys and their re-merged rows; the current state takes, for
    every affected key, the rows of the latest batch that touched it."""
    key: str = "id"

    def delta_paths(self) -> list[str]:
        return [os.path.join(self.root, "keys"), os.path.join(self.root, "rows")]

    def append(self, spark: SparkSession, keys: DataFrame, rows: DataFrame, batch_id: int) -> None:
        _write_batch(keys.select(self.key).distinct(), os.path.join(self.root, "keys"), batch_id)
        _write_batch(rows.select(*self.schema.fieldNames()), os.path.join(self.root, "rows"), batch_id)

    def current(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        base, v = self.base(spark)
        ks = _read_batches(spark, os.path.join(self.root, "keys"), v, upto)
        if ks is None:
            return base
        latest = ks.groupBy(F.col(self.key).alias("_k")).agg(F.max("batch_id").alias("_b"))
        kept = base.join(latest, base[self.key].eqNullSafe(latest["_k"]), "left_anti")
        rows = _read_batches(spark, os.path.join(self.root, "rows"), v, upto)
        if rows is None:        # every batch so far only removed keys
            return kept
        fresh = rows.join(latest, rows[self.key].eqNullSafe(latest["_k"]) & (rows["batch_id"] == latest["_b"]), "left_semi")
        fresh = fresh.select(*self.schema.fieldNames())
        return kept.unionByName(fresh)


def start_remerge(stream: DataFrame, merge: Callable[[], MergeSpec], key_col: str,
                  table: KeyReplaceTable, checkpoint: str, compact_every: int = 8,
                  trigger: Mapping[str, object] | None = None) -> StreamingQuery:
    """C14 streaming: the distinct keys of each batch are re-merged from the
    sources (semi-joined to those keys before the joins) and replace those
    keys in the destination; keys that no longer come out of the merge
    disappear (merged deletes take effect)."""
    spark = stream.sparkSession

    def fn(batch: DataFrame, batch_id: int) -> None:
        keys = batch.select(F.col(key_col).alias(table.key)).distinct()
        rows = run_merge(spark, restrict_to_keys(merge(), keys, table.key, dest_key=table.key))
        table.append(spark, keys, rows.join(keys, table.key, "left_semi"), batch_id)
        if compact_every and (batch_id + 1) % compact_every == 0:
            table.compact(spark, batch_id)

    w = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    w = w.trigger(**(dict(trigger) if trigger else {"availableNow": True}))
    return w.start()


def tag_images(stream: DataFrame, alias: str, columns: Sequence[str]) -> DataFrame:
    """A source's changed images as one column named by its alias, so
    that streams of different sources can be united."""
    return stream.select(F.lit(alias).alias("_source_alias"), F.struct(*columns).alias(alias))


def start_propagation(streams: Mapping[str, DataFrame], merge: Callable[[], MergeSpec],
                      table: KeyReplaceTable, checkpoint: str, compact_every: int = 8,
                      trigger: Mapping[str, object] | None = None) -> StreamingQuery:
    """C12 + C14 streaming: changed images of several sources (alias ->
    stream), each with keys of its own, in one query with one position per
    source in its checkpoint.  A batch's images are traced through the joins to
    the destination keys they touch, which are merged from ``merge()``'s
    current sources and replaced."""
    from changeflow.operators.propagate import affected_keys, merge_keys
    spark = next(iter(streams.values())).sparkSession
    columns = {s.alias: s.df.columns for s in merge().sources}
    united = None
    for alias, stream in streams.items():
        one = tag_images(stream, alias, columns[alias])
        united = one if united is None else united.unionByName(one, allowMissingColumns=True)

    def fn(batch: DataFrame, batch_id: int) -> None:
        batch.persist()       # read once per source
        try:
            images = {a: batch.filter(F.col("_source_alias") == a).select(f"{a}.*") for a in streams}
            spec = merge()
            keys = affected_keys(spec, images, table.key)
            _write_batch(keys, table.delta_paths()[0], batch_id)
            own = _read_batches(spark, table.delta_paths()[0], batch_id - 1, batch_id)
            if own is None:       # nothing touched since the start
                return
            rows = merge_keys(spark, spec, own.select(table.key), table.key)
            _write_batch(rows.select(*table.schema.fieldNames()), table.delta_paths()[1], batch_id)
        finally:
            batch.unpersist()
        if compact_every and (batch_id + 1) % compact_every == 0:
            table.compact(spark, batch_id)

    w = united.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    w = w.trigger(**(dict(trigger) if trigger else {"availableNow": True}))
    return w.start()


def dedupe_stream(stream: DataFrame, keys: Sequence[str], time_col: str, delay: str = "10 minutes"
                  ) -> DataFrame:
    """Optional addition: drop at-least-once redeliveries within a watermark
    (the event time is cast to a session-zone timestamp, as watermarks need)."""
    s = stream.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return s.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(keys))
