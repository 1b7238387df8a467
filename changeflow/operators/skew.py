"""Size checks and hot-key handling shared by the operators.

* ``fits(df, max_rows)`` proves a row bound with a ``limit``-ed count before a
  side is broadcast; beyond the bound the caller keeps the shuffle join.
* ``salted_key_join`` joins a large per-event frame with a one-row-per-key
  frame.  Keys holding more than ``hot_rows`` events are spread over
  ``ceil(n / hot_rows)`` salt buckets on the event side while their key row
  is replicated once per bucket, so no task receives more than about
  ``hot_rows`` events of one key.  The hot-key list used to tag events is
  broadcast only after its size is checked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, ByteType, DateType, DecimalType, DoubleType,
                               FloatType, IntegerType, LongType, MapType, ShortType, StructType,
                               TimestampNTZType, TimestampType)

from changeflow.session import written

DEFAULT_HOT_ROWS = 2_000_000      # events of one key handled by one task
DEFAULT_MAX_HOT_KEYS = 100_000    # rows of the broadcast hot-key list
DEFAULT_BROADCAST_ROWS = 1_000_000
SALT = "_salt"
DEFAULT_BROADCAST_BYTES = 128 * 1024 * 1024


def row_bytes(schema: StructType) -> int:
    """Generous width of one row: fixed sizes for numbers and times, a
    budget for text, binary and nested values."""
    total = 16
    for f in schema.fields:
        dt = f.dataType
        if isinstance(dt, (ByteType, BooleanType)):
            total += 1
        elif isinstance(dt, (ShortType, IntegerType, FloatType, DateType)):
            total += 4
        elif isinstance(dt, (LongType, DoubleType, TimestampType, TimestampNTZType)):
            total += 8
        elif isinstance(dt, DecimalType):
            total += 16
        elif isinstance(dt, StructType):
            total += row_bytes(dt)
        elif isinstance(dt, (ArrayType, MapType)):
            total += 512
        else:                       # strings, binary
            total += 128
    return total


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (reads at most max_rows+1)."""
    return df.limit(max_rows + 1).count() <= max_rows


def measured_bytes(df: DataFrame, max_rows: int) -> int | None:
    """Bytes of ``df``'s values, with 16 a row and value for overhead, or None
    beyond ``max_rows`` rows (reads at most max_rows + 1)."""
    sizes = [F.coalesce(F.length(F.to_json(F.struct(f.name)) if isinstance(f.dataType, (ArrayType, MapType, StructType))
                                 else F.col(f.name).cast("string").cast("binary")), F.lit(0)) + 16 for f in df.schema.fields]
    row = sizes[0] if sizes else F.lit(16)
    for x in sizes[1:]:
        row = row + x
    n, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(row.cast("long")), F.lit(0))).first()
    return int(size) if n <= max_rows else None


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                       max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only behind a measured bound: at most ``max_rows`` rows
    whose values hold at most ``max_bytes``.  Otherwise the choice stays with
    the planner and AQE, which re-plans on measured sizes."""
    size = measured_bytes(df, max_rows)
    return F.broadcast(df) if size is not None and size <= max_bytes else df


def null_key(keys: Sequence[str]) -> Column:
    cond = None
    for k in keys:
        c = F.col(k).isNull()
        cond = c if cond is None else (cond | c)
    return cond


def salted_key_join(big: DataFrame, per_key: DataFrame, keys: Sequence[str],
                    count_col: str, spread: Sequence[str],
                    hot_rows: int = DEFAULT_HOT_ROWS,
                    max_hot_keys: int = DEFAULT_MAX_HOT_KEYS) -> DataFrame:
    """Inner join ``big`` with ``per_key`` (unique on ``keys``; ``count_col``
    = rows of ``big`` per key).  ``spread`` are columns of ``big`` hashed to
    pick a salt bucket for rows of hot keys, however many those are."""
    keys = list(keys)
    nsalt = F.ceil(F.col(count_col) / F.lit(hot_rows)).cast("int")
    hot = per_key.filter(F.col(count_col) > hot_rows).select(*keys, nsalt.alias("_nsalt"))
    n_hot = hot.limit(max_hot_keys + 1).count()
    if n_hot == 0:
        return big.join(per_key, keys, "inner")
    # a short list is broadcast; a long one is joined by key, where AQE may
    # split hot keys because nothing above needs their rows together yet
    tagged = big.join(F.broadcast(hot) if n_hot <= max_hot_keys else hot, keys, "left")
    salt = (F.when(F.col("_nsalt").isNull(), F.lit(0))
             .otherwise(F.pmod(F.xxhash64(*spread), F.col("_nsalt"))).cast("int"))
    big_s = tagged.withColumn("_salt", salt).drop("_nsalt")
    reps = F.when(F.col(count_col) > hot_rows, nsalt).otherwise(F.lit(1))
    small_s = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), reps - 1)))
    return big_s.join(small_s, keys + ["_salt"], "inner").drop("_salt")


def _same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"_hot_{k}"])
    return cond


def hot_key_salts(df: DataFrame, keys: Sequence[str], hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame | None:
    """The keys, null included, with more than ``hot_rows`` rows of ``df`` and
    the number of salts for each; None when there are none.  A table of at
    most ``hot_rows`` rows has none and is only counted."""
    if fits(df, hot_rows):
        return None
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    hot = written(counts.select(*[F.col(k).alias(f"_hot_{k}") for k in keys],
                                F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_nsalt")), "hot-keys")
    return None if hot.isEmpty() else broadcast_if_small(hot, DEFAULT_MAX_HOT_KEYS)


def _salts_of(df: DataFrame, keys: Sequence[str], salts: DataFrame) -> DataFrame:
    return df.join(salts, _same_key(df, salts, keys), "left").drop(*[f"_hot_{k}" for k in keys])


def deal_rows(df: DataFrame, keys: Sequence[str], salts: DataFrame | None) -> DataFrame:
    """``df`` with a salt: 0, or one of a hot key's.  Rows are dealt by their
    values and input partition, so that a task that runs again deals alike and
    repeated rows of different partitions part."""
    if salts is None:
        return df
    spread = df.select("*", F.xxhash64(F.spark_partition_id(), *df.columns).alias("_place"))
    return _salts_of(spread, keys, salts).withColumn(
        SALT, F.pmod(F.col("_place"), F.coalesce("_nsalt", F.lit(1))).cast("int")).drop("_place", "_nsalt")


def copy_rows(per_key: DataFrame, keys: Sequence[str], salts: DataFrame | None) -> DataFrame:
    """``per_key`` (one row a key), a hot key's row copied to each salt."""
    if salts is None:
        return per_key
    return _salts_of(per_key, keys, salts).withColumn(
        SALT, F.explode(F.sequence(F.lit(0), F.coalesce("_nsalt", F.lit(1)) - 1))).drop("_nsalt")
