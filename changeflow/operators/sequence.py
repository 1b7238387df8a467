"""Dense sequence numbers without a single-partition window (``NEXT VALUE
FOR`` a sequence, surrogate keys of C20, generated ids of P8).

``row_number()`` over an un-partitioned window moves every row into one
task.  Here the rows are range-partitioned and sorted by the order columns,
then checkpointed (a reliable checkpoint under the shared checkpoint folder,
so the partitioning and positions stay fixed if executors are lost and the
plan is recomputed).  Each partition's row count gives an offset (one row
per partition - a broadcast of a proven size); a row's id is ``start +
offset of its partition + its position in the partition``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeflow.session import checkpoint_dir


def sequence_ids(df: DataFrame, order: Sequence[str | Column], name: str = "seq_id",
                 start: int | Column = 1, partitions: int | None = None) -> DataFrame:
    """Add ``name`` = start, start + 1, ... following ``order``."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id())
                .checkpoint())
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    first = F.lit(start) if isinstance(start, int) else start
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return ranged.join(F.broadcast(offsets), "_pid") \
        .withColumn(name, (first + F.col("_off") + pos).cast("long")) \
        .drop("_pid", "_mid", "_off")


def next_values(new_rows: DataFrame, existing: DataFrame, column: str, order: Sequence[str | Column],
                name: str | None = None) -> DataFrame:
    """Values for new rows continuing an existing sequence column:
    ``max(existing) + 1, ...`` (one aggregate over the existing column)."""
    base = existing.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]   # one number
    return sequence_ids(new_rows, order, name or column, start=int(base) + 1)
