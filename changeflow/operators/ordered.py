"""Per-key ordered functions (row number, rank, previous / next row) that
do not sort a whole key in one task.

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key to
one task; a key holding a third of the data would then be sorted by a
single task.  Here rows are range-partitioned by (key, order columns), so a
hot key spans as many partitions as it has rows for, whatever the type of
the order columns (numbers, timestamps, binary positions) and whether they
hold nulls.  A partition's share of a key is a *block*, and the work is split
in two levels:

1. per (key, block) aggregates (row counts, first / last row), which Spark
   combines map-side;
2. a window over the *blocks* of a key (one row per block) yields offsets
   and the neighbouring blocks' edge rows;
3. the rows are joined with their block's summary (one row per (key,
   block), so the join cannot skew) and windowed per (key, block).

The partitioned rows are checkpointed in the shared folder, so a recomputed
task sees the same blocks.  Keys are compared as one struct, which is never
null: rows with null keys form a key of their own and stay.  Nulls in the
order columns come last in either direction, as in plain SQL windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeflow.session import checkpoint_dir


def order_columns(order: Sequence[str], descending: bool = False) -> list[Column]:
    return [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in order]


def ordered_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], descending: bool = False,
                   partitions: int | None = None) -> DataFrame:
    """``df`` with ``_k`` (the key as a struct), ``_blk`` (its block) and
    ``_mid`` (a number that follows (key, order) over all rows)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_all"))
    by = [*[F.col(k).asc_nulls_last() for k in keys], *order_columns(order, descending)]
    return (df.withColumn("_k", key).repartitionByRange(n, *by).sortWithinPartitions(*by)
            .withColumn("_blk", F.spark_partition_id())
            .withColumn("_mid", F.monotonically_increasing_id())
            .checkpoint())


def keyed_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row_number",
                     ties: str | None = None, descending: bool = False,
                     partitions: int | None = None) -> DataFrame:
    """``row_number()`` (or ``rank()`` with ``ties='rank'``) per key, computed
    block-wise (see module docstring); without keys over all rows."""
    b = ordered_blocks(df, keys, order, descending, partitions)
    counts = b.groupBy("_k", "_blk").agg(F.count(F.lit(1)).alias("_cnt"))
    wk = Window.partitionBy("_k").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_k", "_blk", F.coalesce(F.sum("_cnt").over(wk), F.lit(0)).alias("_off"))
    wi = Window.partitionBy("_k", "_blk")
    # range partitioning keeps ties together, so a rank needs no other block
    fn = F.rank().over(wi.orderBy(*order_columns(order, descending))) if ties == "rank" \
        else F.row_number().over(wi.orderBy("_mid"))
    out = b.join(offs, ["_k", "_blk"], "inner")
    return out.withColumn(name, (fn + F.col("_off")).cast("long")).select(*df.columns, name)


def keyed_neighbor(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
                   direction: str = "prev", prefix: str | None = None, descending: bool = False,
                   partitions: int | None = None) -> DataFrame:
    """Add the previous (``lag``) or next (``lead``) row's ``cols`` within the
    key, as columns ``<prefix><col>`` (prefix defaults to ``prev_``/``next_``)."""
    if direction not in ("prev", "next"):
        raise ValueError("direction is prev or next")
    prefix = prefix if prefix is not None else f"{direction}_"
    b = ordered_blocks(df, keys, order, descending, partitions)
    row = F.struct(*[F.col(c) for c in cols])
    edge = F.max_by(row, "_mid") if direction == "prev" else F.min_by(row, "_mid")
    edges = b.groupBy("_k", "_blk").agg(edge.alias("_own"))
    wk = Window.partitionBy("_k").orderBy("_blk")
    edges = edges.select("_k", "_blk", (F.lag("_own") if direction == "prev" else F.lead("_own")).over(wk).alias("_edge"))
    wi = Window.partitionBy("_k", "_blk").orderBy("_mid")
    inner = F.lag(row).over(wi) if direction == "prev" else F.lead(row).over(wi)
    # the first (last) row of a block has no row before (after) it there and
    # takes the edge row of the neighbouring block
    j = b.join(edges, ["_k", "_blk"], "inner").withColumn("_nb", F.coalesce(inner, F.col("_edge")))
    return j.select(*df.columns, *[F.col(f"_nb.{c}").alias(prefix + c) for c in cols])
