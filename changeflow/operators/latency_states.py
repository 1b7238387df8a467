"""Latency over moving windows from stored hourly states.

An hour's latencies of a mapping are kept as one row: count, sum, least,
largest, and a KLL quantile sketch.  States merge, so a window of 24 hours is
answered from 24 rows a mapping, and a day's states can be kept after its
records have gone.  Counts, averages and extremes are exact; a percentile is a
recorded value whose rank is within ``RANK_ERROR`` of the wanted one (with
``SKETCH_K`` 2048: 0.2 % of the window's records).  The exact form over the
records is ``telemetry.latency_stats``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.operators.telemetry import PERCENTILES

SKETCH_K, RANK_ERROR = 2048, 0.002


def hourly_states(latency: DataFrame, time_col: str = "destination_insert_time", mapping_col: str = "mapping_id",
                  value_col: str = "latency_ms") -> DataFrame:
    """mapping_id, hour and the state of every hour with records; a null
    latency counts as a record only."""
    v = F.col(value_col)
    return latency.groupBy(F.col(mapping_col).alias("mapping_id"), F.date_trunc("hour", time_col).cast("timestamp_ntz").alias("hour")).agg(
        F.count(F.lit(1)).alias("records"), F.count(v).alias("valued"), F.sum(v.cast("decimal(38,6)")).alias("total"),
        F.min(v.cast("double")).alias("least"), F.max(v.cast("double")).alias("largest"),
        F.kll_sketch_agg_double(v.cast("double"), F.lit(SKETCH_K)).alias("sketch"))


def _answer(states: DataFrame, keys: list) -> DataFrame:
    def place(p: float) -> Column:
        return F.when(F.col("valued") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p)))
    merged = states.groupBy(*keys).agg(
        F.sum("records").alias("total_records"), F.sum("valued").alias("valued"), F.sum("total").alias("total"),
        F.min("least").alias("min_latency_ms"), F.max("largest").alias("max_latency_ms"),
        F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"))
    return merged.select(*[k if isinstance(k, str) else F.col("window_end") for k in keys], "total_records",
                         F.when(F.col("valued") > 0, F.col("total").cast("double") / F.col("valued")).alias("avg_latency_ms"),
                         "min_latency_ms", "max_latency_ms", *[place(p).alias(f"p{round(p * 100)}_latency_ms") for p in PERCENTILES])


def window_stats(states: DataFrame, start: str, end: str, by_mapping: bool = False) -> DataFrame:
    """The statistics of the whole hours in [start, end)."""
    held = states.filter((F.col("hour") >= F.lit(start).cast("timestamp_ntz")) & (F.col("hour") < F.lit(end).cast("timestamp_ntz")))
    return _answer(held, ["mapping_id"] if by_mapping else [])


def moving_stats(states: DataFrame, hours: int = 24, by_mapping: bool = False) -> DataFrame:
    """The statistics of the ``hours`` up to every hour's end that has records
    in its window, as ``window_end``: a state takes part in ``hours`` windows."""
    offsets = F.explode(F.sequence(F.lit(1), F.lit(hours)))
    dealt = states.withColumn("_i", offsets).withColumn("window_end", F.col("hour") + F.make_dt_interval(F.lit(0), F.col("_i")))
    return _answer(dealt, ["window_end", *(["mapping_id"] if by_mapping else [])])
