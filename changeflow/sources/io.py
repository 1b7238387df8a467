"""Readers, writers and table profile.

Only this module and ``streaming`` write.  Writes go to a path given by the
caller; a new state is written to a new location (``versioned_path``) and
never over a table that the same job reads.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# ---------------------------------------------------------------- readers


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
         where: str | None = None, fmt: str = "parquet",
         options: Mapping[str, str] | None = None) -> DataFrame:
    """Read only the needed columns; the predicate and the column list
    reach the Parquet scan (``PushedFilters`` / ``ReadSchema``)."""
    df = spark.read.format(fmt).options(**dict(options or {})).load(path)
    if where:
        df = df.filter(F.expr(where))
    return df.select(*columns) if columns else df


def jdbc_scan(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, partitions: int = 64,
              fetchsize: int = 10_000, properties: Mapping[str, str] | None = None) -> DataFrame:
    """S1 for databases: a partitioned JDBC read (one range query per
    partition) with a fetch size.  Bounds that are not given come from one
    min / max query; a column without a value is read unpartitioned.
    Connection properties are passed through and never logged."""
    def reader(**options):
        r = spark.read.format("jdbc").option("url", url).option("fetchsize", str(fetchsize))
        for k, v in [*(properties or {}).items(), *options.items()]:
            r = r.option(k, v)
        return r
    if not partition_column:
        return reader(dbtable=table).load()
    if lower is None or upper is None:
        found = reader(query=f"SELECT MIN({partition_column}) AS lo, MAX({partition_column}) AS hi FROM {table}").load().first()
        if found is None or found[0] is None:
            return reader(dbtable=table).load()
        lower, upper = (found[0] if lower is None else lower), (found[1] if upper is None else upper)
    return reader(dbtable=table, partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper),
                  numPartitions=str(partitions)).load()


def query_source(spark: SparkSession, sql: str, views: Mapping[str, DataFrame] | None = None,
                 args: Mapping[str, object] | None = None) -> DataFrame:
    """A free SQL query over registered views."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=dict(args)) if args else spark.sql(sql)


def bounded(df: DataFrame, n: int, columns: Sequence[str] | None = None,
            where: str | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """At most ``n`` rows, with a column list and predicate; with an
    order the result is deterministic (a top-k)."""
    if where:
        df = df.filter(F.expr(where))
    if columns:
        df = df.select(*columns)
    if order:
        df = df.orderBy(*order)
    return df.limit(n)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             header: bool = True) -> DataFrame:
    """CSV with an explicit schema (inference only when none is given -
    it costs an extra pass over the data)."""
    r = spark.read.option("header", str(header).lower())
    r = r.schema(schema) if schema is not None else r.option("inferSchema", "true")
    return r.csv(path)


# ---------------------------------------------------------------- writers

def write_table(df: DataFrame, path: str, mode: str = "append", fmt: str = "parquet",
                partition_by: Sequence[str] = (), bucket_by: Sequence[str] = (),
                buckets: int = 0, table: str | None = None,
                options: Mapping[str, str] | None = None) -> None:
    """``append`` (S9) or ``overwrite`` (S10); optional
    date partitioning (event log, latency records) and, for catalog tables,
    bucketing by the key so later key joins need no shuffle of this side."""
    if mode not in ("append", "overwrite"):
        raise ValueError("mode is append or overwrite")
    w = df.write.mode(mode).format(fmt).options(**dict(options or {}))
    if partition_by:
        w = w.partitionBy(*partition_by)
    if bucket_by:
        if not table:
            raise ValueError("bucketing needs a catalog table name")
        w = w.bucketBy(buckets or 64, *bucket_by).sortBy(*bucket_by)
        w.option("path", path).saveAsTable(table)
        return
    w.save(path)


def jdbc_write(df: DataFrame, url: str, table: str, mode: str = "append", batchsize: int = 1000,
               truncate: bool = True, properties: Mapping[str, str] | None = None) -> None:
    """S9 / S10 for databases: batched inserts; replace = truncate then insert."""
    w = df.write.format("jdbc").option("url", url).option("dbtable", table) \
        .option("batchsize", str(batchsize)).mode(mode)
    if mode == "overwrite":
        w = w.option("truncate", str(truncate).lower())
    for k, v in (properties or {}).items():
        w = w.option(k, v)
    w.save()


def versioned_path(root: str, version: int) -> str:
    """Location of state version ``version`` of a table (a new state never
    overwrites the one being read)."""
    return os.path.join(root, f"v={version:08d}")


def write_event_log(log: DataFrame, path: str) -> None:
    """Append, one partition per day."""
    write_table(log, path, "append", partition_by=["event_date"])


def write_latency(latency: DataFrame, path: str, time_col: str = "destination_insert_time") -> None:
    """Append latency records, partitioned by day and clustered by
    mapping within the files (replaces the reference's table indexes)."""
    out = latency.withColumn("record_date", F.col(time_col).cast("date")) \
        .sortWithinPartitions("mapping_id", time_col)
    write_table(out, path, "append", partition_by=["record_date"])


# ---------------------------------------------------------------- S14

def table_profile(df: DataFrame, keys: Sequence[str] = (), with_count: bool = True) -> DataFrame:
    """Column name, type, nullable and key flag (from the schema, no
    data read) plus the row count (one aggregate job)."""
    spark = df.sparkSession
    rows = [(i + 1, f.name, f.dataType.simpleString(), f.nullable, f.name in set(keys))
            for i, f in enumerate(df.schema.fields)]
    prof = spark.createDataFrame(
        rows, "ordinal int, column_name string, data_type string, is_nullable boolean, is_key boolean")
    if with_count:
        prof = prof.crossJoin(df.agg(F.count(F.lit(1)).alias("row_count")))
    return prof


# ---------------------------------------------------------------- S11 / T7 on catalog tables

def append_log_table(log: DataFrame, table: str, date_col: str = "event_date") -> None:
    """S11 as a catalog table: append, one partition per day."""
    log.write.mode("append").format("parquet").partitionBy(date_col).saveAsTable(table)


def drop_old_partitions(spark: SparkSession, table: str, days: int, anchor: str,
                        date_col: str = "event_date") -> list[str]:
    """Drop the day partitions older than ``anchor - days`` (a managed
    table's files go with them).  Only the partition list - one entry per
    day - reaches the driver, never rows."""
    cutoff = spark.sql(f"SELECT date_sub(DATE '{anchor}', {int(days)}) AS c").first()["c"]
    parts = spark.sql(f"SHOW PARTITIONS {table}") \
        .select(F.regexp_extract("partition", rf"{date_col}=([0-9-]+)", 1).alias("d")) \
        .filter(F.col("d").cast("date") < F.lit(cutoff)).collect()
    dropped = [r["d"] for r in parts]
    for d in dropped:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({date_col} = DATE '{d}')")
    return dropped


def export_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """S13 sink: write a long-form export as CSV (with header) or JSON lines."""
    if fmt not in ("csv", "json"):
        raise ValueError("export format is csv or json")
    w = df.write.mode("overwrite")
    (w.option("header", "true").csv(path) if fmt == "csv" else w.json(path))
