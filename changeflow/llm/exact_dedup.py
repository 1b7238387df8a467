"""Exact dedup against a persistent digest index (13).

A text's digest is the SHA-256 of its normalised form: A to Z lower-cased,
nothing else changed, null as the empty text.  The index is a table of
digests, bucketed and sorted by them.  A batch of documents is first reduced
to one row a digest, combined map-side, so copies never meet in one task; a
sort-merge anti-join with the index, whose side is not shuffled, leaves the
digests never seen, and those are appended with the id that stays.  Digests
seen before are appended as counts only.  Texts themselves are not shuffled.

The index is partitioned by batch.  Adding a batch again replaces its
partition and looks at earlier batches alone, so a run that was cut off can
be repeated with the same result; ``compact`` copies an index of many batches
to one of a single batch.

Every row gets its decision by a join with the index.  Digests of which more
than one in ``HOT_SHARE`` rows of the batch are copies are fewer than
``HOT_SHARE`` by construction; they are broadcast and their rows are not
shuffled.  All others are joined bucket by bucket.

Within a batch the row with the largest id stays, over batches that of the
batch added first.

Defined cases: null texts equal empty ones; a null id is smaller than all
others; of rows that repeat id and text one stays; an empty batch adds nothing
and gives an empty result; very long texts are digested whole; columns of the
documents with the result's names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.common import new_path, scratch, stored

HOT_SHARE = 4096
BUCKET_ROWS, LEAST_BUCKETS = 1_000_000, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A to Z lower-cased.  In texts of ASCII alone lower() changes just these."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


@dataclass(frozen=True)
class DigestIndex:
    """A persistent index at ``path``; ``name`` is its table in the session's
    catalog, made again by ``open`` where another session wrote the files."""
    path: str
    name: str
    buckets: int = LEAST_BUCKETS

    def open(self, spark: SparkSession) -> DigestIndex:
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
        spark.sql(f"""CREATE TABLE IF NOT EXISTS {self.name}
            (digest BINARY, keep_id BIGINT, n BIGINT, first BOOLEAN, batch BIGINT) USING parquet
            PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'""")
        spark.sql(f"MSCK REPAIR TABLE {self.name}")
        return self

    def entries(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """(digest, keep_id, n, first, batch): a row of ``first`` for every
        digest, with the id that stays, and a count for each later batch."""
        rows = spark.table(self.name)
        return rows if before is None else rows.filter(F.col("batch") < before)

    def add(self, docs: DataFrame, batch: int = 0) -> None:
        """Append the digests of ``docs`` (doc_id, text) as batch ``batch``."""
        spark = docs.sparkSession
        with scratch(spark):
            own = (docs.select(F.col("doc_id").cast("long"), text_digest(F.col("text")).alias("digest"))
                   .groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")))
            own = stored(own.repartition(self.buckets, "digest").sortWithinPartitions("digest"), "batch-digests")
            seen = self.entries(spark, batch).filter("first").select("digest").hint("merge")
            new = own.join(seen, "digest", "left_anti").withColumn("first", F.lit(True))
            again = own.join(seen, "digest", "left_semi").withColumn("first", F.lit(False))
            self._write(stored(new.unionByName(again), "batch-entries"), batch)

    def _write(self, rows: DataFrame, batch: int) -> None:
        """Replace the partition of ``batch``, one file a bucket."""
        rows.sparkSession.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = {batch}) SELECT digest, keep_id, n, first FROM {{rows}}",
                              rows=rows.repartition(self.buckets, "digest"))

    def totals(self, spark: SparkSession) -> DataFrame:
        """(digest, keep_id, group_size): without a shuffle, by bucket."""
        return self.entries(spark).groupBy("digest").agg(
            F.max_by("keep_id", "first").alias("keep_id"), F.sum("n").alias("group_size"))

    def compact(self, spark: SparkSession, target: DigestIndex) -> DigestIndex:
        """The index with all its batches as batch -1 of ``target``."""
        target.open(spark)
        target._write(self.totals(spark).withColumnRenamed("group_size", "n").withColumn("first", F.lit(True)), -1)
        return target

    def decide(self, docs: DataFrame, batch: int = 0) -> DataFrame:
        """One row per document of the added batch: doc_id, keep_id,
        group_size (rows of all batches so far), kept, text_sha256.

        Rows are counted by (digest, id) first, so of repeated rows the one
        that stays is told apart without a window over the copies."""
        rows = (docs.select(F.col("doc_id").cast("long"), text_digest(F.col("text")).alias("digest"))
                .groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("times")))
        entries = self.entries(docs.sparkSession).filter(F.col("batch") <= batch)
        own = F.col("batch") == batch
        known = entries.groupBy("digest").agg(
            F.max_by("keep_id", "first").alias("keep_id"), F.sum("n").alias("group_size"),
            F.max(own & F.col("first")).alias("stays"), F.sum(F.when(own, F.col("n"))).alias("here")).filter("here > 0")
        many = entries.filter(own).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // HOT_SHARE
        hot = F.broadcast(known.filter(F.col("here") > many))       # fewer than HOT_SHARE rows
        cold = known.filter(F.col("here") <= many).hint("merge")
        decided = rows.join(hot, "digest").unionByName(
            rows.join(hot.select("digest"), "digest", "left_anti").join(cold, "digest"))
        mine = F.col("stays") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
        return decided.select(
            "doc_id", "keep_id", "group_size", mine.alias("__mine"), F.lower(F.hex("digest")).alias("text_sha256"),
            F.posexplode(F.sequence(F.lit(1).cast("long"), "times")).alias("__at", "__nth")).select(
            "doc_id", "keep_id", "group_size", (F.col("__mine") & (F.col("__at") == 0)).alias("kept"), "text_sha256")

    def kept_rows(self, docs: DataFrame, batch: int = 0) -> DataFrame:
        """The documents of the added batch that stay, columns unchanged; of
        rows that repeat id and text the one with the smallest hash of the
        other columns."""
        others = [c for c in docs.columns if c not in ("doc_id", "text")]
        tie = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
        rows = docs.groupBy(text_digest(F.col("text")).alias("__digest"), F.col("doc_id").cast("long").alias("__id")).agg(
            F.min_by(F.struct(*docs.columns), tie).alias("__row"))
        stay = self.decide(docs, batch).filter("kept").select(F.unhex("text_sha256").alias("__d"), F.col("doc_id").alias("__k"))
        same = (F.col("__digest") == F.col("__d")) & F.col("__id").eqNullSafe(F.col("__k"))
        return rows.join(stay, same, "left_semi").select("__row.*")


def new_index(spark: SparkSession, rows: int) -> DigestIndex:
    """An empty index in the shared folder, with buckets for about ``rows``
    rows: one for each ``BUCKET_ROWS``."""
    path = new_path(spark, "digest-index")
    return DigestIndex(path, "digests_" + path.rsplit("-", 1)[1], max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))).open(spark)


def digest(docs: DataFrame) -> DataFrame:
    """The registered query's columns, from an index of the whole table."""
    index = new_index(docs.sparkSession, docs.count())
    index.add(docs)
    return index.decide(docs)
