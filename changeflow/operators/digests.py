"""Verification by block digests (Q1, Q3).

Two tables that should agree are compared without moving their rows.  Rows
fall into buckets by a hash of their key; each side folds a bucket into one
row: its number of rows and two order-independent sums of row hashes.  Sums
combine map-side, so a side shuffles one row per bucket and task whatever its
size.  Buckets whose folds differ are refined into ``fan_out`` times as many,
level by level, reading only the rows in buckets that still differ, until a
bucket holds about ``leaf_rows`` rows.  The rows of the last differing
buckets alone are then compared in full (``reconcile.verify_rows``).

Rows are hashed over the compared values as ``record_diff`` compares them -
trimmed text, null apart from every text - so buckets agree exactly when the
verification would.  Two hashes with different seeds are summed in halves of
31 bits, so a sum fits a long for four billion rows a bucket and a difference
is missed with a probability of about 2^-124.  Rows with a null key never
match, so they are always compared.  A repeated row counts in a bucket's sums:
where both sides repeat a key alike they agree, which the look-up of a key's
first row alone would not see.

The set of differing buckets of a level is broadcast only while it is small;
beyond ``max_buckets`` it is joined by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.operators.reconcile import _strip, verify_rows
from changeflow.operators.skew import broadcast_if_small, null_key
from changeflow.session import written

FIRST_BUCKETS, FAN_OUT, LEAF_ROWS, MAX_LEVELS, MAX_BUCKETS = 1024, 64, 1000, 5, 1_000_000


def _bucket(n: int) -> Column:
    return F.pmod(F.col("_h"), F.lit(n))


def _hashed(df: DataFrame, keys: Sequence[str], columns: Sequence[str], typed: bool) -> DataFrame:
    """``df`` with the key's hash and two hashes of the whole row."""
    texts = [F.col(c) if typed else _strip(F.col(c).cast("string")) for c in columns]
    # a null is told from any text by a flag of its own
    row = [x for c, t in zip([*keys, *columns], [*[F.col(k) for k in keys], *texts]) for x in (F.col(c).isNull(), t)]
    return df.withColumns({"_h": F.xxhash64(*keys), "_a": F.xxhash64(F.lit(17), *row), "_b": F.xxhash64(F.lit(7919), *row)})


def _folds(df: DataFrame, n: int, side: int) -> DataFrame:
    """One row per bucket: signed count and sums, positive for the source."""
    sign, half = F.lit(side), F.lit((1 << 31) - 1)
    halves = {f"{h}{i}": F.shiftrightunsigned(h, 31 * i).bitwiseAND(half) for h in ("_a", "_b") for i in (0, 1)}
    return df.groupBy(_bucket(n).alias("_bucket")).agg(
        (F.count(F.lit(1)) * sign).alias("_n"), *[(F.sum(h) * sign).alias(name) for name, h in halves.items()],
        F.count(F.lit(1)).alias("_rows"))


def differing_buckets(source: DataFrame, destination: DataFrame, n: int) -> DataFrame:
    """(_bucket, _rows): buckets of two hashed sides whose folds differ, with
    the rows of both sides."""
    both = _folds(source, n, 1).unionByName(_folds(destination, n, -1))
    sums = ["_n", "_a0", "_a1", "_b0", "_b1"]
    folded = both.groupBy("_bucket").agg(*[F.sum(c).alias(c) for c in sums], F.sum("_rows").alias("_rows"))
    differs = F.lit(False)
    for c in sums:
        differs = differs | (F.col(c) != 0)
    return folded.filter(differs).select("_bucket", "_rows")


def _within(df: DataFrame, buckets: DataFrame, n: int) -> DataFrame:
    return df.join(buckets.select(F.col("_bucket").alias("_in")), _bucket(n) == F.col("_in"), "left_semi")


def differing_rows(source: DataFrame, destination: DataFrame, keys: Sequence[str], columns: Sequence[str],
                   typed: bool = False, first: int = FIRST_BUCKETS, fan_out: int = FAN_OUT, leaf_rows: int = LEAF_ROWS
                   ) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides in the buckets that still differ at the last
    level, and those with a null key; both empty if the tables agree."""
    s, d = (_hashed(df.select(*keys, *columns).filter(~null_key(keys)), keys, columns, typed) for df in (source, destination))
    n, own = first, [s, d]
    for level in range(MAX_LEVELS):
        found = written(differing_buckets(*own, n), "buckets")
        size = found.agg(F.count(F.lit(1)).alias("n"), F.max("_rows").alias("most")).first()      # one row
        buckets = broadcast_if_small(found, MAX_BUCKETS)
        own = [_within(x, buckets, n) for x in (s, d)]
        if not size.n or size.most <= leaf_rows or level == MAX_LEVELS - 1:
            break
        n *= fan_out        # a finer bucket lies within one of the level before
    return tuple(x.select(*keys, *columns).unionByName(df.select(*keys, *columns).filter(null_key(keys)))
                 for x, df in zip(own, (source, destination)))


def tables_agree(source: DataFrame, destination: DataFrame, keys: Sequence[str],
                 columns: Sequence[str] | None = None, typed: bool = False, first: int = FIRST_BUCKETS) -> bool:
    """Q1 in full: whether both sides hold the same rows."""
    cols = list(columns) if columns is not None else [c for c in source.columns if c not in keys]
    s, d = (_hashed(df.select(*keys, *cols), keys, cols, typed) for df in (source, destination))
    return differing_buckets(s, d, first).isEmpty()


def verify_by_digests(source_mapped: DataFrame, destination: DataFrame, keys: Sequence[str],
                      columns: Sequence[str] | None = None, typed: bool = False, first: int = FIRST_BUCKETS,
                      fan_out: int = FAN_OUT, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Q3: the keys of ``verify_rows`` that are not matched, with status and
    differences.  Only rows of differing buckets are shuffled."""
    cols = list(columns) if columns is not None else [c for c in source_mapped.columns if c not in keys]
    s, d = differing_rows(source_mapped, destination, keys, cols, typed, first, fan_out, leaf_rows)
    return verify_rows(s, d, keys, cols, typed).filter(F.col("status") != "matched")
