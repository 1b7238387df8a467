"""Reconciliation of a source with its destination (A5, J9-J11, Q1-Q5,
T6).  Every check is one Spark job over both tables - joins and
aggregations instead of per-row probes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.functions.columns import present
from changeflow.operators.skew import DEFAULT_HOT_ROWS, SALT, copy_rows, deal_rows, hot_key_salts, null_key

# ---------------------------------------------------------------- T6


def sample_rows(df: DataFrame, n: int, method: str = "hash", keys: Sequence[str] = (),
                seed: int = 42, fraction: float | None = None) -> DataFrame:
    """``n`` sample rows.

    hash      rows with the smallest ``md5(key text)`` - repeatable, and the
              same rows any engine with md5 picks; a top-k, so each task keeps
              only ``n`` candidates (no full sort)
    exact     ``n`` rows ordered by ``rand(seed)`` (also a top-k)
    fraction  Bernoulli ``sample(fraction, seed)``, then ``n`` of those at random -
              for very large tables; fewer than ``n`` if the fraction is too small
    """
    if method == "hash":
        if not keys:
            raise ValueError("hash sampling needs key columns")
        text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
        return df.withColumn("_h", F.md5(text)).orderBy("_h", *keys).limit(n).drop("_h")
    if method == "exact":
        return df.withColumn("_r", F.rand(seed)).orderBy("_r").limit(n).drop("_r")
    if method == "fraction":
        if fraction is None:
            raise ValueError("fraction sampling needs a fraction")
        # thin first, then the top-k over random numbers: ``limit`` alone would
        # favour the first partitions
        return df.sample(fraction=fraction, seed=seed).withColumn("_r", F.rand(seed + 1)).orderBy("_r").limit(n).drop("_r")
    raise ValueError(f"unknown sample method {method!r}")


# ---------------------------------------------------------------- A5 / J9 / Q1

def row_count_compare(source: DataFrame, destination: DataFrame, check: bool = True) -> DataFrame:
    """A5: both counts and an equality flag (null when counting is off)."""
    if not check:
        return source.sparkSession.createDataFrame(
            [(None, None, None)], "source_count long, destination_count long, counts_match boolean")
    s = source.agg(F.count(F.lit(1)).alias("source_count"))
    d = destination.agg(F.count(F.lit(1)).alias("destination_count"))
    return s.crossJoin(d).withColumn("counts_match", F.col("source_count") == F.col("destination_count"))


def _missing(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key is not in ``right``; null keys count as
    missing and bypass the join (they would all land in one partition)."""
    nk = null_key(keys)
    rk = right.filter(~null_key(keys)).select(*keys)     # an anti join ignores duplicates
    return left.filter(~nk).join(rk, list(keys), "left_anti").unionByName(left.filter(nk))


def _side_by_side(source: DataFrame, destination: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: counts of each side and of its rows whose key the other side
    lacks.  Rows are counted per key on each side (map-side combined, so hot
    and null keys are one row each), the counts meet in one full outer join."""
    keys = list(keys)

    def per_key(df: DataFrame, name: str) -> DataFrame:
        return (df.groupBy(F.struct(*keys).alias("_k"), null_key(keys).alias("_null"))
                .agg(F.count(F.lit(1)).alias(name)))
    # null keys never match: they stay out of the key comparison by a flag
    s = per_key(source, "_s")
    d = per_key(destination, "_d")
    s = s.withColumn("_side", F.when(F.col("_null"), F.lit(1)).otherwise(F.lit(0)))
    d = d.withColumn("_side", F.when(F.col("_null"), F.lit(2)).otherwise(F.lit(0)))
    kt = s.schema["_k"].dataType
    j = s.drop("_null").join(d.drop("_null").withColumn("_k", F.col("_k").cast(kt)), ["_k", "_side"], "full_outer")
    zero = F.lit(0).cast("long")
    return j.agg(F.coalesce(F.sum("_s"), zero).alias("source_count"), F.coalesce(F.sum("_d"), zero).alias("destination_count"),
                 F.coalesce(F.sum(F.when(F.col("_d").isNull(), F.col("_s"))), zero).alias("missing_in_destination"),
                 F.coalesce(F.sum(F.when(F.col("_s").isNull(), F.col("_d"))), zero).alias("missing_in_source"))


def missing_both_ways(source: DataFrame, destination: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of source rows missing in the destination and of
    destination rows missing in the source (duplicates count per row)."""
    return _side_by_side(source, destination, keys).select("missing_in_destination", "missing_in_source")


def table_compare(source: DataFrame, destination: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q1: counts, missing rows each way and an overall match flag, in one
    pass over each side."""
    out = _side_by_side(source, destination, keys)
    match = F.col("source_count") == F.col("destination_count")
    return out.select("source_count", "destination_count", match.alias("counts_match"),
                      "missing_in_destination", "missing_in_source",
                      (match & (F.col("missing_in_destination") == 0) & (F.col("missing_in_source") == 0)).alias("tables_match"))


# ---------------------------------------------------------------- J10 / J11

def key_exists(df: DataFrame, target: DataFrame, keys: Sequence[str], name: str = "exists") -> DataFrame:
    """Flag each row by whether its key exists in the target (one
    join against the target's distinct keys instead of a probe per row)."""
    keys = list(keys)
    # only the target's rows with a probed key are made distinct
    probed = df.select(*keys).distinct()
    tk = target.filter(~null_key(keys)).select(*keys).join(probed, keys, "left_semi").distinct().withColumn("_hit", F.lit(True))
    return df.join(tk, keys, "left").withColumn(name, F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit")


def _mask(keys: Sequence[str]) -> Column:
    """Which key parts are given, a bit for each."""
    out = F.lit(0)
    for i, k in enumerate(keys):
        out = out + F.when(F.col(k).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0))
    return out


def _same_masked(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = left["_mask"] == right["_m"]
    for i, k in enumerate(keys):
        cond = cond & left[k].eqNullSafe(right[f"_k{i}"])
    return cond


def record_lookup(sample: DataFrame, target: DataFrame, keys: Sequence[str],
                  order: Sequence[str], prefix: str = "dst_") -> DataFrame:
    """For each sample row the first target row (in ``order``) equal on
    the key parts that are not null; all parts null -> no match.

    The target is read once and indexed by masked keys: a row stands for each
    combination of given key parts that the sample asks with (at most 2^k - 1,
    read beforehand), the other parts set to null.  Only probed keys are kept
    and reduced to their first row (``min_by``), so one 1:1 join answers all
    combinations."""
    keys, tcols = list(keys), target.columns
    asked = sample.withColumn("_mask", _mask(keys))
    masks = asked.filter("_mask > 0").agg(F.collect_set("_mask")).first()[0]
    rows = target.select(F.struct(*tcols).alias("_r"), F.struct(*order).alias("_o"), *keys).withColumn(
        "_mask", F.explode(F.array(*[F.lit(m) for m in sorted(masks)]).cast("array<int>")))
    given = [F.col("_mask").bitwiseAND(F.lit(1 << i)) != 0 for i in range(len(keys))]
    complete = F.lit(True)
    for k, g in zip(keys, given):
        complete = complete & (~g | F.col(k).isNotNull())
    rows = rows.filter(complete).select("_r", "_o", "_mask", *[F.when(g, F.col(k)).alias(k) for k, g in zip(keys, given)])
    probed = asked.filter("_mask > 0").select(F.col("_mask").alias("_m"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    held = rows.join(probed, _same_masked(rows, probed, keys), "left_semi")
    first = held.groupBy("_mask", *keys).agg(F.min_by("_r", "_o").alias("_r")).select(
        F.col("_mask").alias("_m"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[F.col(f"_r.{c}").alias(prefix + c) for c in tcols])
    found = asked.join(first, _same_masked(asked, first, keys), "left")
    return found.select(*[asked[c] for c in sample.columns], *[prefix + c for c in tcols])


# ---------------------------------------------------------------- Q4

def _strip(c: Column) -> Column:
    """Text with whitespace removed at both ends (any whitespace, not only spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def record_diff(a_prefix: str, b_prefix: str, columns: Sequence[str], typed: bool = False) -> Column:
    """Q4: array of (column, source, destination) for columns that differ.

    Both null -> equal; otherwise the values are compared as trimmed text
    (``typed=True`` compares the values themselves), null-safe, so a null
    never equals the text 'None'."""
    items = []
    for c in columns:
        a, b = F.col(a_prefix + c), F.col(b_prefix + c)
        if typed:
            differs = ~a.eqNullSafe(b)
        else:
            differs = ~_strip(a.cast("string")).eqNullSafe(_strip(b.cast("string")))
        items.append((differs, F.struct(F.lit(c).alias("column"),
                                        a.cast("string").alias("source_value"),
                                        b.cast("string").alias("destination_value"))))
    return present(items)


# ---------------------------------------------------------------- Q2 / Q3 / Q5

def verify_rows(source_mapped: DataFrame, destination: DataFrame, keys: Sequence[str],
                columns: Sequence[str] | None = None, typed: bool = False,
                hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """Q3: every key of either side with its ``status`` (matched, different,
    missing_in_destination, missing_in_source) and the differing columns.

    One full outer join on the key; the destination is reduced to its first
    row per key (a look-up finds the first match).  Null keys never match;
    every row with one is reported as missing.  Where a source key holds more
    than ``hot_rows`` rows, these are dealt over salts, each with a copy of the
    key's destination row, and the destination's other keys are found apart."""
    keys = list(keys)
    cols = list(columns) if columns is not None else [c for c in source_mapped.columns if c not in keys]
    s = source_mapped.select(*keys, *[F.col(c).alias("s_" + c) for c in cols]) \
        .withColumn("_s", F.lit(True))
    # first row per key, made deterministic: the smallest row
    nk = null_key(keys)
    d = destination.filter(~nk).groupBy(*keys).agg(F.min(F.struct(*cols)).alias("_r")) \
        .select(*keys, *[F.col(f"_r.{c}").alias("d_" + c) for c in cols]) \
        .withColumn("_d", F.lit(True))
    d_null = destination.filter(nk).select(*keys, *[F.col(c).alias("d_" + c) for c in cols]).withColumn("_d", F.lit(True))
    held = s.filter(~nk)
    salts = hot_key_salts(held, keys, hot_rows)
    if salts is None:
        j = held.join(d, keys, "full_outer")
    else:
        left = deal_rows(held, keys, salts).join(copy_rows(d, keys, salts), [*keys, SALT], "left").drop(SALT)
        only = d.join(held.select(*keys).distinct(), keys, "left_anti")
        j = left.unionByName(only, allowMissingColumns=True)
    j = j.unionByName(s.filter(nk), allowMissingColumns=True) \
         .unionByName(d_null, allowMissingColumns=True)
    diff = record_diff("s_", "d_", cols, typed)
    status = (F.when(F.col("_s").isNull(), "missing_in_source")
               .when(F.col("_d").isNull(), "missing_in_destination")
               .when(F.size(diff) == 0, "matched").otherwise("different"))
    return j.select(*keys, status.alias("status"),
                    F.when(F.col("_s") & F.col("_d"), diff).alias("differences"))


def verification_summary(rows: DataFrame, source: DataFrame, destination: DataFrame,
                         keys: Sequence[str], mismatch_limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Q2/Q3 report: (one summary row, all mismatches).  With
    ``mismatch_limit`` the mismatch list is a top-k report by key; the counts
    cover all rows either way."""
    counts = row_count_compare(source, destination)
    checked = rows.filter(F.col("status") != "missing_in_source").agg(
        F.count(F.lit(1)).alias("samples_checked"),
        F.count(F.when(F.col("status") == "matched", 1)).alias("samples_matched"))
    bad = rows.filter(F.col("status").isin("different", "missing_in_destination"))
    if mismatch_limit is not None:
        bad = bad.orderBy(*keys).limit(mismatch_limit)
    return counts.crossJoin(checked), bad


def sampled_verification(source_mapped: DataFrame, destination: DataFrame, keys: Sequence[str],
                         n: int = 100, columns: Sequence[str] | None = None) -> DataFrame:
    """Q2: hash-sample ``n`` source rows (after mapping), look each up in the
    destination by key and compare; one row per sampled key."""
    keys = list(keys)
    sample = sample_rows(source_mapped, n, "hash", keys)
    dest = destination.join(sample.select(*keys), keys, "left_semi")
    rows = verify_rows(sample, dest, keys, columns)
    return rows.filter(F.col("status") != "missing_in_source")


def reverse_check(destination: DataFrame, source: DataFrame, reverse_keys: dict[str, str],
                  n: int = 10, sample_keys: Sequence[str] | None = None) -> DataFrame:
    """Q5: sample destination rows, map their keys back to source names
    (``reverse_keys`` destination -> source, P13), probe the source with one
    semi join; result = found share.  Null key parts are left out of the
    probe; a row with no usable key part is not found."""
    dkeys = list(reverse_keys)
    sample = sample_rows(destination, n, "hash", sample_keys or dkeys)
    back = sample.select(*[F.col(d).alias(s) for d, s in reverse_keys.items()])
    skeys = list(reverse_keys.values())
    found = key_exists(back, source, skeys, "found") if len(skeys) == 1 else \
        record_lookup(back, source.select(*skeys), skeys, skeys, "_src_") \
        .withColumn("found", F.col(f"_src_{skeys[0]}").isNotNull())
    return found.agg(F.count(F.lit(1)).alias("reverse_checked"),
                     F.avg(F.col("found").cast("double")).alias("reverse_success_rate"))
