"""Reusable transforms: filters and routing (F1-F8), reshaping and
enrichment (R1-R8), dedupe and window columns (W1-W7), aggregations
(A1-A4, A13-A15)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeflow.functions.columns import any_changed, present
from changeflow.operators.ordered import keyed_neighbor, keyed_row_number
from changeflow.operators.skew import fits
from changeflow.session import written

FEW_COUNTS = 1_000_000    # distinct (group, value) pairs that one window numbers

# ---------------------------------------------------------------- F1 - F8


def predicate_filter(df: DataFrame, condition: str | Column) -> DataFrame:
    """keep rows where the SQL condition holds (pushed to the scan when
    it references scan columns only)."""
    return df.filter(F.expr(condition) if isinstance(condition, str) else condition)


def relative_date_filter(df: DataFrame, column: str, days: int, anchor: str) -> DataFrame:
    """``column >= anchor - days``.  The anchor is an argument (not
    ``current_date``) so a rerun returns the same rows."""
    bound = F.lit(anchor).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return df.filter(F.col(column) >= bound)


def route(df: DataFrame, condition: str | Column, persist: bool = False
          ) -> tuple[DataFrame, DataFrame]:
    """(true, false) outputs; a null condition goes to the false side."""
    c = F.expr(condition) if isinstance(condition, str) else condition
    if persist:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    return df.filter(F.coalesce(c, F.lit(False))), df.filter(~F.coalesce(c, F.lit(False)))


def fork(df: DataFrame, n: int = 2, persist: bool = True) -> list[DataFrame]:
    """the same rows to ``n`` outputs (1..3).  When more than one output
    will be computed the rows are written once to the shared folder, so the
    input is read once and nothing stays cached (``persist=False`` leaves the
    plan as it is)."""
    if not 1 <= n <= 3:
        raise ValueError("a fork has 1 to 3 outputs")
    if n > 1 and persist:
        df = written(df, "fork")
    return [df] * n


def split_parts(df: DataFrame, keys: Sequence[str], n: int, by: str = "hash", once: bool = False) -> list[DataFrame]:
    """disjoint parts by ``pmod(xxhash64(keys), n)``, or with
    ``by='modulo'`` by ``pmod(key, n)`` of one integral key (null keys in part
    0); every row lands in exactly one part.

    The parts are filters over one plan.  With ``once`` the input is read a
    single time: it is written to the shared folder partitioned by part, and
    each part reads its own files."""
    if by == "hash":
        part = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(n))
    elif by == "modulo" and len(keys) == 1:
        part = F.coalesce(F.pmod(F.col(keys[0]), F.lit(n)), F.lit(0))
    else:
        raise ValueError("by is hash, or modulo with one key")
    tagged = df.withColumn("_part", part.cast("int"))
    if once:
        tagged = written(tagged, "split", "_part")
    return [tagged.filter(F.col("_part") == i).drop("_part") for i in range(n)]


def on_change(df: DataFrame, keys: Sequence[str], order: Sequence[str],
              fields: Sequence[str]) -> DataFrame:
    """F7 over a feed: pass a row only if one of ``fields`` differs from the
    previous row of the same key (the first row of a key always passes)."""
    marked = df.withColumn("_marker", F.lit(1))
    nb = keyed_neighbor(marked, keys, order, [*fields, "_marker"], "prev", prefix="_prev_")
    first = F.col("_prev__marker").isNull()
    changed = any_changed([(F.col(f"_prev_{f}"), F.col(f)) for f in fields])
    return nb.filter(first | changed).select(*df.columns)


def validate(df: DataFrame, rules: Mapping[str, str] | None = None,
             casts: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """F8: (good, rejected).  ``rules`` are named SQL conditions that must
    hold; ``casts`` are columns that must convert to a type (``try_cast``:
    a non-null value that does not convert is an error).  Rejected rows carry
    ``errors`` (names of the failed checks).  Retries are Spark's own task
    and batch retries."""
    checks = []
    for name, cond in (rules or {}).items():
        checks.append((~F.coalesce(F.expr(cond), F.lit(False)), F.lit(name)))
    for col, typ in (casts or {}).items():
        checks.append((F.col(col).isNotNull() & F.expr(f"try_cast(`{col}` AS {typ})").isNull(),
                       F.lit(f"cast:{col}")))
    if not checks:
        raise ValueError("no rules given")
    tagged = df.withColumn("errors", present(checks, "string"))
    good = tagged.filter(F.size("errors") == 0).drop("errors")
    bad = tagged.filter(F.size("errors") > 0)
    return good, bad


# ---------------------------------------------------------------- R1 - R8

def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str],
            name_col: str = "metric_name", value_col: str = "metric_value") -> DataFrame:
    """Value columns -> (name, value) rows; null values are kept."""
    return df.unpivot(list(ids), list(values), name_col, value_col)


def pivot(df: DataFrame, ids: Sequence[str], category: str, value: str,
          categories: Sequence, agg: str = "max") -> DataFrame:
    """R2: rows -> one column per category.  The category list is explicit so
    no extra job runs to discover it and the output schema is stable."""
    fn = getattr(F, agg)
    return df.groupBy(*ids).pivot(category, list(categories)).agg(fn(value))


def categorize(column: str | Column, thresholds: Sequence[tuple[float, str]], default: str) -> Column:
    """First label whose threshold the value reaches (thresholds high to low)."""
    c = F.col(column) if isinstance(column, str) else column
    out = None
    for bound, label in thresholds:
        out = F.when(c >= bound, F.lit(label)) if out is None else out.when(c >= bound, F.lit(label))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def date_parts(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """Year, month, quarter (bigint, like SQL ``extract``) and month start."""
    c = F.col(column)
    return df.withColumns({
        f"{prefix}year": F.year(c).cast("long"),
        f"{prefix}month": F.month(c).cast("long"),
        f"{prefix}quarter": F.quarter(c).cast("long"),
        f"{prefix}month_start": F.date_trunc("month", c).cast("timestamp_ntz"),
    })


def string_parts(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """Upper-case text and its length."""
    c = F.col(column)
    return df.withColumns({f"{prefix}upper": F.upper(c),
                           f"{prefix}length": F.length(c).cast("long")})


def status_logic(cases: Sequence[tuple[str, str]], default: str) -> Column:
    """Nested CASE from (SQL condition, label) pairs, first match wins."""
    out = None
    for cond, label in cases:
        out = F.when(F.expr(cond), F.lit(label)) if out is None else out.when(F.expr(cond), F.lit(label))
    return out.otherwise(F.lit(default))


def processing_stamp(df: DataFrame, name: str = "processed_at") -> DataFrame:
    """One timestamp per query (constant across rows and tasks)."""
    return df.withColumn(name, F.current_timestamp())


_VAR = re.compile(r"\{([A-Za-z_][A-Za-z0-9_]*)\}")


def run_script(spark: SparkSession, statements: Sequence[tuple[str, str]],
               variables: Mapping[str, str] | None = None,
               params: Mapping[str, object] | None = None) -> DataFrame:
    """An ordered list of named SQL statements.  ``{name}`` placeholders
    (``{source_table}``, ``{destination_table}``, ``{mapping_id}``, custom
    variables) are filled from ``variables`` - identifiers the script author
    controls; values go through ``params`` as named parameter markers
    (``:name``).  Each statement becomes a temp view under its name; the last
    one is the result."""
    variables = dict(variables or {})
    result = None
    for name, text in statements:
        def fill(m):
            v = m.group(1)
            if v not in variables:
                raise ValueError(f"script variable {{{v}}} has no value")
            return variables[v]
        sql = _VAR.sub(fill, text)
        result = spark.sql(sql, args=dict(params or {})) if params else spark.sql(sql)
        result.createOrReplaceTempView(name)
    if result is None:
        raise ValueError("empty script")
    return result


# ---------------------------------------------------------------- W1 - W7

def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                first: bool = False) -> DataFrame:
    """Newest (or first) row per key by aggregation (``max_by`` /
    ``min_by`` over the order struct), which combines map-side - no window
    sort of whole key groups.  The order must be total (add a tiebreak)."""
    keys = list(keys)
    cols = [c for c in df.columns if c not in keys]
    ordk = F.struct(*[F.col(c) for c in order])
    pick = F.min_by if first else F.max_by
    agg = df.groupBy(*keys).agg(pick(F.struct(*cols), ordk).alias("_r"))
    return agg.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def drop_exact_duplicates(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Exact duplicate rows (or duplicates on a subset) removed."""
    return df.dropDuplicates(list(subset)) if subset else df.distinct()


def with_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn",
                    descending: bool = False) -> DataFrame:
    """``row_number`` per key (block-wise, see ``ordered``), over all rows
    when there are no keys."""
    return keyed_row_number(df, keys, order, name, descending=descending)


def with_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rnk",
              descending: bool = False) -> DataFrame:
    """``rank`` per key."""
    return keyed_row_number(df, keys, order, name, ties="rank", descending=descending)


def with_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
             prefix: str = "prev_", descending: bool = False) -> DataFrame:
    """Previous row's columns within the key."""
    return keyed_neighbor(df, keys, order, cols, "prev", prefix, descending)


def with_lead(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
              prefix: str = "next_", descending: bool = False) -> DataFrame:
    """Next row's columns within the key."""
    return keyed_neighbor(df, keys, order, cols, "next", prefix, descending)


# ---------------------------------------------------------------- A1 - A4, A13 - A15

def group_summary(df: DataFrame, keys: Sequence[str], value: str, distinct: str | None = None,
                  approx_distinct: bool = False, exact_sums: bool = True) -> DataFrame:
    """A1 / A2: count, sum, avg, min, max per key set, plus a distinct count.

    With ``exact_sums`` the sum runs over ``decimal(38,6)`` so it does not
    depend on the order rows arrive in (float sums do); the average is that
    sum over the non-null count."""
    v = F.col(value)
    s = v.cast("decimal(38,6)") if exact_sums else v
    aggs = [F.count(F.lit(1)).alias("row_count"),
            F.sum(s).cast("double").alias(f"sum_{value}"),
            (F.sum(s).cast("double") / F.count(v)).alias(f"avg_{value}"),
            F.min(v).alias(f"min_{value}"), F.max(v).alias(f"max_{value}")]
    if distinct:
        fn = F.approx_count_distinct if approx_distinct else F.count_distinct
        aggs.append(fn(F.col(distinct)).alias(f"distinct_{distinct}"))
    return df.groupBy(*keys).agg(*aggs)


def period_summary(df: DataFrame, ts: str, unit: str, keys: Sequence[str], value: str) -> DataFrame:
    """A3: totals per ``date_trunc(unit, ts)`` and key."""
    period = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("period")
    return df.groupBy(period, *keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.col(value).cast("decimal(38,6)")).cast("double").alias("total"))


def value_tiers(df: DataFrame, key: str, value: str, ts: str,
                tiers: Sequence[tuple[float, str]], default: str) -> DataFrame:
    """A4: totals per customer, a tier label from thresholds, and the span
    in days between the first and the last activity."""
    agg = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("order_count"),
        F.sum(F.col(value).cast("decimal(38,6)")).cast("double").alias("total_value"),
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return agg.select(key, "order_count", "total_value",
                      categorize("total_value", tiers, default).alias("tier"),
                      F.datediff(F.col("last_ts"), F.col("first_ts")).cast("long").alias("span_days"))


def string_agg(df: DataFrame, keys: Sequence[str], column: str, sep: str = ",",
               distinct: bool = False) -> DataFrame:
    """Sorted values joined by ``sep``, duplicates kept unless
    ``distinct``; nulls are left out, a group of nulls alone is null.  Values
    are counted per (group, value) first, so rows of a hot group are combined
    map-side and what meets in one task is one entry a distinct value; the
    result itself is as long as the group's values."""
    values = _repeated()
    return (_value_counts(df, keys, column, distinct).groupBy(*keys)
            .agg(F.when(F.count("_v") > 0, F.array_join(values, sep)).alias(f"{column}_list")))


def array_agg(df: DataFrame, keys: Sequence[str], column: str, distinct: bool = False) -> DataFrame:
    """Sorted array of the group's values with nulls last, duplicates
    kept unless ``distinct``; counted per value first, as ``string_agg``."""
    nulls = F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_n"))), F.lit(0)).cast("int")
    none = F.lit(None).cast(df.schema[column].dataType)
    return (_value_counts(df, keys, column, distinct).groupBy(*keys)
            .agg(F.concat(_repeated(), F.array_repeat(none, nulls)).alias(f"{column}_array")))


def _value_counts(df: DataFrame, keys: Sequence[str], column: str, distinct: bool) -> DataFrame:
    counts = df.groupBy(*keys, F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.withColumn("_n", F.lit(1).cast("long")) if distinct else counts


def _repeated() -> Column:
    """Sorted values, each as often as it was counted, without nulls."""
    pairs = F.array_sort(F.collect_list(F.when(F.col("_v").isNotNull(), F.struct("_v", "_n"))))
    return F.flatten(F.transform(pairs, lambda p: F.array_repeat(p["_v"], p["_n"].cast("int"))))


def median(df: DataFrame, keys: Sequence[str], column: str, approx: bool = False,
           accuracy: int = 10000) -> DataFrame:
    """Interpolated median (``percentile_cont(0.5)``); ``approx`` uses a
    fixed-size sketch.  The exact form counts per (group, value) and numbers
    the values block-wise (``ordered``), so neither a value map nor a sort of
    a whole group has to fit into one task."""
    if approx:
        return df.groupBy(*keys).agg(F.percentile_approx(F.col(column), 0.5, accuracy).cast("double").alias(f"median_{column}"))
    return exact_percentiles(df, keys, column, {f"median_{column}": 0.5})


def exact_percentiles(df: DataFrame, keys: Sequence[str], column: str, wanted: dict[str, float],
                      few: int = FEW_COUNTS) -> DataFrame:
    """Interpolated percentiles per group (``percentile_cont``), one column
    for each name in ``wanted``; null where a group has no value.

    Values are counted per (group, value), map-side first, and the counts
    written.  Up to ``few`` of them are numbered by one window; more are
    numbered block-wise, so no group's values have to fit into one task."""
    from changeflow.operators.ordered import ordered_blocks
    keys = list(keys)
    every = written(df.groupBy(*keys, F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "value-counts")
    counts = every.filter(F.col("_v").isNotNull())
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    if fits(every, few):
        group = Window.partitionBy("_k")
        b = counts.select(key.alias("_k"), "_v", "_n").withColumns({
            "_last": F.sum("_n").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1,
            "_total": F.sum("_n").over(group)})
    else:
        b = ordered_blocks(counts, keys, ["_v"])
        sums = b.groupBy("_k", "_blk").agg(F.sum("_n").alias("_s"))
        before = Window.partitionBy("_k").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("_k", "_blk", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"),
                           F.sum("_s").over(Window.partitionBy("_k")).alias("_total"))
        run = Window.partitionBy("_k", "_blk").orderBy("_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        b = b.join(sums, ["_k", "_blk"]).withColumn("_last", F.col("_off") + F.sum("_n").over(run) - 1)
    b = b.withColumn("_first", F.col("_last") - F.col("_n") + 1)
    aggs, out = [], []
    for name, p in wanted.items():
        place = (F.col("_total") - 1) * F.lit(float(p))
        for part, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            held = (F.col("_first") <= rank) & (rank <= F.col("_last"))
            aggs.append(F.max(F.when(held, F.col("_v").cast("double"))).alias(f"_{name}_{part}"))
        aggs.append(F.max(place - F.floor(place)).alias(f"_{name}_at"))
        lo, hi, at = (F.col(f"_{name}_{x}") for x in ("lo", "hi", "at"))
        out.append((lo + (hi - lo) * at).alias(name))
    found = b.groupBy("_k").agg(*aggs).select("_k", *out)
    groups = every.select(key.alias("_k")).distinct()
    return groups.join(found, "_k", "left").select(*[F.col(f"_k.{k}").alias(k) for k in keys], *wanted)
