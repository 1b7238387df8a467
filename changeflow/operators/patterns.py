"""Cross-source analysis.

``analyze_sources`` matches the rows of several sources on key columns
(the first source drives), compares each logical column across sources and
labels every mismatch with the detectors that explain it (case, whitespace,
diacritics, swapped columns).  Matching is a chain of joins on null-safe key
equality after each secondary source is reduced to one row per key; rows of a
measured hot key are dealt over salts.  Detectors are column expressions over
generic (column, text, text) entries, written once however many columns are
compared, with no Python per row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from changeflow.functions.columns import present
from changeflow.functions.diacritics import strip_diacritics
from changeflow.operators.skew import DEFAULT_HOT_ROWS, SALT, copy_rows, deal_rows, hot_key_salts

# Detector kinds and the texts of their suggestions.
SWAP = "column_swap"
DIACRITICS = "character_normalization"
CASE = "case_normalization"
WHITESPACE = "whitespace_normalization"
MSG_SWAP = "Columns may be swapped: '{a}' <-> '{b}'"
MSG_DIACRITICS = "Diacritic mismatch detected: '{a}' vs '{b}' (normalized: '{n}')"
MSG_CASE = "Case mismatch: '{a}' vs '{b}'"
MSG_WHITESPACE = "Whitespace mismatch: '{a}' vs '{b}'"


@dataclass(frozen=True)
class Detector:
    id: str
    kind: str
    options: Mapping = field(default_factory=dict)   # trim / normalize_internal /
    #                                                   character_mappings / normalize_unicode


DEFAULT_DETECTORS = (Detector(SWAP, SWAP), Detector(DIACRITICS, DIACRITICS),
                     Detector(CASE, CASE), Detector(WHITESPACE, WHITESPACE))


# ---------------------------------------------------------------- value text

def value_text(c: Column, dtype) -> Column:
    """Text of a value as compared across sources (null stays null)."""
    if isinstance(dtype, BooleanType):
        return F.when(c.isNull(), F.lit(None)).when(c, F.lit("True")).otherwise(F.lit("False"))
    return c.cast("string")


def detector_text(c: Column, dtype) -> Column:
    """Text seen by detectors: empty for falsy values (null, '', 0, false)."""
    if isinstance(dtype, NumericType):
        falsy = c.isNull() | (c == 0)
    elif isinstance(dtype, BooleanType):
        falsy = c.isNull() | ~c
    else:
        falsy = c.isNull() | (c.cast("string") == "")
    return F.when(falsy, F.lit("")).otherwise(value_text(c, dtype))


def _fmt(template: str, **parts: Column) -> Column:
    """Build a message column from a ``{name}`` template."""
    out, rest = [], template
    while "{" in rest:
        pre, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        out += [F.lit(pre), parts[name]]
    out.append(F.lit(rest))
    return F.concat(*out)


def _ws_norm(c: Column, trim: bool = True, collapse: bool = True) -> Column:
    if trim:
        c = F.regexp_replace(c, r"^\s+|\s+$", "")
    if collapse:
        c = F.regexp_replace(c, r"\s+", " ")
    return c


def _words(c: Column) -> Column:
    s = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, r"\s+")))


def detect(d: Detector, a: Column, b: Column) -> tuple[Column, Column]:
    """(matched flag, suggestion) of one detector on two detector texts."""
    both = (a != "") & (b != "")
    if d.kind == SWAP:
        caps_a, caps_b = a.rlike(r"\p{Lu}"), b.rlike(r"\p{Lu}")
        hit = both & (F.lower(a) != F.lower(b)) & ~((_words(a) == 1) & (_words(b) == 1)) \
            & (caps_a != caps_b)
        return hit, _fmt(MSG_SWAP, a=a, b=b)
    if d.kind == DIACRITICS:
        opts = d.options
        na = strip_diacritics(a, opts.get("character_mappings"),) \
            if opts.get("normalize_unicode", True) else _replace_only(a, opts.get("character_mappings"))
        nb = strip_diacritics(b, opts.get("character_mappings")) \
            if opts.get("normalize_unicode", True) else _replace_only(b, opts.get("character_mappings"))
        hit = both & (na == nb) & (a != b)
        return hit, _fmt(MSG_DIACRITICS, a=a, b=b, n=na)
    if d.kind == CASE:
        hit = both & (F.lower(a) == F.lower(b)) & (a != b)
        return hit, _fmt(MSG_CASE, a=a, b=b)
    if d.kind == WHITESPACE:
        t, c = d.options.get("trim", True), d.options.get("normalize_internal", True)
        hit = both & (_ws_norm(a, t, c) == _ws_norm(b, t, c)) & (a != b)
        return hit, _fmt(MSG_WHITESPACE, a=a, b=b)
    raise ValueError(f"unknown detector kind {d.kind!r}")


def _replace_only(c: Column, mappings) -> Column:
    for old, new in (mappings or {}).items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def normalizer(kind: str, c: Column | str, **options) -> Column:
    """Q11: the normaliser of a detector kind as a column function."""
    c = F.col(c) if isinstance(c, str) else c
    if kind == CASE:
        return F.lower(c)
    if kind == WHITESPACE:
        return _ws_norm(c, options.get("trim", True), options.get("normalize_internal", True))
    if kind == DIACRITICS:
        return strip_diacritics(c, options.get("character_mappings"))
    return c   # column swap: identity


def label_patterns(a: Column, b: Column, detectors: Sequence[Detector] = DEFAULT_DETECTORS
                   ) -> tuple[Column, Column]:
    """Q12: (array of matching detector ids in detector order, suggestion of
    the first matching detector)."""
    hits = [detect(d, a, b) for d in detectors]
    ids = present([(h, F.lit(d.id)) for d, (h, _) in zip(detectors, hits)], "string")
    fix = F.coalesce(*[F.when(h, m) for h, m in hits], F.lit(None).cast("string")) if hits \
        else F.lit(None).cast("string")
    return ids, fix


# ---------------------------------------------------------------- J12

def n_way_match(sources: Sequence[tuple[str, DataFrame]], keys: Sequence[str],
                order: Mapping[str, Sequence[str]] | None = None,
                hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """Every row of the first source with the first matching row of each
    other source (null key equals null key); rows not found in every source
    are dropped.  Columns come out as ``<alias>__<column>``.

    Secondary sources are reduced to one row per key first (``min_by`` over
    the declared order, else the smallest row), so each join is 1:1 and a
    hot key cannot multiply rows.  Rows of the first source whose key, null
    included, holds more than ``hot_rows`` of them are dealt over salts, and
    the one row of that key in every other source is copied to each salt."""
    keys = list(keys)
    order = dict(order or {})
    (a0, d0), rest = sources[0], sources[1:]
    salts = hot_key_salts(d0, keys, hot_rows)
    dealt = deal_rows(d0, keys, salts)
    out = dealt.select(*[F.col(c).alias(f"{a0}__{c}") for c in d0.columns], *([SALT] if salts is not None else []))
    for alias, df in rest:
        cols = [c for c in df.columns if c not in keys]
        row = F.struct(*[F.col(c) for c in cols])
        if alias in order:
            first = F.min_by(row, F.struct(*[F.col(c) for c in order[alias]]))
        else:
            first = F.min(row)
        red = copy_rows(df.groupBy(*keys).agg(first.alias("_r")), keys, salts)
        red = red.select(*[F.col(k).alias(f"{alias}__{k}") for k in keys],
                         *[F.col(f"_r.{c}").alias(f"{alias}__{c}") for c in cols],
                         *([F.col(SALT).alias(f"{alias}_{SALT}")] if salts is not None else []))
        cond = F.lit(True) if salts is None else out[SALT] == red[f"{alias}_{SALT}"]
        for k in keys:
            cond = cond & out[f"{a0}__{k}"].eqNullSafe(red[f"{alias}__{k}"])
        out = out.join(red, cond, "inner").drop(f"{alias}_{SALT}")
    return out.drop(SALT)


# ---------------------------------------------------------------- Q6

def _row_id(df: DataFrame, alias: str, keys: Sequence[str]) -> Column:
    """Key values rendered like a Python dict: {'k': 1, 's': 'x'}."""
    parts = []
    for i, k in enumerate(keys):
        dt = df.schema[f"{alias}__{k}"].dataType
        v = F.col(f"{alias}__{k}")
        txt = F.concat(F.lit("'"), v.cast("string"), F.lit("'")) if isinstance(dt, StringType) \
            else value_text(v, dt)
        parts += [F.lit(("" if i == 0 else ", ") + f"'{k}': "), F.coalesce(txt, F.lit("None"))]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def _compared(sources: Sequence[tuple[str, DataFrame]], columns: Mapping[str, Mapping[str, str]],
              keys: Sequence[str], order: Mapping[str, Sequence[str]] | None) -> DataFrame:
    """row_id, keys and ``entries``: one struct per logical column with its
    name, the values by source, whether they differ, and the two texts that
    detectors look at (null where fewer than two sources hold the column)."""
    if len(sources) < 2:
        raise ValueError("analysis needs at least two sources")
    aliases = [a for a, _ in sources]
    m = n_way_match(sources, keys, order)
    entries = []
    for name, own in columns.items():
        held = [(F.col(f"{a}__{own[a]}"), m.schema[f"{a}__{own[a]}"].dataType, a) for a in aliases if a in own]
        texts = F.array(*[value_text(c, t) for c, t, _ in held])
        seen = [detector_text(c, t) for c, t, _ in held[:2]] if len(held) > 1 else [F.lit(None).cast("string")] * 2
        entries.append(F.struct(
            F.lit(name).alias("column_name"),
            F.map_from_arrays(F.array(*[F.lit(a) for _, _, a in held]), texts).alias("values"),
            (F.size(F.array_distinct(F.array_compact(texts))) > 1).alias("differs"),
            seen[0].alias("a"), seen[1].alias("b")))
    return m.select(_row_id(m, aliases[0], keys).alias("row_id"),
                    *[F.col(f"{aliases[0]}__{k}").alias(k) for k in keys], F.array(*entries).alias("entries"))


def _chosen(detectors: Sequence[Detector], apply_patterns: Sequence[str] | None) -> Sequence[Detector]:
    return [d for d in detectors if d.id in set(apply_patterns)] if apply_patterns else detectors


def analyze_sources(sources: Sequence[tuple[str, DataFrame]],
                    columns: Mapping[str, Mapping[str, str]], keys: Sequence[str],
                    detectors: Sequence[Detector] = DEFAULT_DETECTORS,
                    apply_patterns: Sequence[str] | None = None,
                    order: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Q6: one row per matched primary row with ``row_id``, ``matched`` (no
    logical column differs), ``n_mismatches`` and ``mismatches`` - an array of
    structs (column_name, values map alias -> text, detected_patterns,
    suggested_fix).

    A logical column differs when the sources hold more than one distinct
    non-null text.  Detectors look at the first two sources only.  They are
    written once, over the entries of a row: the plan does not grow with the
    logical columns, and counts read no detector at all."""
    c = _compared(sources, columns, keys, order)
    detectors = _chosen(detectors, apply_patterns)

    def labelled(e: Column) -> Column:
        ids, fix = label_patterns(e["a"], e["b"], detectors)
        return F.struct(e["column_name"].alias("column_name"), e["values"].alias("values"),
                        ids.alias("detected_patterns"), fix.alias("suggested_fix"))
    differing = F.filter("entries", lambda e: e["differs"])
    return c.select("row_id", *keys, (F.size(differing) == 0).alias("matched"),
                    F.size(differing).cast("long").alias("n_mismatches"),
                    F.transform(differing, labelled).alias("mismatches"))


def analyze_mismatches(sources: Sequence[tuple[str, DataFrame]],
                       columns: Mapping[str, Mapping[str, str]], keys: Sequence[str],
                       detectors: Sequence[Detector] = DEFAULT_DETECTORS,
                       apply_patterns: Sequence[str] | None = None,
                       order: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Q6 / Q12 long form, one row per (row, column) mismatch: the columns of
    ``mismatch_entries`` and the keys.  Entries are unpivoted first, so each
    detector is one generated expression over plain columns."""
    e = _compared(sources, columns, keys, order).select("row_id", *keys, F.explode("entries").alias("e"))
    e = e.filter("e.differs").select("row_id", *keys, "e.column_name", "e.values", "e.a", "e.b")
    ids, fix = label_patterns(F.col("a"), F.col("b"), _chosen(detectors, apply_patterns))
    return e.select("row_id", *keys, "column_name", "values", ids.alias("detected_patterns"), fix.alias("suggested_fix"))


def mismatch_entries(analysis: DataFrame) -> DataFrame:
    """One row per (row, column) mismatch of a (written) analysis."""
    e = analysis.select("row_id", F.explode("mismatches").alias("m"))
    return e.select("row_id", "m.column_name", "m.values", "m.detected_patterns", "m.suggested_fix")


def only_columns(analysis: DataFrame, names: Sequence[str]) -> DataFrame:
    """The analysis as if it had compared the columns ``names`` alone."""
    held = F.filter("mismatches", lambda m: m["column_name"].isin(list(names)))
    return analysis.withColumns({"mismatches": held, "n_mismatches": F.size(held).cast("long"), "matched": F.size(held) == 0})


def match_statistics(analysis: DataFrame) -> DataFrame:
    """Matched rows, mismatch entries and shares.

    ``total_records`` / ``match_percentage`` keep the original formula
    (matched rows + mismatch entries, mixing rows and entries); the row-based
    share is reported beside it."""
    agg = analysis.agg(F.count(F.lit(1)).alias("rows_compared"),
                       F.count(F.when(F.col("matched"), 1)).alias("matched_records"),
                       F.coalesce(F.sum("n_mismatches"), F.lit(0)).cast("long").alias("unmatched_records"))
    total = F.col("matched_records") + F.col("unmatched_records")
    return agg.select(
        total.alias("total_records"), "matched_records", "unmatched_records", "rows_compared",
        F.when(total > 0, F.round(F.col("matched_records") * 100.0 / total, 2))
         .otherwise(F.lit(0.0)).alias("match_percentage"),
        F.when(F.col("rows_compared") > 0,
               F.round(F.col("matched_records") * 100.0 / F.col("rows_compared"), 2))
         .otherwise(F.lit(0.0)).alias("row_match_percentage"))


def export_long(found: DataFrame) -> DataFrame:
    """One line per (row, column, source) of an analysis or, in one pass
    of generated code, of long-form mismatches - ready for ``write.csv`` /
    ``write.json``."""
    entries = mismatch_entries(found) if "mismatches" in found.columns else found
    return entries.select("row_id", "column_name", F.explode("values").alias("source", "value"),
                          F.array_join("detected_patterns", ";").alias("detected_patterns"))


def pattern_trial(df: DataFrame, a: str, b: str, detector: Detector) -> DataFrame:
    """Q14: run one detector over sample value pairs; count the matches."""
    ta = detector_text(F.col(a), df.schema[a].dataType)
    tb = detector_text(F.col(b), df.schema[b].dataType)
    hit, _ = detect(detector, ta, tb)
    return df.agg(F.count(F.lit(1)).alias("samples_checked"),
                  F.count(F.when(hit, 1)).alias("samples_matched"))


def gate_verdict(analysis: DataFrame, min_match_percentage: float) -> DataFrame:
    """Q15 as data: the statistics row and whether it passes the gate."""
    return match_statistics(analysis).withColumn(
        "passed", F.col("match_percentage") >= F.lit(float(min_match_percentage)))


def preload_gate(analysis: DataFrame, min_match_percentage: float) -> DataFrame:
    """Q15: raise before a load when the sources agree too little; returns
    the statistics row otherwise.  Runs one small aggregate job."""
    stats = gate_verdict(analysis, min_match_percentage)
    row = stats.first()
    if row is not None and not row["passed"]:
        raise ValueError(f"pre-load check failed: match {row['match_percentage']}% "
                         f"< {min_match_percentage}%")
    return stats.drop("passed")
