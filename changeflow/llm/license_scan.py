"""License scan by ordered signature rules (1), with DataFrame functions only.

Per document: the words (A-Z lower-cased runs of ASCII letters and digits and
of characters beyond ASCII) are taken once; the rules whose keyword is among
them are selected; their patterns run over the words joined by single blanks;
every match becomes a detection with its word range.  A detection inside an
earlier-sorted one (by start, then longest, then priority) is suppressed if
that one's priority is at least as strong.  Everything happens within a row:
there is no shuffle, and a lost task is recomputed alone.

Base phrases are rules too; their places are counted before suppression and
their labels are always reported.

Defined cases: a null or empty text has no words, no labels and score 0;
repeated rows repeat their results; an empty table gives an empty result;
other columns are kept, those with the result's names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.llm.license_rules import Rule, rules

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RESULT = ("n_words", "detections", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
_DETECTION = ("struct<start: bigint, neg_end: bigint, priority: int, order: int, label: string, "
              "confidence: double, base: boolean>")


def lower_ascii(text: Column) -> Column:
    """Lower case whose ASCII letters come from ASCII letters alone: the two
    other characters with an ASCII lower case are replaced first."""
    return F.lower(F.replace(F.replace(text, F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı")))


def _blanks(s: Column) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")


def _matches(line: Column, rule: Column) -> Column:
    """Detections of one rule: the text between matches gives their places."""
    pattern = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))
    between = F.split(line, pattern, F.lit(-1))
    found = F.regexp_extract_all(line, pattern, F.lit(0))
    empty = F.lit(None).cast(f"array<{_DETECTION}>")

    def add(state: Column, piece: Column) -> Column:
        start = state["at"] + _blanks(piece["between"]) - 1
        end = start + _blanks(piece["found"]) + 1
        own = F.struct(start.alias("start"), (-end).alias("neg_end"), rule["priority"].alias("priority"),
                       rule["order"].alias("order"), rule["label"].alias("label"),
                       rule["confidence"].alias("confidence"), rule["base"].alias("base"))
        return F.struct(end.alias("at"), F.array_append(state["out"], own).alias("out"))

    pieces = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("between"), found.alias("found"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.coalesce(empty, F.array().cast(f"array<{_DETECTION}>")).alias("out"))
    return F.aggregate(pieces, zero, add, lambda s: s["out"])


def _kept(found: Column, tiers: int) -> Column:
    """The detections that no earlier-sorted one of at least their priority
    contains: one pass, with the furthest end seen so far per priority."""
    def step(state: Column, d: Column) -> Column:
        end = -d["neg_end"]
        covered = F.array_max(F.slice(state["ends"], F.lit(1), d["priority"] + 1)) >= end
        ends = F.transform(state["ends"], lambda e, i: F.when(i == d["priority"], F.greatest(e, end)).otherwise(e))
        return F.struct(ends.alias("ends"),
                        F.when(covered, state["out"]).otherwise(F.array_append(state["out"], d)).alias("out"))
    zero = F.struct(F.array_repeat(F.lit(-1).cast("long"), tiers).alias("ends"),
                    F.array().cast(f"array<{_DETECTION}>").alias("out"))
    return F.aggregate(F.array_sort(found), zero, step, lambda s: s["out"])


def scan(docs: DataFrame, table: Iterable[Rule] | None = None) -> DataFrame:
    """``docs`` and n_words; detections (kept: start, end in words, label,
    rule, confidence); n_base, first_word, last_word; base_labels, labels;
    score, the confidence of the best kept detection."""
    table = list(rules() if table is None else table)
    tiers = max(r.priority for r in table) + 1
    listed = F.array(*[F.struct(F.lit(r.order).alias("order"), F.lit(r.priority).alias("priority"),
                                F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern"),
                                F.lit(r.label).alias("label"), F.lit(float(r.confidence)).alias("confidence"),
                                F.lit(r.base).alias("base")) for r in table])
    keywords = F.array(*[F.lit(k) for k in sorted({r.keyword for r in table})])
    kept = docs.drop(*RESULT)
    names = kept.columns
    words = F.regexp_extract_all(lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))
    step = kept.withColumn("__words", words)
    step = step.withColumn("__hit", F.array_intersect("__words", keywords))
    step = step.select(*names, F.size("__words").cast("long").alias("n_words"), "__hit",
                       F.when(F.size("__hit") > 0, F.concat(F.lit(" "), F.array_join("__words", " "), F.lit(" "))).alias("__line"))
    chosen = F.filter(listed, lambda r: F.array_contains(F.col("__hit"), r["keyword"]))
    step = step.withColumn("__found", F.when(F.col("__line").isNotNull(), F.flatten(
        F.transform(chosen, lambda r: _matches(F.col("__line"), r)))).otherwise(F.array().cast(f"array<{_DETECTION}>")))
    step = step.select(*names, "n_words", "__found", F.filter("__found", lambda d: d["base"]).alias("__base"))
    step = step.withColumn("__kept", _kept(F.col("__found"), tiers))
    base = F.array_sort(F.array_distinct(F.transform("__base", lambda d: d["label"])))
    return step.select(
        *names, "n_words",
        F.transform("__kept", lambda d: F.struct(d["start"].alias("start"), (-d["neg_end"]).alias("end"), d["label"].alias("label"),
                                                 d["order"].alias("rule"), d["confidence"].alias("confidence"))).alias("detections"),
        F.size("__base").cast("long").alias("n_base"),
        F.array_min(F.transform("__base", lambda d: d["start"])).alias("first_word"),
        F.array_max(F.transform("__base", lambda d: d["start"])).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.transform("__kept", lambda d: d["label"]))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("__kept", lambda d: d["confidence"])), F.lit(0.0)).alias("score"))


def digest(docs: DataFrame) -> DataFrame:
    """The registered query's columns."""
    return scan(docs.select("doc_id", "text")).drop("text")
