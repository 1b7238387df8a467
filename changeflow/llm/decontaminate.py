"""Benchmark decontamination (4): one Aho-Corasick automaton over normalised
benchmark windows, one scan of each text, hits mapped back to the original.

Words are lower-cased (A-Z) runs of ASCII letters and digits and of
characters beyond ASCII.  A window is ``size`` consecutive words of an item;
an item with fewer words, but not none, is one window.

The windows are written to the shared folder in groups of at most about
``group_chars`` characters (by a hash of window and item), so a worker holds
the automaton of one group at a time however large the benchmark is: about 34
bytes a character, 200 MB a group.  With one group, the usual case, texts are
scanned once and not shuffled.  With more, each group is a pass of its own over
the texts, and the hits meet by the digest of the text.

Defined cases: a null or empty text has no words and is clean; an empty
benchmark leaves every document clean; repeated items or rows are each
reported as they stand; null item texts have no window; null item ids never
appear among the items but their windows still hit.  A worker that does not
find a written group, or not all of its windows, raises.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.llm.common import alnum_words, filesystem, new_path, stored, text_slices

GROUP_CHARS = 6 << 20

# a word of the original text: lower case is not applied yet
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

OUTPUT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.LongType())),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, window): the distinct windows of every item, words joined
    by one blank with a blank at both ends."""
    def cut(batches):
        for batch in batches:
            ids, texts = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words = alnum_words(text)
                own = {b" " + b" ".join(words[i:i + size]) + b" "
                       for i in range(max(1, len(words) - size + 1))} if words else ()
                ids += [item] * len(own)
                texts += [w.decode() for w in own]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())],
                                             ["item_id", "window"])
    return (benchmark.select(F.col("item_id").cast("long"), "text")
            .mapInArrow(cut, "item_id long, window string").distinct())


class Matcher:
    """The automaton of one group of windows."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        import ahocorasick
        items: dict[str, list] = {}
        for item, window in rows:
            items.setdefault(window, []).append(item)
        self.items = list(items.values())
        self.n_words = [w.count(" ") - 1 for w in items]
        self.automaton = ahocorasick.Automaton()
        for i, w in enumerate(items):
            # one character per byte keeps the automaton's alphabet small
            self.automaton.add_word(w.encode().decode("latin-1"), i)
        self.automaton.make_automaton()

    def hits(self, words: list[bytes], covered: np.ndarray | None, items: set) -> np.ndarray | None:
        """Mark covered words and note the items; None if nothing occurs."""
        line = f" {b' '.join(words).decode('latin-1')} "
        found = list(self.automaton.iter(line))
        if not found:
            return covered
        if covered is None:
            covered = np.zeros(len(words), bool)
        blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        last = np.searchsorted(blanks, [e for e, _ in found])    # blank after the window's last word
        for end, (_, w) in zip(last, found):
            covered[end - self.n_words[w]:end] = True
        for w in {w for _, w in found}:
            items.update(i for i in self.items[w] if i is not None)
        return covered


_MATCHERS: dict[str, Matcher] = {}     # of this worker: one automaton at most


def _matcher(path: str, n: int) -> Matcher:
    """The automaton of a group's folder, which holds ``n`` windows."""
    if path not in _MATCHERS:
        _MATCHERS.clear()
        fs, own = filesystem(path)
        if fs.get_file_info(own).type.name == "NotFound":
            raise FileNotFoundError(f"{path}: a group of benchmark windows that was written is not found")
        t = pads.dataset(own, filesystem=fs, format="parquet").to_table(columns=["item_id", "window"])
        if t.num_rows != n:
            raise RuntimeError(f"{path}: {t.num_rows} of {n} benchmark windows are found")
        _MATCHERS[path] = Matcher(sorted(zip(t["item_id"].to_pylist(), t["window"].to_pylist()), key=str))
    return _MATCHERS[path]


def annotate(docs: DataFrame, benchmark: DataFrame, size: int = 10,
             group_chars: int = GROUP_CHARS) -> DataFrame:
    """All columns of ``docs`` and n_words, n_hit (words inside a window that
    occurs), items (sorted ids) and spans (merged character ranges of the
    original text that are hit).  Columns of ``docs`` with these names are
    replaced."""
    spark = docs.sparkSession
    path = new_path(spark, "benchmark-windows")
    found = windows(benchmark, size)
    raw = new_path(spark, "benchmark-raw")
    found.write.parquet(raw)
    found = spark.read.parquet(raw)
    chars = found.agg(F.sum(F.length("window"))).first()[0] or 0
    n_groups = -(-chars // group_chars)
    groups: list[tuple[str, int]] = []     # written ones and their windows: a hash may leave a group empty
    if n_groups:
        found = found.withColumn("g", F.pmod(F.xxhash64("item_id", "window"), F.lit(n_groups)))
        found.repartition(n_groups, "g").write.partitionBy("g").parquet(path)
        groups = [(f"{path}/g={r.g}", r.n) for r in found.groupBy("g").agg(F.count(F.lit(1)).alias("n")).orderBy("g").collect()]
    kept = docs.drop(*OUTPUT.names)
    if len(groups) > 1:
        return _annotate_by_groups(kept, groups)
    names = [*kept.columns, *OUTPUT.names]

    def scan(batches):
        for batch in text_slices(batches):
            words = [alnum_words(t) for t in batch.column("text").to_pylist()]
            covered, items = _hits(words, groups)
            yield _annotated(batch, words, covered, items, names)
    return kept.mapInArrow(scan, T.StructType(kept.schema.fields + OUTPUT.fields))


def _hits(words: list[list], groups: list[tuple[str, int]]) -> tuple[list, list[set]]:
    covered: list = [None] * len(words)
    items: list[set] = [set() for _ in words]
    for g in groups:
        matcher = _matcher(*g)
        for i, w in enumerate(words):
            if w:
                covered[i] = matcher.hits(w, covered[i], items[i])
    return covered, items


def _annotated(batch: pa.RecordBatch, words: list[list], covered: list, items: list, names: list[str]) -> pa.RecordBatch:
    texts = batch.column("text")
    spans = [_spans(texts[i].as_py(), c) if c is not None else [] for i, c in enumerate(covered)]
    return pa.RecordBatch.from_arrays([
        *(batch.column(n) for n in names[:-len(OUTPUT.names)]), pa.array([len(w) for w in words], pa.int64()),
        pa.array([0 if c is None else int(c.sum()) for c in covered], pa.int64()),
        pa.array([sorted(s) for s in items], pa.list_(pa.int64())), pa.array(spans, SPANS)], names=names)


def _runs(covered: np.ndarray) -> list[int]:
    """First and last places, exclusive, of the runs that are covered, one
    after another."""
    return np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))).tolist()


def _annotate_by_groups(kept: DataFrame, groups: list[tuple[str, int]]) -> DataFrame:
    """One pass of the texts for each group, each with one automaton; the hits
    of the few texts that have any meet by the text's digest."""
    text_key = F.sha2(F.col("text").cast("binary"), 256).alias("__key")
    found = None
    for g, group in enumerate(groups):
        def find(batches, group=group):
            for batch in text_slices(batches):
                covered, items = _hits([alnum_words(t) for t in batch.column("text").to_pylist()], [group])
                hit = [i for i, c in enumerate(covered) if c is not None]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__key").take(pa.array(hit, pa.int64())), pa.array([_runs(covered[i]) for i in hit], pa.list_(pa.int32())),
                     pa.array([sorted(items[i]) for i in hit], pa.list_(pa.int64()))], ["key", "runs", "items"])
        own = kept.select(text_key, "text").mapInArrow(find, "key string, runs array<int>, items array<long>").withColumn("g", F.lit(g))
        found = own if found is None else found.unionByName(own)
    once = found.groupBy("key", "g").agg(F.first("runs").alias("runs"), F.first("items").alias("items"))     # copies of a text hit alike
    hits = once.groupBy("key").agg(F.collect_list("runs").alias("__runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__items"))
    # written before the join, so that AQE may split a text of many copies
    hits = stored(hits, "group-hits")
    joined = kept.withColumn("__key", text_key).join(hits, F.col("__key") == F.col("key"), "left").drop("__key", "key")
    names = [*kept.columns, *OUTPUT.names]

    def finish(batches):
        for batch in text_slices(batches):
            words = [alnum_words(t) for t in batch.column("text").to_pylist()]
            covered: list = [None] * len(words)
            for i, groups_runs in enumerate(batch.column("__runs").to_pylist()):
                if groups_runs:
                    covered[i] = np.zeros(len(words[i]), bool)
                    for runs in groups_runs:
                        for a, b in zip(runs[::2], runs[1::2]):
                            covered[i][a:b] = True
            yield _annotated(batch, words, covered, [x or [] for x in batch.column("__items").to_pylist()], names)
    return joined.mapInArrow(finish, T.StructType(kept.schema.fields + OUTPUT.fields))


def _spans(text: str, covered: np.ndarray) -> list[dict]:
    """Character ranges from the first to the last word of each covered run."""
    at = [m.span() for m in WORD.finditer(text)]
    edges = _runs(covered)
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(edges[::2], edges[1::2])]


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The documents in which no benchmark window occurs, columns unchanged."""
    return annotate(docs, benchmark, size).filter("n_hit = 0").select(*docs.columns)


def digest(annotated: DataFrame) -> DataFrame:
    """The registered query's columns."""
    ids = F.array_sort(F.col("items").cast("array<string>"))
    return annotated.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
