"""Substring dedup by level-wise doubling of repeated windows (7).

Wanted are the words covered by a window of ``size`` words whose sequence
starts anywhere else in the corpus.  The search starts from short windows and
only those that repeat are extended to twice their length, until ``size`` is
reached or no candidate survives (for 35 words: 9, 18, 35).

Level 1 does not list every short window.  Of the short windows in each
window of ``size`` words the one with the least hash is its anchor; equal
windows have equal anchors, so a repeated window has a repeated anchor.
Consecutive windows with one anchor are a run; about one word in fourteen
starts one.  A run is kept as (hash of its anchor, hash of its whole
context), and a run whose anchor does not repeat is dropped.

Runs whose whole context repeats are repeated in all their windows, which
settles copies however many there are.  Where an anchor stands in different
contexts, one run of each context goes on: its windows are compared at twice
the anchor's length, and the survivors at full length.

Words are compared by 64-bit hashes of two independent families (anchor and
context or window), 128 bits in all.  Hot anchors and contexts are counted
with partial aggregation; joins back to the rows may be split by AQE.

Defined cases: words lie between ASCII white space; null and empty texts
have none; a text of fewer than ``size`` words has no window; rows that
repeat an id and text repeat each other's windows; null ids are kept; an
empty table gives an empty result; columns with the result's names are
replaced, others are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.llm.common import (forget_kept, ranges, rows_that_may_match, scratch, small_batches, space_words, stored,
                                   text_slices)
from changeflow.llm.rolling import BASES, WordHashes, Windows, sliding_argmin

SLICE = 1 << 20     # text hashed at once by a Python worker
KEPT_WORDS = 100_000
RUNS = "doc_id long, text_hash long, gram long, context long, first int, last int, at int"
_ADDED = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]


def first_length(size: int) -> int:
    """Windows of level 1: doubled twice they reach ``size``."""
    return -(-size // 4)


class _Slice:
    """Words of several documents in one sequence."""

    def __init__(self, texts: list[str | None], hashes: WordHashes):
        words = [space_words(t) for t in texts]
        self.counts = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.hashes = np.concatenate([hashes(w) for w in words]) if words else np.zeros(0, np.uint64)
        self.grams, self.wholes = (Windows(self.hashes, b) for b in BASES)


def runs(docs: DataFrame, size: int) -> DataFrame:
    """The anchored runs of windows of every document (see RUNS): windows
    start at words first to last, the anchor at word ``at``."""
    g = first_length(size)

    def find(batches):
        forget_kept()
        hashes = WordHashes(KEPT_WORDS)
        for batch in text_slices(batches, max_bytes=SLICE):
            s = _Slice(batch.column("text").to_pylist(), hashes)
            n = len(s.hashes)
            if n < size:
                continue
            at = np.arange(n - g + 1)
            anchors = sliding_argmin(s.grams(at, at + g), size - g + 1)
            room = np.maximum(s.counts - size + 1, 0)
            starts = ranges(s.starts, room)                  # windows within one document
            if not len(starts):
                continue
            anchor = anchors[starts]
            new = np.flatnonzero(np.concatenate([[True], np.diff(anchor) != 0]))
            first, last, anchor = starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1], anchor[new]
            doc = np.searchsorted(s.starts, first, "right") - 1
            # documents without words share a start with their successor
            own = s.starts[doc]
            gram, context = s.grams(anchor, anchor + g), s.wholes(first, last + size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), batch.column("text_hash").take(pa.array(doc)),
                 pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)),
                 *(pa.array((x - own).astype(np.int32)) for x in (first, last, anchor))],
                ["doc_id", "text_hash", "gram", "context", "first", "last", "at"])
    return docs.mapInArrow(find, RUNS)


def _same_doc(a: DataFrame, b: DataFrame) -> Column:
    return (a["text_hash"] == b["text_hash"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def candidate_windows(docs: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """Every window of the chosen runs: gram, pair (the window of twice the
    anchor's length that lies in it), window, document, anchor, first."""
    g = first_length(size)
    double = min(size, 2 * g)
    lists = chosen.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "last", "at")).alias("runs"))
    docs = rows_that_may_match(docs, "text_hash", chosen)
    rows = docs.join(lists, _same_doc(docs, lists)).select(docs["doc_id"], docs["text_hash"], docs["text"], lists["runs"])

    def expand(batches):
        forget_kept()
        hashes = WordHashes(KEPT_WORDS)
        for batch in text_slices(batches, max_bytes=SLICE):
            s = _Slice(batch.column("text").to_pylist(), hashes)
            lists = batch.column("runs")
            doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            flat = lists.flatten()
            first, last, at = (flat.field(k).to_numpy().astype(np.int64) + s.starts[doc] for k in range(3))
            n = last - first + 1
            start, at, doc = ranges(first, n), np.repeat(at, n), np.repeat(doc, n)
            ahead = at + double <= start + size              # extend the anchor to the right, else to the left
            pair_first = np.where(ahead, at, at + g - double)
            own = s.starts[doc]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), batch.column("text_hash").take(pa.array(doc)),
                 pa.array(s.grams(at, at + g).view(np.int64)), pa.array(s.wholes(pair_first, pair_first + double).view(np.int64)),
                 pa.array(s.wholes(start, start + size).view(np.int64)),
                 pa.array((at - own).astype(np.int32)), pa.array((start - own).astype(np.int32))],
                ["doc_id", "text_hash", "gram", "pair", "window", "at", "first"])
    return rows.mapInArrow(expand, "doc_id long, text_hash long, gram long, pair long, window long, at int, first int")


def repeated(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_hash, first, last): ranges of starts of windows that also
    start elsewhere.  ``docs``: doc_id, text, text_hash."""
    found = stored(runs(docs, size), "runs")
    # level 1: anchors that repeat
    anchors = (found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi"))
               .filter("n > 1").select("gram", (F.col("lo") != F.col("hi")).alias("mixed")))
    # written before the join, so that AQE may split a hot anchor's rows
    alive = stored(found.join(stored(anchors, "anchors"), "gram"), "repeated-runs")
    mixed = alive.filter("mixed")
    contexts = mixed.groupBy("gram", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_hash", "first", "last", "at")).alias("one"))
    contexts = stored(contexts, "contexts")
    whole = mixed.join(contexts.filter("n > 1").select("gram", "context"), ["gram", "context"])   # contexts is written
    settled = alive.filter("NOT mixed").select("doc_id", "text_hash", "first", "last").unionByName(
        whole.select("doc_id", "text_hash", "first", "last"))
    # level 2: one run of each context, its windows at twice the anchor's length
    tried = stored(candidate_windows(docs, contexts.select("one.*"), size), "windows")
    where = F.struct("doc_id", "text_hash", "at")
    pairs = (tried.groupBy("gram", "pair").agg(F.min(where).alias("lo"), F.max(where).alias("hi"))
             .filter("NOT lo <=> hi").select("gram", "pair"))
    doubled = stored(tried.join(stored(pairs, "pairs"), ["gram", "pair"]), "doubled")
    # level 3: full length
    windows = doubled.groupBy("gram", "window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram", "window")
    single = doubled.join(stored(windows, "repeated-windows"), ["gram", "window"]).select("doc_id", "text_hash", "first", F.col("first").alias("last"))
    return settled.unionByName(single)


def dedup(docs: DataFrame, size: int = 35) -> DataFrame:
    """``docs`` and n_words, n_removed, kept: the words that no repeated
    window covers, joined by one blank.  Windows are judged on the input."""
    small_batches(docs.sparkSession)
    names = [f.name for f in _ADDED]
    own = docs.drop(*names, "text_hash").withColumn("text_hash", F.xxhash64("doc_id", "text"))
    key = own.select(F.col("doc_id").cast("long"), "text", "text_hash")
    with scratch(docs.sparkSession):
        spans = repeated(key, size).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
        spans = stored(spans, "spans", keep=True)
    rows = own.join(spans, (own["text_hash"] == spans["text_hash"]) & own["doc_id"].cast("long").eqNullSafe(spans["doc_id"]), "left")
    kept = docs.drop(*names, "text_hash")
    rows = rows.select(*(own[c] for c in kept.columns), spans["spans"])
    columns = [*kept.columns, *names]

    def cut(batches):
        forget_kept()
        for batch in text_slices(batches, max_bytes=SLICE):
            n_words, n_removed, texts = [], [], []
            spans = batch.column(batch.num_columns - 1)
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = space_words(text)
                removed = 0
                if spans[i].is_valid:
                    own = spans[i].values
                    first, last = own.field(0).to_numpy(), own.field(1).to_numpy()
                    edge = np.bincount(first, minlength=len(words) + 1) - np.bincount(last + size, minlength=len(words) + 1)
                    covered = np.cumsum(edge)[:-1] > 0
                    removed = int(covered.sum())
                    words = [words[k] for k in np.flatnonzero(~covered)]
                n_words.append(len(words) + removed)
                n_removed.append(removed)
                texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                              pa.array(texts, pa.string())], columns)
    return rows.mapInArrow(cut, T.StructType([*kept.schema.fields, *_ADDED]))


def remove_repeated(docs: DataFrame, size: int = 35) -> DataFrame:
    """``docs``, columns unchanged, without the words of repeated windows; a
    text that loses none stays as it is, n_chars follows the text."""
    done = dedup(docs, size).withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """The registered query's columns."""
    return dedup(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
