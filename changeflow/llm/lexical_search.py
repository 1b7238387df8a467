"""Ranked lexical search for a stated set of queries (11).

The documents are read once to build an index in segments: each segment holds
the documents of about ``SEGMENT_BYTES`` of text, in order of their ids, and
for every term of the queries the list of its documents and frequencies.  A
segment is one row of a written table.  Document frequencies, the number of
documents and of terms are aggregated from the segments; then every segment
answers all queries without a shuffle, and the best ``k`` of each task are
merged by a top-k by query.  A task's later segments start from the k-th best
score of its earlier ones.

Within a segment a query is answered by a hybrid of the two orders.  Its
short lists, those that together hold fewer postings than the segment has
documents in ``SHORT_SHARE``, are worked off term at a time into summed
accumulators.  Sorted by document these are one more list, bounded by its
largest sum, beside the long lists.  The documents are then visited in order,
``WAVE`` at a time: a block of ``BLOCK`` documents is skipped if the bounds
of all lists in it cannot beat the k-th best score so far; in the blocks that
are left the accumulators are read first, then the long lists in order of
their bounds, and a document is given up as soon as what is left cannot lift
it.  The k-th largest accumulator is a bound from the start.  Equal scores go
to the smaller id, which is the one visited first.

A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), a posting is worth
w * ((10^9 tf) div (1000 tf + 8 m)) with m = 25 + ((75 n N) div L); all of it
is integer arithmetic of 64 bits, so scores do not depend on the order of
sums.  Postings without their weight are computed once a segment.

The queries are broadcast in groups of at most ``GROUP_BYTES`` of text, or one
query; each group reads the documents once.

Defined cases: a null or empty text has no term, is no result and does not
count for N; a query without a term, or of unknown terms, has no result; a
term that every document holds weighs 0 and gives none; repeated documents
and queries are separate rows, a repeated query has its ranks twice, told
apart by ``query``; null document ids come after all others among equals, null
item ids are kept; empty tables give an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changeflow.llm.common import _ALNUM, alnum_words, scratch, stored, text_slices

SEGMENT_BYTES = 12 << 20
GROUP_BYTES = 8 << 20
BLOCK, WAVE = 64, 2048
SHORT_SHARE = 4
NO_ID = np.iinfo(np.int64).max
SEGMENT = "docs array<long>, lengths array<int>, terms array<int>, held array<int>, at array<int>, tf array<int>"


class Query:
    """A query's distinct terms and how often each occurs in it."""

    def __init__(self, terms: dict[int, int]):
        self.terms = np.fromiter(terms, np.int64, len(terms))
        self.times = np.fromiter(terms.values(), np.int64, len(terms))


def vocabulary(texts: list[str | None]) -> tuple[dict[bytes, int], list[Query]]:
    """The numbered terms of the queries, and the queries."""
    numbers: dict[bytes, int] = {}
    queries = [Query({numbers.setdefault(t, len(numbers)): n for t, n in Counter(alnum_words(x)).items()}) for x in texts]
    return numbers, queries


def _count_terms(texts: list[str | None], numbers: dict[bytes, int], least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, term, tf) of the numbered terms and all documents' lengths."""
    at: list[np.ndarray] = []
    lengths = np.zeros(len(texts), np.int64)
    get = numbers.get
    for i, text in enumerate(texts):
        if text:
            words = text.encode().translate(_ALNUM).split()
            lengths[i] = len(words)
            own = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            at.append(own[own >= 0] + (i + least) * len(numbers))
    keys, tf = np.unique(np.concatenate([np.zeros(0, np.int64), *at]), return_counts=True)
    return keys, tf, lengths


def segments(docs: DataFrame, numbers: dict[bytes, int], segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One row a segment: ids and lengths of its documents; its terms, the
    number of documents of each, and the lists of documents (by place in the
    segment) and frequencies one after another."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)     # bounded by GROUP_BYTES

    def row(ids: list, parts: list) -> pa.RecordBatch:
        numbers = max(len(shared.value), 1)
        ids = np.concatenate(ids)
        keys, tf = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        lengths = np.concatenate([p[2] for p in parts])
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        doc, term = place[keys // numbers], keys % numbers
        by_term = np.lexsort((doc, term))
        terms, held = np.unique(term, return_counts=True)
        ids = ids[order]
        values = [pa.array(ids, mask=ids == NO_ID), pa.array(lengths[order], pa.int32()), pa.array(terms, pa.int32()),
                  pa.array(held, pa.int32()), pa.array(doc[by_term], pa.int32()), pa.array(tf[by_term], pa.int32())]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values],
                                          ["docs", "lengths", "terms", "held", "at", "tf"])

    def run(batches):
        ids, parts, size, n = [], [], 0, 0
        for batch in text_slices(batches):
            own = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = batch.column("text")
            ids.append(own)
            parts.append(_count_terms(texts.to_pylist(), shared.value, n))
            n += len(own)
            size += texts.nbytes
            if size >= segment_bytes:
                yield row(ids, parts)
                ids, parts, size, n = [], [], 0, 0
        if ids:
            yield row(ids, parts)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SEGMENT)


def statistics(index: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(N, L, document frequency of each numbered term).  What reaches the
    driver is bounded by the terms of one group of queries."""
    count = lambda x: x > 0                                         # noqa: E731
    total = index.agg(F.sum(F.size(F.filter("lengths", count))), F.sum(F.aggregate(F.transform("lengths", lambda x: x.cast("long")),
                      F.lit(0).cast("long"), lambda a, x: a + x))).first()
    held = index.select(F.explode(F.arrays_zip("terms", "held")).alias("t")).groupBy("t.terms").agg(F.sum("t.held").alias("df"))
    df = np.zeros(n_terms, np.int64)
    for r in held.collect():
        df[r.terms] = r.df
    return total[0] or 0, total[1] or 0, df


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Segment:
    """The lists of one segment, and the search in it."""

    def __init__(self, row: dict, n_docs: int, n_words: int):
        self.ids, lengths = row["docs"], row["lengths"].astype(np.int64)
        m = 25 + (75 * lengths * n_docs) // n_words
        self.at, tf = row["at"].astype(np.int64), row["tf"].astype(np.int64)
        self.worth = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.at])
        ends = np.cumsum(row["held"].astype(np.int64))
        self.lists = dict(zip(row["terms"].tolist(), zip((ends - row["held"]).tolist(), ends.tolist())))
        self.n_blocks = -(-len(self.ids) // BLOCK)
        self.bounds: dict[int, np.ndarray] = {}

    def bound(self, term: int) -> np.ndarray:
        """The largest worth of a posting of ``term`` in each block."""
        if term not in self.bounds:
            a, b = self.lists[term]
            self.bounds[term] = self._block_max(self.at[a:b], self.worth[a:b])
        return self.bounds[term]

    def _block_max(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n_blocks, np.int64)
        if len(at):
            block = at // BLOCK
            first = np.flatnonzero(np.diff(block, prepend=-1))
            out[block[first]] = np.maximum.reduceat(value, first)
        return out

    def search(self, query: Query, weight: np.ndarray, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the best ``k``, best first; scores below
        ``floor`` are not wanted."""
        held = [(self.lists[t], t, f) for t, f in zip(query.terms.tolist(), (weight[query.terms] * query.times).tolist())
                if f > 0 and t in self.lists]
        held.sort(key=lambda x: x[0][1] - x[0][0])
        # term at a time: the short lists, summed into accumulators
        left, n_short = len(self.ids) // SHORT_SHARE, 0
        while n_short < len(held) and (left := left - (held[n_short][0][1] - held[n_short][0][0])) >= 0:
            n_short += 1
        sums = np.zeros(len(self.ids), np.int64)
        for (a, b), _, f in held[:n_short]:
            sums[self.at[a:b]] += f * self.worth[a:b]
        acc_at = np.flatnonzero(sums)
        acc = sums[acc_at]
        # document at a time: blocks in order, over the accumulators and the long lists
        lists = sorted(((f * self.bound(t), a, b, f) for (a, b), t, f in held[n_short:]), key=lambda x: -int(x[0].max()))
        rest = np.zeros((len(lists) + 1, self.n_blocks), np.int64)        # of the lists from this one on
        for i in range(len(lists) - 1, -1, -1):
            rest[i] = rest[i + 1] + lists[i][0]
        bound = rest[0] + self._block_max(acc_at, acc)
        # a score that k documents reach
        least = max(floor, int(np.partition(acc, len(acc) - k)[len(acc) - k]) if len(acc) >= k else 1)
        best_at, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        blocks_a_wave = WAVE // BLOCK
        for first in range(0, self.n_blocks, blocks_a_wave):
            last = min(first + blocks_a_wave, self.n_blocks)
            # a score equal to the k-th best of those visited comes too late
            need = max(least, int(best[-1]) + 1 if len(best) == k else 1)
            alive = bound[first:last] >= need
            if not alive.any():
                continue
            lo, hi = first * BLOCK, min(last * BLOCK, len(self.ids))
            at = np.flatnonzero(np.repeat(alive, BLOCK)[:hi - lo]) + lo
            score = sums[at]
            for i, (_, a, b, f) in enumerate(lists):
                a, b = a + np.searchsorted(self.at[a:b], (lo, hi))
                if a == b:
                    continue
                if len(at) * 8 < b - a:             # few documents are left: seek them
                    found = np.minimum(a + np.searchsorted(self.at[a:b], at), b - 1)
                    score += np.where(self.at[found] == at, f * self.worth[found], 0)
                else:
                    wave = np.zeros(hi - lo, np.int64)
                    wave[self.at[a:b] - lo] = self.worth[a:b]
                    score += f * wave[at - lo]
                keep = score + rest[i + 1][at // BLOCK] >= need
                if not keep.all():
                    at, score = at[keep], score[keep]
                    if not len(at):
                        break
            good = score >= need
            best_at, best = np.concatenate([best_at, at[good]]), np.concatenate([best, score[good]])
            order = np.lexsort((best_at, -best))[:k]
            best_at, best = best_at[order], best[order]
        return best_at, best


def _groups(items: DataFrame, group_bytes: int) -> list[DataFrame]:
    """The queries in groups of about ``group_bytes``: by hash, as many as
    their bytes ask for."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = max(1, -(-size // group_bytes))
    if n == 1:
        return [items]
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [items.filter(part == i) for i in range(n)]


def search(docs: DataFrame, items: DataFrame, k: int = 10, segment_bytes: int = SEGMENT_BYTES,
           group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(query, item_id, rank, doc_id, score): the ``k`` best of ``docs``
    (doc_id, text) for every row of ``items`` (item_id, text).  ``query``
    tells rows of one item_id apart."""
    spark = docs.sparkSession
    found = []
    for g, group in enumerate(_groups(items.select(F.col("item_id").cast("long"), "text"), group_bytes)):
        rows = group.collect()                                      # at most group_bytes, or one query's copies
        numbers, queries = vocabulary([r.text for r in rows])
        with scratch(spark):
            index = stored(segments(docs, numbers, segment_bytes), "segments")
            n_docs, n_words, df = statistics(index, len(numbers))
            found.append(stored(_search_segments(index, [(g << 32) + i for i in range(len(rows))], [r.item_id for r in rows],
                                                 queries, weights(n_docs, df), n_docs, n_words, k), "found", keep=True))
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    best = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query", "item_id", "rank", "doc_id", "score"))


def _search_segments(index: DataFrame, numbers: list[int], item_ids: list, queries: list[Query], weight: np.ndarray,
                     n_docs: int, n_words: int, k: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast((numbers, item_ids, queries, weight))     # bounded by GROUP_BYTES

    def run(batches):
        numbers, item_ids, queries, weight = shared.value
        # each query's best (ids, scores) of the segments so far: the next one must reach the k-th
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name).slice(i, 1).flatten() for name in batch.schema.names}
                row = {name: v.fill_null(NO_ID).to_numpy() if name == "docs" else v.to_numpy() for name, v in row.items()}
                segment = Segment(row, n_docs, max(n_words, 1))
                for j, (query, (ids, scores)) in enumerate(zip(queries, best)):
                    at, score = segment.search(query, weight, k, int(scores[-1]) if len(scores) == k else 1)
                    if len(at):
                        ids, scores = np.concatenate([ids, segment.ids[at]]), np.concatenate([scores, score])
                        order = np.lexsort((ids, -scores))[:k]
                        best[j] = ids[order], scores[order]
        n = [len(ids) for ids, _ in best]
        ids = np.concatenate([np.zeros(0, np.int64), *(ids for ids, _ in best)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(numbers, np.int64), n)), pa.array([x for x, m in zip(item_ids, n) for _ in range(m)], pa.int64()),
             pa.array(ids, mask=ids == NO_ID), pa.array(np.concatenate([np.zeros(0, np.int64), *(s for _, s in best)]))],
            ["query", "item_id", "doc_id", "score"])
    return index.mapInArrow(run, "query long, item_id long, doc_id long, score long")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The registered query's columns."""
    return search(docs, items).drop("query")
