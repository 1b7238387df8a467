"""N-gram Jaccard join with adaptive multi-match prefixes (10).

A document's set holds the hashes of its distinct ``width``-word shingles, in
the order of their values.  Documents of Jaccard similarity t share at least
ceil(t n) of the n shingles of either; so if a prefix of n - ceil(t n) + l
shingles is taken of each, they share l of them (the smaller l of the two).
The first round uses l = 1 + LENGTHEN of the shortest prefix, for all
documents.  A document of which fewer prefix shingles occur elsewhere than
the smallest l it can meet has no partner and goes; that removes most
documents before any pair is made.

The others' prefix shingles vote for a hub, of the documents that hold them
the one whose shingles are the most widely shared; each document is compared
with its hub, which joins groups of copies in linear time.  Then pairs of
different components are formed over shingles that at most ``LIGHT``
documents hold.  Sets of n and m shingles must share a = ceil(t (n + m) / (1 +
t)), and their prefixes the smaller l + a - ceil(t n) of the two; a pair is
verified if its light matches, and the heavy ones it may have besides, reach
that.  A pair that this misses shares heavy shingles alone: both documents
have at least l of them.

Those documents, whose candidates would cost most, form the next round, with
their prefixes lengthened to the whole set and l to ceil(t n): of the c
shingles that other components hold only the rarest c - l + 1 are needed then, and
the r-th of them only for partners with which at most c - r + 1 must be
shared.  This order of shingles is fixed once: two documents that stay in
different components share one of those shingles as long as they do, so only
these rows are looked at from then on.  Hub steps join the groups: first each
document meets its hub, then, up to ``TURNS`` times and while links are found,
those outside a shingle's largest component meet the ``CANDIDATES`` of its
documents that most of their shingles name, others each turn.  Every turn
costs a few comparisons a document.  What remains are documents that hardly
link with each other: rows outside a shingle's largest component are matched
with its other rows of a size that may link.

Pairs are verified on whole texts, grouped by hub, hot hubs dealt over
several tasks.  Within a component known so far no pair is formed: links
that connect nothing new are not looked for, none between two components is
lost.

Defined cases: null and empty texts have an empty set and link with nothing;
a text of fewer words than ``width`` has one shingle, its whole sequence;
rows that repeat an id and text are one node; null ids are allowed, and a
component of null ids alone gets a null id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changeflow.llm.common import (ALWAYS, ASCII_LOWER, SMALL_SLICE, ranges, release_shuffles, rows_that_may_match, scratch, stored,
                                   stored_by, text_slices)
from changeflow.llm.components import components
from changeflow.llm.rolling import BASES, WordHashes, Windows, mix

LENGTHEN = 0.25     # of n - ceil(t n), added to the prefixes of the first round
LIGHT = 16          # documents of a shingle over which all pairs may be formed
SIZE_STEP = 1.05    # ratio of the set sizes of one class
TURNS = 4           # hub steps of the second round at most
CANDIDATES = 3      # nodes a document is compared with in each of them
WORTH = 10          # pairs compared for a link, beyond which hub steps end
LINEAR = 4          # pairs a row that may be left for the last step
HUB_TEXTS = 512     # texts that one task compares with a hub
PASSES = 4          # parts of the first round's tokens, shuffled one after another
KEPT_WORDS = 100_000
PROFILES = "doc_id long, node long, n int, prefix array<long>"


def shingle_sets(texts: list[str | None], width: int, hashes: WordHashes) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = [t.encode().translate(ASCII_LOWER).split() if t else [] for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(counts) - counts
    windows = Windows(np.concatenate([np.zeros(0, np.uint64), *(hashes(w) for w in words)]), BASES[0])
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = ranges(starts, n)
    length = np.repeat(np.minimum(counts, width), n)
    h = windows(first, first + length)
    if (length < width).any():        # a short text never equals a part of a longer one
        h = np.where(length < width, mix(h ^ length.astype(np.uint64)), h)
    ends = np.cumsum(n)
    return [np.unique(h[b - k:b]) if k else np.zeros(0, np.uint64) for b, k in zip(ends.tolist(), n.tolist())]


def least_shared(n, percent: int):
    """ceil(t n): what a set of ``n`` shares at least with any partner."""
    return -(-percent * n // 100)


def matches(n, percent: int):
    """l of the first round for a set of ``n``."""
    return 1 + ((n - least_shared(n, percent)) * LENGTHEN) // 1


def _matches_sql(n: Column, percent: int) -> Column:
    return (1 + F.floor((n - F.ceil(percent * n / 100)) * LENGTHEN)).cast("int")


def profiles(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, node, n, prefix) of every document."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("node"), "text")

    def run(batches):
        hashes = WordHashes(KEPT_WORDS)
        for batch in text_slices(batches, max_bytes=SMALL_SLICE):
            sets = shingle_sets(batch.column("text").to_pylist(), width, hashes)
            n = np.array([len(s) for s in sets], np.int64)
            size = np.minimum(n, n - least_shared(n, percent) + matches(n, percent)).astype(np.int64)
            prefix = np.concatenate([np.zeros(0, np.uint64), *(s[:k] for s, k in zip(sets, size))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("node"), pa.array(n.astype(np.int32)),
                 pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.array(prefix.view(np.int64)))],
                ["doc_id", "node", "n", "prefix"])
    return rows.mapInArrow(run, PROFILES)


def _shared(rows: DataFrame) -> DataFrame:
    """``rows`` (token, node, n) whose token another row has too, with the
    number of rows that have it.  The counts are written before the join, so
    that AQE may split a hot token's rows; so are those below."""
    counts = stored(rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "counts")
    release_shuffles(rows.sparkSession)
    return rows.join(counts, "token")


def _hub_pairs(rows: DataFrame) -> DataFrame:
    """(x, y): each node y with the node x that most often is the hub of its
    tokens, the one of the highest score (the mean number of holders)."""
    hubs = (rows.groupBy("token").agg(F.max(F.struct("score", "node")).alias("hub"), F.count(F.lit(1)).alias("held"))
            .filter("held > 1").select("token", F.col("hub.node").alias("x")))
    hubs = stored(hubs, "hubs")
    release_shuffles(rows.sparkSession)
    votes = rows.join(hubs, "token").filter("x != node").groupBy("node", "x").agg(F.count(F.lit(1)).alias("v"))
    return (votes.groupBy("node").agg(F.max(F.struct("v", "x")).alias("best"))
            .select(F.col("best.x").alias("x"), F.col("node").alias("y")))


def verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (x, y) that link.  ``texts``: (node, text), one row a node.
    Texts are sorted so that a hub's text stands before those it is compared
    with; a hub of many pairs is dealt over tasks with a copy of its text."""
    pairs = stored(pairs, "pairs")
    n = stored(pairs.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / HUB_TEXTS).cast("int").alias("n")), "pairs-of-hubs")
    release_shuffles(pairs.sparkSession)        # those of the pairs, before texts are shuffled
    dealt = pairs.join(n, "x").select("x", "y", F.pmod(F.xxhash64("y"), "n").cast("int").alias("part"))
    hubs = n.select("x", F.col("x").alias("y"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
    rows = dealt.unionByName(hubs)
    rows = rows.join(texts, rows["y"] == texts["node"]).select("x", "part", (F.col("x") != F.col("y")).alias("member"), "y", "text")
    rows = rows.repartition("x", "part").sortWithinPartitions("x", "part", "member", "y")

    def compare(batches):
        hashes = WordHashes(KEPT_WORDS)
        hub, own = None, np.zeros(0, np.uint64)
        for batch in text_slices(batches, max_bytes=SMALL_SLICE):
            out: tuple[list, list] = [], []
            sets = shingle_sets(batch.column("text").to_pylist(), width, hashes)
            for x, member, y, s in zip(batch.column("x").to_pylist(), batch.column("member").to_pylist(),
                                       batch.column("y").to_pylist(), sets):
                if not member:
                    hub, own = x, s
                    continue
                if x != hub:
                    raise RuntimeError("a document stands before its hub")
                least, most = sorted((len(s), len(own)))
                if 100 * least < percent * most:
                    continue
                both = len(np.intersect1d(s, own, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(own) - both):
                    out[0].append(x)
                    out[1].append(y)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["a", "b"])
    return rows.mapInArrow(compare, "a long, b long")


def _with_root(rows: DataFrame, roots: DataFrame) -> DataFrame:
    r = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    return rows.join(r, rows["node"] == r["__node"], "left").withColumn("root", F.coalesce("__root", "node")).drop("__node", "__root")


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """What sets of ``n`` and ``m`` must share to link."""
    return F.ceil(percent * (n + m) / (100 + percent))


def _sizes_allow(percent: int) -> Column:
    return 100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")


def _light_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of nodes of different components over light tokens whose
    matches may reach what their sizes ask for.  ``rows``: token, node, n,
    root, c (shared tokens of the node's prefix), h (heavy ones)."""
    a, b = (rows.select("token", *(F.col(k).alias(f"{k}_{side}") for k in ("node", "n", "root", "c", "h"))) for side in "xy")

    def more(n: Column) -> Column:      # l - ceil(t n)
        return _matches_sql(n, percent) - F.ceil(percent * n / 100)
    need = _overlap(F.col("n_x"), F.col("n_y"), percent) + F.least(more(F.col("n_x")), more(F.col("n_y")))
    both = a.join(b, "token").filter((F.col("node_x") < F.col("node_y")) & (F.col("root_x") != F.col("root_y"))
                                     & _sizes_allow(percent) & (F.least("c_x", "c_y") >= need))
    return (both.withColumn("need", need).groupBy(F.col("node_x").alias("x"), F.col("node_y").alias("y"))
            .agg(F.count(F.lit(1)).alias("matches"), F.max("need").alias("need"), F.max(F.least("h_x", "h_y")).alias("h"))
            .filter("matches + h >= need").select("x", "y"))


def _rare_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of nodes of different components over the rarest tokens.
    ``rows``: token, node, n, root, left (shared tokens from this one on)."""
    held = rows.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k"))
    largest = held.groupBy("token").agg(F.max_by("root", F.struct("k", "root")).alias("largest"), F.count(F.lit(1)).alias("roots"))
    rows = stored(rows.join(stored(largest.filter("roots > 1").drop("roots"), "largest"), "token"), "rare-rows")

    def size_class(n: Column) -> Column:
        return F.floor(F.log(n.cast("double")) / float(np.log(SIZE_STEP)) + 1e-9).cast("int")
    n = F.col("n")
    low, high = F.ceil(percent * n / 100), F.least(F.floor(100 * n / percent), F.floor(F.col("left") * (100 + percent) / percent) - n)
    asks = (rows.filter((F.col("root") != F.col("largest")) & (low <= high))
            .select("token", F.explode(F.sequence(size_class(low), size_class(high))).alias("class"),
                    *(F.col(k).alias(f"{k}_x") for k in ("node", "n", "root", "left"))))
    held = rows.select("token", size_class(n).alias("class"), *(F.col(k).alias(f"{k}_y") for k in ("node", "n", "root", "left")))
    both = asks.join(held, ["token", "class"]).filter(
        (F.col("root_x") != F.col("root_y")) & _sizes_allow(percent)
        & (F.least("left_x", "left_y") >= _overlap(F.col("n_x"), F.col("n_y"), percent)))
    return both.select(F.least("node_x", "node_y").alias("x"), F.greatest("node_x", "node_y").alias("y")).distinct()


def _alive(known: DataFrame, percent: int) -> DataFrame:
    """Of the first round, the documents that share enough of their prefixes:
    node, n, score (mean number of holders) and the shared tokens.

    The prefixes are the most rows of the join.  Their tokens are dealt over
    ``PASSES`` parts, each shuffled after the one before has been released, so
    executors' disks hold one part and the shared rows found so far."""
    rows = known.select(F.explode("prefix").alias("token"), "node", "n")
    part = F.pmod(F.xxhash64("token"), F.lit(PASSES))
    found = []
    for p in range(PASSES):
        found.append(stored(_shared(rows.filter(part == p)), "shared"))
        release_shuffles(known.sparkSession)
    rows = reduce(DataFrame.unionByName, found)
    alive = rows.groupBy("node").agg(F.max("n").alias("n"), F.avg("df").alias("score"), F.collect_set("token").alias("tokens"))
    return alive.filter(F.size("tokens") >= _least_matches(percent))


def _least_matches(percent: int) -> Column:
    return _matches_sql(F.greatest(F.lit(1), F.ceil(percent * F.col("n") / 100)), percent)


def _more_links(edges: DataFrame | None, pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``edges`` and the links among ``pairs``, written."""
    with scratch(texts.sparkSession):
        found = verify(pairs, texts, width, percent)
        out = stored(found if edges is None else edges.unionByName(found), "links", keep=True)
    release_shuffles(texts.sparkSession)
    return out


def link_edges(docs: DataFrame, alive: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (a, b) whose components are those of all links, among the
    documents ``alive``.  Sets meet the components by node as arrays, in tables
    bucketed by node, so their shingles are shuffled by token alone."""
    spark = docs.sparkSession
    texts = docs.select(F.xxhash64("doc_id", "text").alias("node"), "text")
    # not a semi join, which Spark would move below the filter by bits
    texts = rows_that_may_match(texts, "node", alive).join(alive.select("node"), "node")
    texts = stored_by(texts.groupBy("node").agg(F.first("text").alias("text")), "node")
    release_shuffles(spark)
    # round 1: prefixes of all documents
    rows = alive.select(F.explode("tokens").alias("token"), "node", "n", "score", F.size("tokens").alias("c"))
    edges = _more_links(None, _hub_pairs(rows), texts, width, percent)
    # only tokens that other components hold too can link to one
    rows = _with_root(alive.select("node", "tokens"), components(edges)).select(F.explode("tokens").alias("token"), "node", "root")
    rows = stored(_held_by_several(rows), "several")
    heavy = rows.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.sum((F.col("held") > LIGHT).cast("int")).alias("h"))
    heavy = stored(heavy.join(alive.select("node", "n"), "node").filter(F.col("c") >= _least_matches(percent)), "matches")
    light = rows.filter(F.col("held") <= LIGHT).join(heavy, "node")
    edges = _more_links(edges, _light_pairs(light, percent), texts, width, percent)

    # round 2: whole sets of the documents that may share heavy tokens alone
    chosen = stored(texts.join(heavy.filter(F.col("h") >= _least_matches(percent)).select("node"), "node", "left_semi"), "costly")
    if chosen.isEmpty():
        return edges
    with scratch(spark):
        # a token that one component holds now links to no other one later, nor does any but a node's rarest
        whole = _with_root(stored_by(whole_sets(chosen, width), "node"), components(edges))
        whole = whole.select(F.explode("tokens").alias("token"), "node", "n", "root")
        ranked = stored_by(_rarest(whole, percent), "node", keep=True)
    release_shuffles(spark)
    for turn in range(TURNS):
        pairs = stored(_hub_pairs(ranked) if turn == 0 else _pairs_with_largest(ranked, turn), "hub-pairs")
        before, edges = edges.count(), _more_links(edges, pairs, texts, width, percent)
        with scratch(spark):
            again = stored(_with_root(ranked.drop("root"), components(edges)), "rooted")
            ranked = stored(_held_by_several(again).drop("held"), "rarest", keep=True)
        if (edges.count() - before) * WORTH < pairs.count() or _pair_cost(ranked) <= LINEAR * ranked.count():
            break
    return _more_links(edges, _rare_pairs(ranked, percent), texts, width, percent)


def _pair_cost(rows: DataFrame) -> int:
    """Pairs that rows outside a token's largest component form with the
    token's rows, at most."""
    held = rows.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.sum("k").alias("n"), F.max("k").alias("most"))
    return held.agg(F.coalesce(F.sum((F.col("n") - F.col("most")) * F.col("n")), F.lit(0))).first()[0]


def _pairs_with_largest(rows: DataFrame, turn: int) -> DataFrame:
    """(x, y): each node y that is outside a token's largest component with
    nodes x of that component, the ``CANDIDATES`` that most of its tokens name.
    A token names one, another one each turn."""
    held = rows.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct(F.xxhash64("node", "token", F.lit(turn)), "node")).alias("named"))
    largest = held.groupBy("token").agg(F.max(F.struct("k", "root", "named")).alias("top"))
    outside = rows.join(stored(largest, "largest"), "token").filter(F.col("root") != F.col("top.root"))
    votes = outside.select("node", F.col("top.named.node").alias("x")).groupBy("node", "x").agg(F.count(F.lit(1)).alias("v"))
    best = W.partitionBy("node").orderBy(F.desc("v"), F.xxhash64("x", F.lit(turn)))
    return votes.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= CANDIDATES).select("x", F.col("node").alias("y"))


def _held_by_several(rows: DataFrame) -> DataFrame:
    """``rows`` whose token more than one component (root) holds, with the
    number of the token's rows."""
    several = (rows.groupBy("token").agg(F.count(F.lit(1)).alias("held"), F.min("root").alias("lo"), F.max("root").alias("hi"))
               .filter("lo != hi").select("token", "held"))
    several = stored(several, "tokens-of-several")
    release_shuffles(rows.sparkSession)
    return rows.join(several, "token")


def _rarest(rows: DataFrame, percent: int) -> DataFrame:
    """Of whole sets (token, node, n, root), the tokens that may be the first
    one shared with another component: left is the number of the node's tokens
    that others hold, from this one on, in order of rarity."""
    mine = W.partitionBy("node")
    rows = _held_by_several(rows)
    rows = rows.withColumns({"c": F.count(F.lit(1)).over(mine), "r": F.row_number().over(mine.orderBy("held", "token")),
                             "score": F.avg("held").over(mine)})
    return (rows.withColumn("left", F.col("c") - F.col("r") + 1).filter(F.col("left") >= F.ceil(percent * F.col("n") / 100))
            .select("token", "node", "n", "root", "score", "left"))


def whole_sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, n, tokens): the whole set of every text."""
    def run(batches):
        hashes = WordHashes(KEPT_WORDS)
        for batch in text_slices(batches, max_bytes=SMALL_SLICE):
            sets = shingle_sets(batch.column("text").to_pylist(), width, hashes)
            n = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(n.astype(np.int32)),
                 pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32),
                                          pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))],
                ["node", "n", "tokens"])
    return texts.select("node", "text").mapInArrow(run, "node long, n int, tokens array<long>")


def join(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, node, root, n_shingles, component_id of every document: root is
    the smallest node that links reach, component_id the smallest doc_id, its
    own included."""
    spark = docs.sparkSession
    with scratch(spark):
        with scratch(spark):
            known = stored(profiles(docs, width, percent), "profiles")
            ids = stored(known.select("doc_id", "node", "n"), "ids", keep=ALWAYS)
            alive = stored_by(_alive(known, percent), "node", keep=True)
        release_shuffles(spark)
        roots = stored(components(link_edges(docs, alive, width, percent)), "roots", keep=ALWAYS)
    release_shuffles(spark)
    rows = _with_root(ids, roots)
    least = rows.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "root", "left").select(
        "doc_id", "node", "root", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    """The registered query's columns."""
    return join(docs.select("doc_id", "text")).drop("node", "root")


def keep_one(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """``docs``, columns unchanged, with one row of each component: the one
    with the smallest doc_id, null after all others; of texts that share it,
    the smallest text hash; of rows that repeat id and text, the smallest hash
    of the other columns.

    Rows of one node are met before the join, combined map-side, so a row that
    is repeated often does not land in one task."""
    found = join(docs, width, percent)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node"))
    kept = found.groupBy("root").agg(first.alias("first")).select(F.col("first.node").alias("__node"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    tie = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
    own = (docs.groupBy(F.xxhash64("doc_id", "text").alias("__node"))
           .agg(F.min_by(F.struct(*docs.columns), tie).alias("__row")))
    return own.join(kept, "__node", "left_semi").select("__row.*")
