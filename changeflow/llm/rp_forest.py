"""Approximate nearest neighbours by a forest of random-projection trees (6).

Nearness is the inner product.  Vectors are lengthened by one component,
sqrt(M^2 - |x|^2) with M the largest norm of all rows and 0 for a query; the
nearest by inner product are then the nearest by distance.

The forest is fitted on a bounded sample, the ``fit_rows`` rows with the
smallest hash of their id: each node splits its sample at the median of a
random projection.  Trees are as deep as leaves of about ``LEAF_ROWS`` rows
ask, up to what the sample can split: with 20,000 rows 2^9 leaves a tree.
Every row is then indexed, by the leaf it falls into in
each tree.  A query searches all trees through one priority queue: nodes are
opened in order of the squared margins crossed on the way to them, until
``n_probe`` leaves have been taken.  ``n_probe`` is the smallest number that
reaches ``recall`` on the sample, where the true neighbours are known.

The rows of a leaf and the queries that take it meet in blocks of bounded
size, so a leaf that holds a third of all rows is dealt over many tasks; a
block returns each query's best ``k`` with ties, scored in double precision on
the original vectors, and the blocks' results are merged by another top-k.

Defined cases: vectors that are null, empty, zero, hold null or non-finite
components, have no id or not the most frequent length take no part; of rows
with one id the vector that sorts first counts; fewer candidates than ``k``
are all returned; ties go to the smaller id; an empty table, or one without a
query, gives no row; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changeflow.llm.common import stored

FIT_ROWS = 20_000
TREES = 8
LEAST_DEPTH = 6           # of tables whose sample has that many leaves
LEAF_ROWS = 512           # rows a leaf holds about, while the sample allows
LEAF_SAMPLE = 32          # sample rows a leaf holds at least
CALIBRATION_QUERIES = 300
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096
RECALL = 0.96


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding): the rows that take part, one an id."""
    v = F.col("embedding")
    good = (F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
            & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
            & F.exists(v, lambda x: x != 0))
    rows = vectors.select(F.col("vec_id").cast("long"), v.cast("array<double>").alias("embedding")).filter(F.coalesce(good, F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


class Forest:
    """Complete trees of one depth; node 1 is the root, 2i and 2i + 1 its halves."""

    def __init__(self, sample: np.ndarray, norm: float, trees: int, depth: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.depth, self.trees, self.norm = depth, trees, norm
        x = self.lengthen(sample)
        n_nodes = 1 << depth
        self.normal = rng.standard_normal((trees, n_nodes, x.shape[1]))
        self.normal /= np.linalg.norm(self.normal, axis=2, keepdims=True)
        self.cut = np.zeros((trees, n_nodes))
        for t in range(trees):
            node = np.ones(len(x), np.int64)
            for level in range(depth):
                for i in range(1 << level, 2 << level):
                    own = np.flatnonzero(node == i)
                    side = x[own] @ self.normal[t, i]
                    self.cut[t, i] = np.median(side) if len(own) else 0.0
                    node[own] = 2 * i + (side >= self.cut[t, i])

    def lengthen(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm ** 2 - (x * x).sum(1), 0))
        return np.hstack([x, rest[:, None]])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf (tree * leaves + place) of every row in every tree."""
        x = self.lengthen(x)
        out = np.zeros((len(x), self.trees), np.int64)
        for t in range(self.trees):
            side = x @ self.normal[t].T >= self.cut[t]
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + side[np.arange(len(x)), node]
            out[:, t] = (t << self.depth) + node - (1 << self.depth)
        return out

    def search(self, queries: np.ndarray, n_probe: int) -> list[list[int]]:
        """For each query the first ``n_probe`` leaves off the shared queue."""
        x = np.hstack([queries, np.zeros((len(queries), 1))])
        first_leaf = 1 << self.depth
        out = []
        for margins in np.einsum("qd,tnd->qtn", x, self.normal) - self.cut:
            margins = margins.tolist()
            queue = [(0.0, t, 1) for t in range(self.trees)]
            found: list[int] = []
            while queue and len(found) < n_probe:
                cost, t, i = heapq.heappop(queue)
                if i >= first_leaf:
                    found.append((t << self.depth) + i - first_leaf)
                    continue
                m = margins[t][i]
                near, far = (2 * i + 1, 2 * i) if m >= 0 else (2 * i, 2 * i + 1)
                heapq.heappush(queue, (cost, t, near))
                heapq.heappush(queue, (cost + m * m, t, far))
            out.append(found)
        return out


def tree_depth(n_sample: int, n_rows: int) -> int:
    """Halvings until a leaf has about ``LEAF_ROWS`` rows; the sample's
    medians must rest on ``LEAF_SAMPLE`` rows a leaf."""
    halvings = lambda n: max(0, max(1, n).bit_length() - 1)     # noqa: E731
    return min(halvings(n_sample // LEAF_SAMPLE), max(LEAST_DEPTH, halvings(n_rows // LEAF_ROWS)))


def calibrate(forest: Forest, sample: np.ndarray, k: int, recall: float) -> int:
    """The smallest number of leaves that finds ``recall`` of the sample's own
    ``k`` nearest, for queries from the sample."""
    n_leaves = forest.trees << forest.depth
    if len(sample) < 2:
        return n_leaves
    queries = np.arange(min(CALIBRATION_QUERIES, len(sample)))
    leaves = forest.leaves(sample)
    scores = sample[queries] @ sample.T
    scores[queries, queries] = -np.inf
    k = min(k, len(sample) - 1)
    truth = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    needed = np.zeros((len(queries), k), np.int64)
    for q, order in enumerate(forest.search(sample[queries], n_leaves)):
        place = np.empty(n_leaves, np.int64)
        place[order] = np.arange(1, n_leaves + 1)
        needed[q] = place[leaves[truth[q]]].min(1)
    return int(np.quantile(needed, recall, method="higher"))


def _best(scores: np.ndarray, items: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int) -> list[tuple[float, int]]:
    """The k best by (score, smaller id); ``scores`` only choose who is scored
    again, in a summation order that does not depend on the block."""
    near = np.arange(len(ids))
    if len(ids) > k:
        least = np.partition(scores, len(ids) - k)[len(ids) - k]
        near = np.flatnonzero(scores >= least - 1e-9 * max(1.0, abs(least)))
    exact = np.add.reduce(items[near] * query, axis=1)
    order = np.lexsort((ids[near], -exact))[:k]
    return [(float(exact[o]), int(ids[near][o])) for o in order]


def search(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL,
           fit_rows: int = FIT_ROWS, trees: int = TREES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found for
    each row where ``is_query`` (over vec_id) holds, among all other rows."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    rows = stored(usable(vectors), "vectors")
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return spark.createDataFrame([], result)
    rows = rows.filter(F.size("embedding") == lengths.n)
    norm = rows.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))).first()[0] ** 0.5
    sample = np.array([r.embedding for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).collect()])
    depth = tree_depth(len(sample), lengths["count"])
    forest = Forest(sample, norm, trees, depth)
    n_probe = calibrate(forest, sample, k, recall)
    shared = spark.sparkContext.broadcast(forest)      # trees * 2^depth nodes

    def index(batches):
        for pdf in batches:
            if len(pdf):
                pdf["leaves"] = shared.value.leaves(np.vstack(pdf["embedding"])).tolist()
                yield pdf

    def probe(batches):
        for pdf in batches:
            if len(pdf):
                pdf["leaves"] = shared.value.search(np.vstack(pdf["embedding"]), n_probe)
                yield pdf
    schema = "vec_id long, embedding array<double>, leaves array<int>"
    indexed = stored(rows.mapInPandas(index, schema), "forest-index")
    queries = stored(rows.filter(is_query).mapInPandas(probe, schema), "forest-queries")
    items = indexed.select(F.explode("leaves").alias("leaf"), "vec_id", "embedding")
    asked = queries.select(F.explode("leaves").alias("leaf"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))

    # blocks of a leaf; one row a leaf, so the two counts may be broadcast
    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    counts = blocks(items, BLOCK_ROWS, "n_block").join(blocks(asked, BLOCK_QUERIES, "n_qblock"), "leaf")
    counts = F.broadcast(counts)
    items = items.join(counts, "leaf").select(
        "leaf", F.pmod(F.xxhash64("vec_id"), "n_block").cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("n_qblock") - 1)).alias("qblock"), "vec_id", "embedding")
    asked = asked.join(counts, "leaf").select(
        "leaf", F.explode(F.sequence(F.lit(0), F.col("n_block") - 1)).alias("block"),
        F.pmod(F.xxhash64("query_id"), "n_qblock").cast("int").alias("qblock"), "query_id", "query")

    def rerank(own, wanted):
        import pandas as pd
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(own) and len(wanted):
            x, ids = np.vstack(own["embedding"]), own["vec_id"].to_numpy()
            at = {int(v): i for i, v in enumerate(ids)}
            for a in range(0, len(wanted), 256):
                part = wanted.iloc[a:a + 256]
                q = np.vstack(part["query"])
                for query_id, vector, scores in zip(part["query_id"], q, q @ x.T):
                    others, own_ids = x, ids
                    if query_id in at:
                        mask = np.arange(len(ids)) != at[query_id]
                        others, own_ids, scores = x[mask], ids[mask], scores[mask]
                    if len(own_ids):
                        for score, vec_id in _best(scores, others, own_ids, vector, k):
                            out["query_id"].append(query_id)
                            out["vec_id"].append(vec_id)
                            out["score"].append(score)
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    keys = ("leaf", "block", "qblock")
    found = (items.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(rerank, "query_id long, vec_id long, score double")
             .groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    nearest = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
