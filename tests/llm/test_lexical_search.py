"""Ranked lexical search against brute force, in many shapes of segments."""

import math
import random
from collections import Counter

import pytest
from brute import alnum

from changeflow.llm import lexical_search as ls


def brute(docs, items, k=10):
    """Sorted (item_id, rank, doc_id, score)."""
    words = [(d, alnum(t)) for d, t in docs]
    counts = [(d, Counter(w), len(w)) for d, w in words if w]
    n_docs, n_words = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in counts:
            m = 25 + (75 * n * n_docs) // n_words
            score = 0
            for t in alnum(text):
                if tf := c.get(t):
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, math.inf if d is None else d))
        out += [(item, r, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def random_case(seed):
    """Documents of a skewed vocabulary, with copies; queries of rare and
    frequent terms."""
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.paretovariate(0.6)), 400)}"      # noqa: E731
    docs = [(rng.randrange(10**6), " ".join(word() for _ in range(rng.choice([1, 5, 30, 200])))) for _ in range(600)]
    docs += [(10**6 + i, docs[0][1]) for i in range(30)] + [(5, None), (6, ""), (7, "..."), (None, docs[1][1]), (None, docs[1][1])]
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 12, 40])))) for i in range(25)]
    return docs, [*items, (3, items[3][1]), (None, items[4][1]), (90, None), (91, ""), (92, "unknown!"), (93, "W1 w1, w2")]


@pytest.mark.parametrize("seed,segment,block,wave,share", [(1, 1 << 20, 64, 2048, 4), (2, 2000, 4, 8, 4), (3, 8000, 8, 16, 1), (4, 8000, 8, 64, 10**6)])
def test_against_brute_force(spark, monkeypatch, seed, segment, block, wave, share):
    docs, items = random_case(seed)
    monkeypatch.setattr(ls, "BLOCK", block)
    monkeypatch.setattr(ls, "WAVE", wave)
    monkeypatch.setattr(ls, "SHORT_SHARE", share)
    monkeypatch.setattr(ls, "text_slices", lambda batches: (b.slice(i, 40) for b in batches for i in range(0, b.num_rows, 40)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert got(ls.search(frame, asked, segment_bytes=segment)) == brute(docs, items)


def test_search_skips_and_agrees_without_spark():
    """One segment, searched directly, equals a full scan for every k."""
    docs, items = random_case(9)
    docs = sorted(((d, t) for d, t in docs if d is not None), key=lambda r: r[0])
    numbers, queries = ls.vocabulary([t for _, t in items])
    import numpy as np
    keys, tf, lengths = ls._count_terms([t for _, t in docs], numbers, 0)
    doc, term = keys // len(numbers), keys % len(numbers)
    order = np.lexsort((doc, term))
    terms, held = np.unique(term, return_counts=True)
    n_docs, n_words = int((lengths > 0).sum()), int(lengths.sum())
    df = np.zeros(len(numbers), np.int64)
    df[terms] = held
    row = {"docs": np.array([d for d, _ in docs]), "lengths": lengths, "terms": terms, "held": held, "at": doc[order], "tf": tf[order]}
    segment = ls.Segment(row, n_docs, n_words)
    for k in (1, 10, 10**4):
        want = brute(docs, [(i, t) for i, (_, t) in enumerate(items)], k)
        found = []
        for i, q in enumerate(queries):
            at, score = segment.search(q, ls.weights(n_docs, df), k)
            found += [(i, r, docs[a][0], s) for r, (a, s) in enumerate(zip(at.tolist(), score.tolist()), 1)]
        assert sorted(found, key=repr) == want


def test_fixture_groups_and_clashing_columns(spark, docs, rows, items):
    extra = [*items, (20, "mit license word"), (21, "two words again")]
    asked = spark.createDataFrame([(i, t, 1, "x") for i, t in extra], "item_id long, text string, rank int, doc_id string")
    want = brute(rows, extra)
    assert got(ls.digest(docs, asked)) == want and want
    assert got(ls.search(docs, asked, group_bytes=200)) == want          # several groups of queries


def test_empty_tables(spark, docs, no_docs, items):
    asked = spark.createDataFrame(items, "item_id long, text string")
    for d, q in ((no_docs, asked), (docs, asked.limit(0)), (no_docs, asked.limit(0))):
        assert got(ls.digest(d, q)) == []


def test_every_document_holds_the_term(spark):
    docs = [(i, "same same") for i in range(20)]
    items = [(1, "same")]
    assert got(ls.digest(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)
