"""Joins, searches, archives and the pipeline, against brute force."""

import base64
import hashlib
import io
import random
import zlib

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from changeflow.llm import jaccard_join, rp_forest, warc
from changeflow.llm.common import new_path
from changeflow.llm.components import components
from changeflow.llm.queries import ORACLE, QUERIES


# --- op10

@pytest.mark.parametrize("which", ["docs", "sample"])
def test_jaccard_join(which, docs, rows, sample):
    df, texts = (docs, rows) if which == "docs" else sample
    got = jaccard_join.join(df)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == sorted(brute.link_components(texts), key=repr)


def hard_rows():
    """Groups beyond the light bound that share heavy shingles: near copies
    of one text, texts that are mostly one passage, and pairs at the bound."""
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(10 ** 6)}"
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(60)]
    out = []
    for i in range(90):
        w = list(base)
        w[rng.randrange(120)] = word()
        out.append(w)
    out += [passage + [word() for _ in range(rng.randrange(4, 40))] for _ in range(90)]
    out += [[word() for _ in range(rng.randrange(4, 40))] + passage for _ in range(90)]
    for i in range(60):                       # similarities from about 0.75 to 0.95
        w = [word() for _ in range(100)]
        out += [w, w[i % 16:] + [word() for _ in range(i % 3)]]
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("light", [64, 4])
def test_jaccard_join_of_heavy_groups(spark, monkeypatch, light):
    monkeypatch.setattr(jaccard_join, "LIGHT", light)
    monkeypatch.setattr(jaccard_join, "HUB_TEXTS", 7)
    texts = hard_rows()
    expected = brute.link_components(texts)
    assert 0 < len({c for *_, c in expected}) < len(expected)
    got = jaccard_join.join(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(expected)


@pytest.mark.parametrize("turns,candidates", [(0, 1), (1, 1), (4, 1), (4, 3)])
def test_jaccard_hub_steps_lose_no_link(spark, monkeypatch, turns, candidates):
    """Near copies around the threshold, of several bases: hub steps, however
    many, and the last join give the components of all links."""
    monkeypatch.setattr(jaccard_join, "LIGHT", 2)
    monkeypatch.setattr(jaccard_join, "TURNS", turns)
    monkeypatch.setattr(jaccard_join, "CANDIDATES", candidates)
    monkeypatch.setattr(jaccard_join, "LINEAR", -1)
    monkeypatch.setattr(jaccard_join, "WORTH", 10**6)
    rng = random.Random(11)
    docs = []
    for base in range(3):
        words = [f"b{base}w{i}" for i in range(120)]
        for _ in range(45):
            own = words[rng.randrange(0, 14):120 - rng.randrange(0, 14)]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(df).collect())
    want = sorted(brute.link_components(docs))
    assert got == want and 3 < len({c for *_, c in want}) < len(docs) - 30


def test_jaccard_shuffles_only_what_may_match(spark, monkeypatch):
    """Texts meet the filter by bits before they are shuffled, and shingles are
    taken from their arrays after these met the components."""
    plans = {}
    for name in ("stored", "stored_by"):
        def seen(df, label, *args, write=getattr(jaccard_join, name), **kept):
            plans[label, "text" in df.columns] = df._jdf.queryExecution().optimizedPlan().toString()
            return write(df, label, *args, **kept)
        monkeypatch.setattr(jaccard_join, name, seen)
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(base[:i] + ["other"] + base[i:])) for i in range(6)]
    assert {r.component_id for r in jaccard_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == {0}
    texts, several = plans["node", True], plans["several", False]
    assert "LeftSemi" not in texts and texts.index("Join Inner, (node") < texts.index("strategy=broadcast")
    assert several.index("Generate explode") < several.index("Join LeftOuter")


def test_jaccard_first_round_is_shuffled_in_parts(spark, monkeypatch):
    """No write of the first round holds over half of the shared tokens, nor of
    their rows; the parts together find what one finds."""
    base = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(base[:9 * i] + ["other"] + base[9 * i:])) for i in range(8)] + [(99, "on its own"), (7, None)]
    known = jaccard_join.profiles(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85).cache()
    rows = []

    def seen(df, label, *args, write=jaccard_join.stored, **kept):
        out = write(df, label, *args, **kept)
        rows.append((label, out.count()))
        return out
    monkeypatch.setattr(jaccard_join, "stored", seen)

    def alive():
        return sorted((r.node, r.n, r.score, sorted(r.tokens)) for r in jaccard_join._alive(known, 85).collect())
    in_parts = alive()
    tokens, most = len({t for *_, ts in in_parts for t in ts}), sum(len(ts) for *_, ts in in_parts) / 2
    assert len(in_parts) == 8 and rows and all(0 < n < (tokens / 2 if label == "counts" else most) for label, n in rows)
    monkeypatch.setattr(jaccard_join, "PASSES", 1)
    assert alive() == in_parts


def test_jaccard_keep_one(docs, rows, no_docs):
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    expected = brute.link_components(rows)
    assert sorted({r.doc_id for r in kept.collect()}, key=repr) == sorted({c for *_, c in expected}, key=repr)
    assert jaccard_join.join(no_docs).count() == 0


def test_jaccard_keep_one_keeps_a_row_of_each_component(spark):
    rng = random.Random(4)
    prose = lambda: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(60))
    lone, shared, copied = [prose() for _ in range(20)], [prose() for _ in range(3)], prose()
    alone = prose()
    rows = [(None, t, "a") for t in lone]                       # null ids, nothing links
    rows += [(7, t, "a") for t in shared]                       # one id, nothing links
    rows += [(9, alone, s) for s in ("c", "b", "b", "d")]       # id and text repeated
    rows += [(None, copied, "a"), (12, copied, "a"), (11, copied + " more", "a"), (11, copied + " more", "a"), (None, copied, "a")]
    rows += [(None, None, "a"), (20, None, "a"), (21, "", "a")]
    expected = [*((None, t) for t in lone), *((7, t) for t in shared), (9, alone), (11, copied + " more"),
                (None, None), (20, None), (21, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for width, percent in ((4, 85), (5, 80)):
        got = jaccard_join.keep_one(df, width, percent).collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(expected, key=repr)
    assert {r.source for r in got if r.doc_id == 9} <= {"b", "c", "d"}
    assert jaccard_join.keep_one(df.select("doc_id", "text")).count() == len(expected)
    assert sorted(map(tuple, jaccard_join.keep_one(df.repartition(2)).collect()), key=repr) == sorted(
        map(tuple, jaccard_join.keep_one(df.repartition(7)).collect()), key=repr)


def copies_below_op10():
    """Texts and copies of similarity 0.80 to 0.85: cut, appended, edited, and
    a group of copies of one text."""
    rng = random.Random(8)
    prose = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    out = []
    for i in range(12):
        w = prose(200)
        edited = [f"edit{k}" if k % 47 == 23 else x for k, x in enumerate(w)]
        out += [w, (w[:166], w + prose(40), edited)[i % 3]]
    group = prose(300)
    out += [group, *(group[:249 - i] + prose(2) for i in range(4))]
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_near_duplicate_stage_takes_five_words_and_four_fifths(spark):
    texts = copies_below_op10()
    expected = {c for *_, c in brute.link_components(texts, 5, 80)}
    assert len(expected) == 13 < len({c for *_, c in brute.link_components(texts)})
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    got = stage(spark, spark.createDataFrame(texts, "doc_id long, text string"), None)
    assert sorted(r.doc_id for r in got.collect()) == sorted(expected)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 7), (-5, 9), (9, -5)] + [(1000, 1000 + i) for i in range(200)]
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def top(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v
    for a, b in edges:
        if a != b:
            lo, hi = sorted((top(a), top(b)))
            parent[hi] = lo
    assert got == {v: top(v) for v in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- op6

def vectors(spark, n=1500, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) * rng.uniform(0.5, 2, (n, 1))
    x[200:500] = x[200]                                       # one vector, 300 times
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5020, []), (5040, [0.0] * dim), (5060, [float("nan")] * dim), (5080, [None] * dim),
           (5100, [float("inf")] * dim), (5120, [1.0] * (dim + 1)), (None, [1.0] * dim)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"), x


def nearest(x, q, k):
    scores = np.add.reduce(x * x[q], axis=1)
    order = [int(i) for i in np.lexsort((np.arange(len(x)), -scores)) if i != q]
    return order[:k], scores


def test_forest_search(spark):
    df, x = vectors(spark)
    got = rp_forest.search(df, F.col("vec_id") % 20 == 0, k=10).collect()
    queries = [i for i in range(0, len(x), 20)]
    by = {q: sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q) for q in queries}
    assert len(got) == 10 * len(queries)
    found = 0
    for q in queries:
        truth, scores = nearest(x, q, 10)
        assert [r for r, *_ in by[q]] == list(range(1, 11))
        assert all(abs(s - scores[v]) < 1e-12 and v != q for _, v, s in by[q])
        assert by[q] == sorted(by[q], key=lambda r: (-r[2], r[1]))
        found += len({v for _, v, _ in by[q]} & set(truth))
    assert found >= 0.9 * 10 * len(queries)
    assert [v for _, v, _ in by[200]] == nearest(x, 200, 10)[0]      # copies: ties to the smaller id


def test_forest_depth_follows_the_rows():
    assert [rp_forest.tree_depth(min(n, 20_000), n) for n in (0, 1, 63, 500, 2000, 20_000, 51_282, 100_000, 300_000, 10**9)] == [0, 0, 0, 3, 5, 6, 6, 7, 9, 9]


def test_forest_of_deep_trees_with_a_hot_vector(spark, monkeypatch):
    """A third of the rows on one vector, leaves of several blocks: recall
    against brute force, every query complete."""
    monkeypatch.setattr(rp_forest, "LEAF_ROWS", 16)
    monkeypatch.setattr(rp_forest, "LEAF_SAMPLE", 8)
    monkeypatch.setattr(rp_forest, "BLOCK_ROWS", 100)
    monkeypatch.setattr(rp_forest, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 12))
    x[600:] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    assert rp_forest.tree_depth(900, 900) > rp_forest.LEAST_DEPTH - 1
    got = {}
    for r in rp_forest.search(df, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, 900, 20):
        assert sorted(r for r, *_ in got[q]) == list(range(1, 21))
        scores = np.add.reduce(x * x[q], axis=1)
        scores[q] = -np.inf
        least = np.sort(scores)[-20]
        hits += sum(s >= least - 1e-9 for _, _, s in got[q])
    assert hits >= 0.9 * 20 * 45


def test_forest_blocks_change_nothing(spark, monkeypatch):
    df, _ = vectors(spark, n=600)
    want = sorted(map(tuple, rp_forest.search(df, F.col("vec_id") % 20 == 0, k=5).collect()))
    monkeypatch.setattr(rp_forest, "BLOCK_ROWS", 16)
    monkeypatch.setattr(rp_forest, "BLOCK_QUERIES", 3)
    assert sorted(map(tuple, rp_forest.search(df, F.col("vec_id") % 20 == 0, k=5).collect())) == want


def test_forest_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in rp_forest.search(df, F.col("vec_id") == 0, k=20).collect()] == [(0, 1, 1, 0.5)]
    assert rp_forest.search(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert rp_forest.search(df, F.col("vec_id") == 77).count() == 0


# --- op3

PAGES = [(1, "http://a/b c\r\nx", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "hé\r\n\r\nWARC/1.1"),
         (None, "http://f", "<p>one</p>"), (None, "http://g", "alone"), (1, "http://a", "<p>one</p>"), (9, "http://i", "x" * 300_000)]


def page_brute(pages, least=0):
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        own = first.get(html or "")
        revisit = len(data) >= least and own is not None and own != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", own if revisit else None))
    return out


@pytest.mark.parametrize("least, size", [(0, 1 << 30), (5, 400)])
def test_warc(spark, least, size):
    folder = new_path(spark, "warc")
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.normalise(warc.write_archives(df, folder, least, size), folder)
    got = warc.read_archives(spark, folder).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(page_brute(PAGES, least), key=repr)
    assert all("\n" not in r.url for r in got)
    assert sorted(bytes(r.payload) for r in got if r.page_id in (5, 9)) == sorted((p[2] or "").encode() for p in PAGES if p[0] in (5, 9))


def test_warc_members_stand_alone(spark):
    folder = new_path(spark, "warc")
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    warc.normalise(warc.write_archives(df, folder), folder)
    from changeflow.llm.common import filesystem
    fs, path = filesystem(folder)
    n = 0
    for r in spark.read.parquet(f"{folder}/manifest").collect():
        with fs.open_input_file(f"{path}/members/{r.file}.warc.gz") as f:
            data = f.read()
        with fs.open_input_file(f"{path}/members/{r.file}.idx") as f:
            lines = f.read().decode().splitlines()
        assert b"".join(warc.inflate(io.BytesIO(data), 100)) == b"".join(
            zlib.decompress(data[int(a):int(a) + int(k)], 31) for _, _, a, k in (x.split("\t") for x in lines))
        n += len(lines)
    assert n == len(PAGES)


def test_warc_damage_and_no_pages(spark):
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records(iter([warc.record(1, "http://a", b"abc", None)[:-3]])))
    folder = new_path(spark, "warc")
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.normalise(warc.write_archives(none, folder), folder)
    assert warc.read_archives(spark, folder).count() == 0


# --- registry and pipeline

def test_queries_are_registered():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert set(QUERIES) | {"pipeline"} <= names and set(ORACLE) <= set(QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, sample):
    df, texts = sample
    lang = {r.doc_id: r.lang for r in df.collect()}
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()
    left = [(d, t) for d, t in texts if any(c.isalpha() for c in t or "")]
    one = {c for *_, c in brute.link_components(left, 5, 80)}      # the stage's own parameters
    left = [(d, t) for d, t in left if d in one]
    left = [(d, k if n else dict(left)[d]) for d, _, n, k in brute.repeated_words(left)]
    leaks = brute.contamination(left, [(r.item_id, r.text) for r in bench])
    left = [x for x, (_, _, hit, _) in zip(left, leaks) if not hit]
    tok = brute.tokenizer()
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.lang, r.ids, r.n_tokens, r.decoded_sha256) for r in got) == sorted(
        (d, lang[d], x := tok.encode_ordinary(t or ""), len(x), brute.sha(t or "")) for d, t in left)


def test_stages_keep_the_columns(spark, sample):
    docs = sample[0]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").columns == docs.columns
