"""Exact dedup against brute force, over batches, sessions and replays."""

from collections import defaultdict

import pytest
from brute import A_TO_Z, sha
from pyspark.sql import functions as F

from changeflow.llm import exact_dedup
from changeflow.llm.common import new_path

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def brute(batches):
    """Decisions of the last of several batches of (doc_id, text)."""
    keep, size, out = {}, defaultdict(int), []
    for rows in batches:
        groups = defaultdict(list)
        for doc_id, text in rows:
            groups[(text or "").translate(A_TO_Z)].append(doc_id)
        out = []
        for text, ids in groups.items():
            fresh = text not in keep
            if fresh:
                keep[text] = max((i for i in ids if i is not None), default=None)
            size[text] += len(ids)
            left = fresh
            for i in ids:
                mine = left and i == keep[text]
                left = left and not mine
                out.append((i, keep[text], size[text], mine, sha(text)))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


ODD = [(1, "Ä a"), (2, "ä a"), (3, "Ä A"), (4, None), (5, ""), (None, "Ä A"), (None, "only null"), (None, "ONLY null"),
       (6, "İ"), (7, "i̇"), (8, "K"), (9, "k"), (10, "x" * 40_000), (11, "X" * 40_000), (9, "k"), (9, "k"), (-3, "k")]


@pytest.mark.parametrize("share", [4096, 3])
def test_against_brute_force(spark, docs, rows, monkeypatch, share):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", share)
    assert got(exact_dedup.digest(docs)) == brute([rows])
    odd = spark.createDataFrame(ODD, "doc_id long, text string").repartition(5)
    assert got(exact_dedup.digest(odd)) == brute([ODD])


def test_empty_and_clashing(spark, no_docs):
    assert got(exact_dedup.digest(no_docs)) == []
    clash = spark.createDataFrame([(1, "a", "x", True, 9), (2, "A", "y", False, 8)], "doc_id long, text string, digest string, kept boolean, n int")
    assert got(exact_dedup.digest(clash)) == brute([[(1, "a"), (2, "A")]])
    index = exact_dedup.new_index(spark, 2)
    index.add(clash)
    assert [tuple(r) for r in index.kept_rows(clash).collect()] == [(2, "A", "y", False, 8)]


def test_batches_replay_reopen_and_compact(spark, rows):
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    parts = [rows[::3], [*rows[1::3], *rows[:6], *rows[:6]], [*ODD, *rows]]
    index = exact_dedup.new_index(spark, 100)
    for i, part in enumerate(parts):
        index.add(frame(part), i)
        assert got(index.decide(frame(part), i)) == brute(parts[:i + 1])
    index.add(frame(parts[2]), 2)                     # a batch that is run again changes nothing
    assert got(index.decide(frame(parts[2]), 2)) == brute(parts)
    spark.sql(f"DROP TABLE {index.name}")             # as another session finds it
    again = exact_dedup.DigestIndex(index.path, index.name + "_again", index.buckets).open(spark)
    assert got(again.decide(frame(parts[2]), 2)) == brute(parts)
    one = again.compact(spark, exact_dedup.DigestIndex(new_path(spark, "compact"), index.name + "_one", 4))
    assert one.entries(spark).select("batch").distinct().collect()[0][0] == -1
    one.add(frame(parts[0]), 3)
    assert got(one.decide(frame(parts[0]), 3)) == brute([*parts, parts[0]])


def test_repeated_rows_keep_one(spark, docs, rows):
    index = exact_dedup.new_index(spark, 100)
    index.add(docs)
    kept = index.kept_rows(docs)
    assert kept.columns == docs.columns
    want = sorted((i, s) for i, _, _, k, s in brute([rows]) if k)
    assert sorted((r.doc_id, sha((r.text or "").translate(A_TO_Z))) for r in kept.collect()) == want


def test_index_is_not_shuffled_and_plan_is_native(spark, docs):
    index = exact_dedup.new_index(spark, 100)
    index.add(docs)
    seen = index.entries(spark, 1).filter("first").select("digest").hint("merge")
    new = docs.select(exact_dedup.text_digest(F.col("text")).alias("digest")).distinct().repartition(index.buckets, "digest")
    plan = new.join(seen, "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    side = plan[plan.index("FileScan parquet spark_catalog"):] if "spark_catalog" in plan else plan
    assert "Bucketed: true" in side
    text = index.decide(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
