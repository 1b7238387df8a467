"""Detectors on handmade pairs (combining marks, swaps, falsy values), the
pre-load gate, reconciliation edge cases."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from changeflow.functions.diacritics import strip_diacritics
from changeflow.operators import patterns as pt
from changeflow.operators import reconcile as rc


def _hits(spark, a, b, kind):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    ta = pt.detector_text(F.col("a"), df.schema["a"].dataType)
    tb = pt.detector_text(F.col("b"), df.schema["b"].dataType)
    hit, fix = pt.detect(pt.Detector(kind, kind), ta, tb)
    r = df.select(hit.alias("h"), fix.alias("f")).first()
    return r["h"], r["f"]


def test_detectors(spark):
    assert _hits(spark, "Jose", "José", pt.DIACRITICS)[0]
    assert _hits(spark, "Jose", "José", pt.DIACRITICS)[0]           # combining mark
    assert not _hits(spark, "Jose", "Jose", pt.DIACRITICS)[0]
    assert _hits(spark, "ann lee", "ANN LEE", pt.CASE) == (True, "Case mismatch: 'ann lee' vs 'ANN LEE'")
    assert _hits(spark, " a  b", "a b", pt.WHITESPACE)[0]
    assert _hits(spark, "new york city", "Smith", pt.SWAP)[0]
    assert not _hits(spark, "york", "Smith", pt.SWAP)[0]                  # both single words
    assert not _hits(spark, None, "X", pt.CASE)[0]                        # falsy -> no match
    assert not _hits(spark, "", "", pt.WHITESPACE)[0]


def test_diacritic_table_matches_nfd_for_latin(spark):
    text = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿŁłŚśŹźŻżĆćĘęĄąŃńŐőŰű"
    expect = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(strip_diacritics("t").alias("s"), strip_diacritics("t", exact=True).alias("e")).first()
    assert got["e"] == expect
    # Ł / ł have no canonical decomposition: both forms keep them
    assert got["s"] == expect


def test_custom_replacements_first(spark):
    df = spark.createDataFrame([("straße",)], "t string")
    assert df.select(strip_diacritics("t", {"ß": "ss"}).alias("s")).first()["s"] == "strasse"


def test_analysis_and_gate(spark):
    a = spark.createDataFrame([(1, "Ann"), (2, "Bob"), (None, "Nul")], "k long, name string")
    b = spark.createDataFrame([(1, "ANN"), (2, "Bob"), (None, "Nul"), (3, "x")], "k long, name string")
    res = pt.analyze_sources([("a", a), ("b", b)], {"name": {"a": "name", "b": "name"}}, ["k"])
    rows = {r["row_id"]: r for r in res.collect()}
    assert set(rows) == {"{'k': 1}", "{'k': 2}", "{'k': None}"}            # null key matches null key
    assert rows["{'k': 1}"]["mismatches"][0]["detected_patterns"] == ["case_normalization"]
    st = pt.match_statistics(res).first()
    assert (st["matched_records"], st["unmatched_records"], st["total_records"]) == (2, 1, 3)
    with pytest.raises(ValueError, match="pre-load"):
        pt.preload_gate(res, 90.0)
    pt.preload_gate(res, 50.0)


def test_registered_gate_decides(spark):
    from changeflow.catalog import patterns_q as q
    sf = "/root/testdata/sf0.001"
    assert {r["analysis"]: r["passed"] for r in q.q15(spark, sf).collect()} == {"all": False, "balance": True}
    with pytest.raises(ValueError, match="pre-load"):
        pt.preload_gate(q._analysis(spark, sf), q.GATE_BOUND)
    passed = pt.preload_gate(q._analysis(spark, sf, {"balance": q.COLUMNS["balance"]}), q.GATE_BOUND)
    assert passed.columns == pt.match_statistics(q._analysis(spark, sf)).columns


def test_wide_and_long_form_agree(spark):
    from changeflow.catalog import patterns_q as q
    sf = "/root/testdata/sf0.001"
    wide = pt.mismatch_entries(q._analysis(spark, sf))
    long = q._mismatches(spark, sf).select(*wide.columns)
    text = [F.to_json(F.struct(*wide.columns)).alias("row")]
    rows = [sorted(r["row"] for r in df.select(*text).collect()) for df in (wide, long)]
    assert rows[0] == rows[1] and rows[0]


def test_export_plans_quickly(spark):
    """The plan of the export does not grow with the constraints inferred on it."""
    import time
    from changeflow.catalog import patterns_q as q
    df = q.s13(spark, "/root/testdata/sf0.001")
    began = time.time()
    df._jdf.queryExecution().optimizedPlan()
    assert time.time() - began < 5


@pytest.mark.parametrize("hot_rows", [3, 10, 2_000_000])
def test_n_way_match_deals_hot_keys(spark, hot_rows):
    a = spark.createDataFrame([(k, i) for i in range(30) for k in (1, None)] + [(2, 1), (3, 1)], "k long, v long").repartition(4)
    b = spark.createDataFrame([(1, "one"), (1, "uno"), (None, "none"), (2, "two")], "k long, w string")
    got = sorted((repr(tuple(r)) for r in pt.n_way_match([("a", a), ("b", b), ("c", b)], ["k"], hot_rows=hot_rows).collect()))
    names = {1: "one", None: "none", 2: "two"}
    want = sorted(repr((k, v, k, names[k], k, names[k])) for k, v in [(k, i) for i in range(30) for k in (1, None)] + [(2, 1)])
    assert got == want


def test_record_lookup_partial_null_keys(spark):
    target = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "x long, y long, v string")
    sample = spark.createDataFrame([(1, None), (None, None), (2, 1)], "x long, y long")
    out = {(r["x"], r["y"]): r["dst_v"] for r in rc.record_lookup(sample, target, ["x", "y"], ["v"]).collect()}
    assert out == {(1, None): "a", (None, None): None, (2, 1): "c"}


def test_record_lookup_by_masked_keys(spark):
    """Every combination of three key parts against a plain search, with one
    scan of the target."""
    import random
    rng = random.Random(2)
    part = lambda: rng.choice([None, 1, 2, 3])      # noqa: E731
    rows = [(part(), part(), part(), i) for i in range(60)]
    probes = [(part(), part(), part()) for _ in range(80)]
    schema = "x long, y long, z long"
    found = rc.record_lookup(spark.createDataFrame(probes, schema), spark.createDataFrame(rows, schema + ", v long"), ["x", "y", "z"], ["v"])

    def first(probe):
        if probe == (None,) * 3:
            return None
        return min((r[3] for r in rows if all(p is None or p == v for p, v in zip(probe, r))), default=None)
    assert found.columns == ["x", "y", "z", "dst_x", "dst_y", "dst_z", "dst_v"]
    assert sorted(repr((r.x, r.y, r.z, r.dst_v)) for r in found.collect()) == sorted(repr((*p, first(p))) for p in probes)
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").select("c_custkey", "c_nationkey", "c_name")
    probe = customers.limit(5).select("c_custkey", F.expr("if(c_custkey % 2 = 0, c_nationkey, null)").alias("c_nationkey"))
    plan = rc.record_lookup(probe, customers, ["c_custkey", "c_nationkey"], ["c_name"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("c_name") and plan.count("Aggregate [_mask") == 1


def test_verification_deals_a_hot_source_key(spark):
    s = spark.createDataFrame([(1, f"v{i % 3}") for i in range(40)] + [(2, "a"), (3, "b"), (None, "n")], "k long, v string").repartition(4)
    d = spark.createDataFrame([(1, "v1"), (2, "a"), (4, "c"), (1, "zz"), (None, "m")], "k long, v string")
    rows = [sorted(map(repr, rc.verify_rows(s, d, ["k"], hot_rows=n).collect())) for n in (5, 10**6)]
    assert rows[0] == rows[1] and len(rows[0]) == 45
    assert rc.verify_rows(s, d, ["k"], hot_rows=5).filter("k = 1 AND status = 'different'").count() == 27


def test_missing_counts_null_keys(spark):
    s = spark.createDataFrame([(1,), (None,), (3,), (3,)], "k long")
    d = spark.createDataFrame([(1,), (None,)], "k long")
    r = rc.missing_both_ways(s, d, ["k"]).first()
    assert (r["missing_in_destination"], r["missing_in_source"]) == (3, 1)


def test_row_count_flag_null_when_off(spark):
    df = spark.createDataFrame([(1,)], "k long")
    assert rc.row_count_compare(df, df, check=False).first()["counts_match"] is None
