"""Mapping compiler, load modes, merges: argument checks and semantics that
the shared tables do not exercise (null keys, duplicate keys, generated
values, out-of-scope aliases)."""

import pytest
from pyspark.sql import functions as F

from changeflow.functions.columns import concat_keep_nulls, fill_template
from changeflow.operators import load as ld
from changeflow.operators import merge as mg
from changeflow.operators.mapping import ColumnMap, TableMap, apply_mapping, strip_change_metadata


def test_mapping_validation():
    with pytest.raises(ValueError):
        ColumnMap("x", "a", ignore_changes=True, on_insert="uuid()")
    with pytest.raises(ValueError):
        ColumnMap("x", kind="bogus")
    with pytest.raises(ValueError):
        TableMap((ColumnMap("a", "a"), ColumnMap("A", "b")))
    with pytest.raises(ValueError):
        TableMap((ColumnMap("a", "a"),), keys=("b",))
    with pytest.raises(ValueError):
        fill_template("{col3}", ["a", "b"])


def test_concat_keeps_separator_for_null(spark):
    df = spark.createDataFrame([("a", None, "c")], "x string, y string, z string")
    assert df.select(concat_keep_nulls(["x", "y", "z"]).alias("s")).first()["s"] == "a, , c"


def test_generated_on_insert_only(spark):
    """Uuid generated for new rows only; updates keep the stored value."""
    target = spark.createDataFrame([(1, "old", "fixed-id")], "k long, v string, gid string")
    source = spark.createDataFrame([(1, "new"), (2, "ins")], "k long, v string")
    out = {r["k"]: r for r in ld.upsert(target, source, ["k"], order=["v"], insert_only=["gid"],
                                        generated={"gid": "uuid()"}).collect()}
    assert out[1]["v"] == "new" and out[1]["gid"] == "fixed-id"
    assert out[2]["gid"] is not None and len(out[2]["gid"]) == 36


def test_upsert_duplicates_last_wins_and_null_keys(spark):
    target = spark.createDataFrame([(1, "a", 0), (None, "n", 0)], "k long, v string, o int")
    source = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (None, "x", 3), (None, "y", 4)],
                                   "k long, v string, o int")
    acts = ld.upsert_actions(target, source, ["k"], order=["o"])
    rows = sorted((r["k"], r["v"], r["_action"]) for r in acts.collect() if r["k"] is not None)
    assert rows == [(1, "c", "update")]
    assert acts.filter(F.col("k").isNull()).count() == 3     # 1 kept + 2 inserted
    c = ld.upsert_counts(acts).first()
    assert (c["inserted"], c["updated"]) == (2, 1)


def test_load_mode_checks(spark):
    df = spark.createDataFrame([(1,)], "k long")
    with pytest.raises(ValueError):
        ld.load(df, df, "merge")
    with pytest.raises(ValueError):
        ld.upsert(df, df, [])
    with pytest.raises(ValueError, match="order"):
        ld.upsert(df, df, ["k"])


def test_strip_metadata(spark):
    df = spark.createDataFrame([(1, 2, 3, "s")], "`__$start_lsn` long, `__$operation` int, k long, _source_id string")
    assert strip_change_metadata(df).columns == ["k", "_source_id"]
    assert strip_change_metadata(df, True).columns == ["k"]


def _spec(spark, steps, output):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string")
    b = spark.createDataFrame([(1, 10.0)], "cid long, amount double")
    return mg.MergeSpec((mg.Source("a", a, key="id"), mg.Source("b", b)), steps, output)


def test_merge_checks(spark):
    with pytest.raises(ValueError):
        mg.Step("left", "b")                       # join without condition
    with pytest.raises(ValueError):
        mg.MergeSpec((mg.Source("a", None),), ())  # one source
    spec = _spec(spark, (mg.Step("union_all", "b"),), (("a.name", "n"),))
    with pytest.raises(ValueError, match="out of scope"):
        mg.run_merge(spark, spec)


def test_join_key_extraction(spark):
    spec = _spec(spark, (mg.Step("left", "b", "a.id = b.cid AND b.amount > 0"),), ())
    assert mg.join_key_of(spec, "a") == "id"
    assert mg.join_key_of(spec, "b") == "cid"


def test_remerge_removes_vanished_keys(spark):
    spec = _spec(spark, (mg.Step("inner", "b", "a.id = b.cid"),),
                 (("a.id", "id"), ("a.name", "name"), ("b.amount", "amount")))
    dest = spark.createDataFrame([(1, "old", 1.0), (2, "gone", 2.0), (3, "keep", 3.0)],
                                 "id long, name string, amount double")
    changed = spark.createDataFrame([(1,), (2,)], "id long")
    out = sorted(tuple(r) for r in mg.remerge_affected(spark, spec, changed, "id", dest, "id",
                                                       aliases=["a"]).collect())
    assert out == [(1, "x", 10.0), (3, "keep", 3.0)]


def test_apply_mapping_kinds(spark):
    df = spark.createDataFrame([(1, "Ann", None, 2.5)], "id long, first string, last string, price double")
    m = TableMap((ColumnMap("id", "id"),
                  ColumnMap("info", kind="json", sources=("first", "last")),
                  ColumnMap("arr", kind="json_array", sources=("first", "last")),
                  ColumnMap("full", kind="concat", sources=("first", "last"), separator=" "),
                  ColumnMap("p2", kind="template", sources=("price",), expression="{col1} * 2"),
                  ColumnMap("last2", "last", default="'n/a'")), keys=("id",))
    r = apply_mapping(df, m).first()
    assert r["info"] == '{"first":"Ann","last":null}'
    assert r["arr"] == '["Ann",null]'
    assert r["full"] == "Ann " and r["p2"] == 5.0 and r["last2"] == "n/a"


def test_broadcast_bound(spark):
    from pyspark.sql.types import LongType, StringType, StructField, StructType
    from changeflow.operators.skew import broadcast_if_small, row_bytes
    assert row_bytes(StructType([StructField("a", LongType()), StructField("b", StringType())])) == 152
    df = spark.range(100).withColumnRenamed("id", "k")
    small = broadcast_if_small(df, max_rows=1000)
    assert "broadcast" in small._jdf.queryExecution().analyzed().toString().lower()
    big = broadcast_if_small(df, max_rows=10)
    assert "broadcast" not in big._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in broadcast_if_small(df, max_bytes=100)._jdf.queryExecution() \
        .analyzed().toString().lower()
