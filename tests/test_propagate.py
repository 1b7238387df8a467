"""Change propagation: exact keys, key domains, outer joins, moves, set
operations, restarts."""

import pytest
from pyspark.sql import functions as F

from changeflow.catalog import propagate_q as q
from changeflow.operators import merge as mg
from changeflow.operators.merge import MergeSpec, Source, Step
from changeflow.operators.propagate import affected_keys, merge_keys, propagate
from changeflow.sources.fixtures import Tables

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_keys_of_another_domain_are_not_restricted(spark):
    """A declared key that is not the destination's says nothing about it."""
    customers = spark.createDataFrame([(1, "a", 20), (2, "b", 30)], "id long, name string, nation long")
    nations = spark.createDataFrame([(20, "X"), (30, "Y")], "nation_id long, label string")
    for how in ("left", "inner"):
        spec = MergeSpec((Source("c", customers, key="id"), Source("n", nations, key="nation_id")),
                         (Step(how, "n", "c.nation = n.nation_id"),),
                         (("c.id", "id"), ("c.name", "name"), ("n.label", "label")))
        old = spark.createDataFrame([(1, "old", "old"), (2, "b", "Y")], "id long, name string, label string")
        changed = spark.createDataFrame([(1,)], "id long")
        assert rows(mg.remerge_affected(spark, spec, changed, "id", old, "id")) == [(1, "a", "X"), (2, "b", "Y")]


def test_equal_keys_are_restricted_through_the_conditions():
    spec = MergeSpec((Source("a", None), Source("b", None), Source("c", None), Source("d", None)),
                     (Step("inner", "b", "a.k = b.k2 AND a.x = b.y"), Step("left", "c", "c.k3 = b.k2"),
                      Step("left", "d", "d.k = a.k OR d.z = 1")), (("a.k", "key"), ("a.x + 1", "more")))
    assert mg.key_equivalents(spec, "key") == {"a": "k", "b": "k2", "c": "k3"}
    assert mg.key_equivalents(spec, "more") == {}


def test_affected_keys_are_exact(spark):
    t = Tables(spark, SF)
    new, old = q.current(t), q.before(t)
    changed = {"reg": q.images(old["reg"], new["reg"])}
    got = {r[0] for r in affected_keys(q.chain_spec(**new), changed, "customer_id").collect()}
    want = {r[0] for r in new["crm"].join(new["nat"].filter("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey").collect()}
    assert got == want and 0 < len(want) < new["crm"].count()
    all_of = {a: q.images(old[a], new[a]) for a in new}
    keys = {r[0] for r in affected_keys(q.chain_spec(**new), all_of, "customer_id").collect()}
    differ = {r[0] for s in (old, new) for r in [*mg.run_merge(spark, q.chain_spec(**s)).exceptAll(
        mg.run_merge(spark, q.chain_spec(**(new if s is old else old)))).select("customer_id").collect()]}
    assert differ <= keys


def test_rows_of_other_keys_are_not_touched(spark):
    t = Tables(spark, SF)
    new, old = q.current(t), q.before(t)
    marked = mg.run_merge(spark, q.chain_spec(**{**new, "reg": old["reg"]})).withColumn("customer_name", F.lit("mark"))
    got = propagate(spark, q.chain_spec(**new), {"reg": q.images(old["reg"], new["reg"])}, marked, "customer_id")
    n = new["crm"].join(new["nat"].filter("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey")).count()
    assert got.filter("customer_name <> 'mark'").count() == n and got.count() == marked.count()


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_moves_deletes_and_null_keys(spark, how):
    """An order moves to another customer, one goes, one comes without a
    customer; a theta condition; a predicate on a source."""
    a = spark.createDataFrame([(1, 5), (2, 6), (3, 7), (None, 8)], "id long, v long")
    orders = "oid long, cid long, w long, kind string"
    old = spark.createDataFrame([(10, 1, 1, "x"), (11, 1, 9, "x"), (12, 3, 2, "x"), (13, 9, 1, "x"), (14, 2, 1, "skip")], orders)
    new = spark.createDataFrame([(10, 2, 1, "x"), (11, 1, 9, "x"), (13, 9, 2, "x"), (15, 3, 1, "x"), (16, None, 1, "x"), (14, 3, 1, "skip")], orders)

    def spec(df):
        return MergeSpec((Source("a", a), Source("o", df, where="kind <> 'skip'")), (Step(how, "o", "a.id = o.cid AND o.w < a.v"),),
                         (("a.id", "id"), ("o.oid", "oid"), ("o.w", "w")))
    got = propagate(spark, spec(new), {"o": q.images(old, new)}, mg.run_merge(spark, spec(old)), "id")
    want = mg.run_merge(spark, spec(new))
    assert rows(got) == rows(want)


def test_set_operations_and_refusals(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    b = spark.createDataFrame([(2, "b"), (3, "c")], "key long, w string")
    was = spark.createDataFrame([(2, "b"), (4, "d")], "key long, w string")
    for op in ("union_all", "union", "intersect", "except"):
        spec = lambda x: MergeSpec((Source("a", a), Source("b", x)), (Step(op, "b"),), (("id", "id"), ("v", "v")))      # noqa: E731
        got = propagate(spark, spec(b), {"b": q.images(was, b)}, mg.run_merge(spark, spec(was)), "id")
        assert rows(got) == rows(mg.run_merge(spark, spec(b)))
    mixed = MergeSpec((Source("a", a), Source("b", b), Source("c", a)), (Step("inner", "b", "a.id = b.key"), Step("union", "c")), (("a.id", "id"),))
    with pytest.raises(ValueError, match="union"):
        affected_keys(mixed, {"b": b}, "id")
    computed = MergeSpec((Source("a", a), Source("b", b)), (Step("inner", "b", "a.id = b.key"),), (("a.id + 1", "id"),))
    with pytest.raises(ValueError, match="not one source's column"):
        affected_keys(computed, {"b": b}, "id")


def test_merge_keys_of_null(spark):
    a = spark.createDataFrame([(1, 5), (None, 8)], "id long, v long")
    b = spark.createDataFrame([(5, "x"), (8, "y")], "v long, w string")
    spec = MergeSpec((Source("a", a), Source("b", b)), (Step("left", "b", "a.v = b.v"),), (("a.id", "id"), ("b.w", "w")))
    keys = spark.createDataFrame([(None,)], "id long")
    assert rows(merge_keys(spark, spec, keys, "id")) == [(None, "y")]
