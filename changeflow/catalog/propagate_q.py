"""Checks for change propagation through a chain of sources (C12 - C14):
customer -> nation -> region, with the customer's key as the destination's.

The old state of each source is derived from its table; a destination merged
from old states, with the changes propagated, must equal the merge of the
current tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from changeflow.catalog import register
from changeflow.catalog.merge_q import C14_SQL
from changeflow.operators import merge as mg
from changeflow.operators.merge import MergeSpec, Source, Step
from changeflow.operators.propagate import propagate
from changeflow.session import scratch_path
from changeflow.sources.fixtures import Tables, customer_dest
from changeflow.streaming import stream as st


def chain_spec(crm, nat, reg):
    return MergeSpec(
        sources=(Source("crm", crm, key="c_custkey"), Source("nat", nat, key="n_nationkey"), Source("reg", reg, key="r_regionkey")),
        steps=(Step("left", "nat", "crm.c_nationkey = nat.n_nationkey"), Step("left", "reg", "nat.n_regionkey = reg.r_regionkey")),
        output=(("crm.c_custkey", "customer_id"), ("crm.c_name", "customer_name"), ("nat.n_name", "nation_name"),
                ("reg.r_name", "region_name")))


def current(t):
    return {"crm": t.customer, "nat": t.nation, "reg": t.region}


def before(t):
    """The sources before the changes: a region had another name, some nations
    another region, some customers another nation; some customers did not
    exist and some that did are gone."""
    c, n, r = t.customer, t.nation, t.region
    moved = F.when(F.col("c_custkey") % 50 == 3, (F.col("c_nationkey") + 7) % 25).otherwise(F.col("c_nationkey"))
    gone = c.filter("c_custkey % 89 = 7").withColumn("c_custkey", F.col("c_custkey") + 20000000)
    return {
        "crm": c.filter("c_custkey % 97 <> 5").withColumn("c_nationkey", moved.cast(c.schema["c_nationkey"].dataType)).unionByName(gone),
        "nat": n.withColumn("n_regionkey", F.when(F.col("n_nationkey") % 5 == 2, (F.col("n_regionkey") + 1) % 5)
                            .otherwise(F.col("n_regionkey")).cast(n.schema["n_regionkey"].dataType)),
        "reg": r.withColumn("r_name", F.when(F.col("r_regionkey") == 1, F.lit("OLD NAME")).otherwise(F.col("r_name")))}


def images(old, new):
    """The rows that differ, as they were and as they are."""
    return old.subtract(new).unionByName(new.subtract(old))


CHAIN_SQL = """
SELECT c.c_custkey AS customer_id, c.c_name AS customer_name, n.n_name AS nation_name, r.r_name AS region_name
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
"""


@register("c14_delta_through_joins", CHAIN_SQL)
def c14_delta(spark, sf_dir):
    """A change in the last source of the chain alone."""
    t = Tables(spark, sf_dir)
    new = current(t)
    old_region = before(t)["reg"]
    destination = mg.run_merge(spark, chain_spec(new["crm"], new["nat"], old_region))
    return propagate(spark, chain_spec(**new), {"reg": images(old_region, new["reg"])}, destination, "customer_id")


@register("c14_deltas_of_all_sources", CHAIN_SQL)
def c14_deltas(spark, sf_dir):
    """Changes of all three sources in one batch."""
    t = Tables(spark, sf_dir)
    new, old = current(t), before(t)
    destination = mg.run_merge(spark, chain_spec(**old))
    return propagate(spark, chain_spec(**new), {a: images(old[a], new[a]) for a in new}, destination, "customer_id")


@register("c14_keys_of_two_domains", C14_SQL)
def c14_two_domains(spark, sf_dir):
    """Changed customers where the lookup declares a key of its own, in
    another domain."""
    t = Tables(spark, sf_dir)

    def spec(crm):
        return MergeSpec(sources=(Source("crm", crm, key="c_custkey"), Source("nat", t.nation, key="n_nationkey")),
                         steps=(Step("left", "nat", "crm.c_nationkey = nat.n_nationkey"),),
                         output=(("crm.c_custkey", "customer_id"), ("crm.c_name", "customer_name"), ("nat.n_name", "nation_name")))
    old = customer_dest(t.customer)
    changed = old.filter(F.col("c_mktsegment").isNull() | (F.col("c_custkey") >= 10000000)).select("c_custkey")
    return mg.remerge_affected(spark, spec(t.customer), changed, "c_custkey", mg.run_merge(spark, spec(old)), "customer_id")


@register("c12_stream_propagation", CHAIN_SQL)
def c12_propagation(spark, sf_dir):
    """Three source streams in one query; the sources change one after the
    other, from the last to the first, and the query resumes for each."""
    t = Tables(spark, sf_dir)
    root = scratch_path(spark, f"propagate-{uuid.uuid4().hex}")
    state, new = before(t), current(t)
    start = mg.run_merge(spark, chain_spec(**state))
    table = st.KeyReplaceTable(f"{root}/dest", start.schema, key="customer_id")
    table.init(spark, start)
    for a in new:
        new[a].limit(0).write.parquet(f"{root}/{a}")
    for changed in ("reg", "nat", "crm"):
        images(state[changed], new[changed]).write.mode("append").parquet(f"{root}/{changed}")
        state[changed] = new[changed]
        streams = {a: st.read_feed_stream(spark, f"{root}/{a}", new[a].schema) for a in new}
        st.start_propagation(streams, lambda: chain_spec(**state), table, f"{root}/checkpoint", compact_every=2).awaitTermination()
    return table.current(spark)
