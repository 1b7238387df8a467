"""Checks for declarative node graphs."""

from __future__ import annotations

from changeflow.catalog import register
from changeflow.plans.graph import Edge, Node, run_graph
from changeflow.sources.fixtures import Tables

# filter -> dedupe -> JSON -> concat, the documented employee workflow shape,
# over orders
G1_SQL = """
SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate,
       json_object('o_orderkey', o_orderkey, 'o_orderstatus', o_orderstatus) AS order_json,
       concat(coalesce(o_orderpriority, ''), ' | ', coalesce(o_orderstatus, '')) AS label
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
      FROM orders WHERE o_totalprice > 50000) WHERE rn = 1
"""


def _graph():
    nodes = [Node("src", "source", {"table": "orders"}),
             Node("f", "filter", {"condition": "o_totalprice > 50000"}),
             Node("log", "logger"),
             Node("d", "dedupe", {"keys": ["o_custkey"], "order": ["o_orderdate", "o_orderkey"]}),
             Node("j", "json", {"columns": ["o_orderkey", "o_orderstatus"], "target": "order_json"}),
             Node("c", "concat", {"columns": ["o_orderpriority", "o_orderstatus"], "separator": " | ",
                                  "target": "label"}),
             Node("out", "sink")]
    edges = [Edge("src", "f"), Edge("f", "log"), Edge("log", "d"), Edge("d", "j"), Edge("j", "c"),
             Edge("c", "out")]
    return nodes, edges


@register("g1_declarative_graph", G1_SQL)
def g1(spark, sf_dir):
    t = Tables(spark, sf_dir)
    nodes, edges = _graph()
    res, _ = run_graph(spark, nodes, edges, {"orders": t.orders})
    return res["out"]


G1R_SQL = """
SELECT o_orderkey, 'review' AS lane FROM orders WHERE coalesce(o_totalprice >= 150000, false)
UNION ALL
SELECT o.o_orderkey, 'auto' AS lane FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE NOT coalesce(o.o_totalprice >= 150000, false)
"""


@register("g1_condition_join_graph", G1R_SQL)
def g1r(spark, sf_dir):
    """Conditional routing with both ports used, one branch enriched by a join."""
    t = Tables(spark, sf_dir)
    nodes = [Node("o", "source", {"table": "orders"}),
             Node("c", "source", {"table": "customer"}),
             Node("ck", "select", {"include": ["c_custkey"]}),
             Node("ren", "expression", {"target": "o_custkey", "expression": "c_custkey"}),
             Node("cond", "condition", {"condition": "o_totalprice >= 150000"}),
             Node("hi", "expression", {"target": "lane", "expression": "'review'"}),
             Node("lo", "join", {"mode": "merge", "key": "o_custkey"}),
             Node("lo2", "expression", {"target": "lane", "expression": "'auto'"}),
             Node("hi_out", "select", {"include": ["o_orderkey", "lane"]}),
             Node("lo_out", "select", {"include": ["o_orderkey", "lane"]}),
             Node("all", "join", {"mode": "union"})]
    edges = [Edge("c", "ck"), Edge("ck", "ren"), Edge("o", "cond"),
             Edge("cond", "hi", port="true"), Edge("cond", "lo", port="false", input="left"),
             Edge("ren", "lo", input="right"), Edge("lo", "lo2"),
             Edge("hi", "hi_out"), Edge("lo2", "lo_out"),
             Edge("hi_out", "all", input="left"), Edge("lo_out", "all", input="right")]
    res, _ = run_graph(spark, nodes, edges, {"orders": t.orders, "customer": t.customer})
    return res["all"]


G3_SQL = "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority LIKE '1%'"


@register("g3_row_logger", G3_SQL)
def g3(spark, sf_dir):
    """Rows pass through the logger unchanged; the logger observes the count."""
    t = Tables(spark, sf_dir)
    nodes = [Node("s", "source", {"table": "orders"}), Node("log", "logger"),
             Node("f", "filter", {"condition": "o_orderpriority LIKE '1%'"}),
             Node("p", "select", {"include": ["o_orderkey", "o_orderstatus"]})]
    edges = [Edge("s", "log"), Edge("log", "f"), Edge("f", "p")]
    res, _ = run_graph(spark, nodes, edges, {"orders": t.orders})
    return res["p"]
