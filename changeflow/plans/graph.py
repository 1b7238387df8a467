"""Declarative node graphs (G1) and the pass-through row logger.

A graph is nodes (id, type, config) and edges (source node and port ->
target node and input).  ``run_graph`` orders the nodes topologically and
folds them into DataFrames - each node is a function of its input
DataFrames, so the whole graph becomes one lazy plan that Catalyst optimises
end to end (filters of later nodes still reach the source scans).
"""

from __future__ import annotations

from collections import Counter, defaultdict, deque
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from changeflow.functions.columns import concat_keep_nulls, json_array, json_object
from changeflow.operators import transforms as tf
from changeflow.operators.merge import workflow_join
from changeflow.session import written

NODE_TYPES = ("source", "select", "filter", "dedupe", "json", "concat", "expression", "script",
              "condition", "fork", "join", "logger", "sink")


@dataclass(frozen=True)
class Node:
    id: str
    type: str
    config: Mapping = field(default_factory=dict)

    def __post_init__(self):
        if self.type not in NODE_TYPES:
            raise ValueError(f"node {self.id}: unknown type {self.type!r}")


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    port: str = "out"         # output port of the source (true / false / out1..out3)
    input: str = "in"         # input of the target (left / right for joins)


def topological_order(nodes: Sequence[Node], edges: Sequence[Edge]) -> list[Node]:
    """Kahn's order; raises when the graph has a cycle or dangling edges."""
    by_id = {n.id: n for n in nodes}
    if len(by_id) != len(nodes):
        raise ValueError("duplicate node id")
    indeg = {n.id: 0 for n in nodes}
    succ = defaultdict(list)
    for e in edges:
        if e.source not in by_id or e.target not in by_id:
            raise ValueError(f"edge {e.source}->{e.target} names an unknown node")
        indeg[e.target] += 1
        succ[e.source].append(e.target)
    ready = deque(n.id for n in nodes if indeg[n.id] == 0)
    order = []
    while ready:
        i = ready.popleft()
        order.append(by_id[i])
        for t in succ[i]:
            indeg[t] -= 1
            if indeg[t] == 0:
                ready.append(t)
    if len(order) != len(nodes):
        raise ValueError("the graph has a cycle; nodes cannot be ordered")
    return order


def _node(spark: SparkSession, n: Node, ins: Mapping[str, DataFrame],
          sources: Mapping[str, DataFrame], observations: dict) -> dict[str, DataFrame]:
    c = n.config
    df = ins.get("in")
    t = n.type
    if t == "source":
        out = sources[c["table"]]
        if c.get("where"):
            out = out.filter(F.expr(c["where"]))
        return {"out": out}
    if t == "select":
        return {"out": df.select(*c["include"]) if c.get("include") else df.drop(*c.get("exclude", []))}
    if t == "filter":
        return {"out": tf.predicate_filter(df, c["condition"])}
    if t == "dedupe":
        first = c.get("keep", "last") == "first"
        return {"out": tf.keep_latest(df, c["keys"], c["order"], first=first)}
    if t == "json":
        cols = c["columns"]
        col = json_array(cols) if c.get("structure") == "array" else json_object(cols)
        return {"out": df.withColumn(c["target"], col)}
    if t == "concat":
        return {"out": df.withColumn(c["target"], concat_keep_nulls(c["columns"], c.get("separator", ", ")))}
    if t == "expression":
        return {"out": df.withColumn(c["target"], F.expr(c["expression"]))}
    if t == "script":
        df.createOrReplaceTempView(c.get("input_view", "input"))
        return {"out": tf.run_script(spark, c["statements"], c.get("variables"))}
    if t == "condition":
        yes, no = tf.route(df, c["condition"])
        return {"true": yes, "false": no}
    if t == "fork":
        outs = tf.fork(df, int(c.get("outputs", 2)))
        return {f"out{i + 1}": o for i, o in enumerate(outs)} | {"out": outs[0]}
    if t == "join":
        return {"out": workflow_join(ins["left"], ins["right"], c.get("mode", "merge"),
                                     c.get("key"), c.get("how", "inner"))}
    if t == "logger":
        obs = Observation(n.id)
        observations[n.id] = obs
        return {"out": df.observe(obs, F.count(F.lit(1)).alias("rows"))}
    # sink: the result; written when a path is configured
    if c.get("path"):
        df.write.mode(c.get("mode", "append")).parquet(c["path"])
    return {"out": df}


def _is_read(df: DataFrame) -> bool:
    """Whether the rows are only read, so that a filter reaches the scan."""
    return df._jdf.queryExecution().optimizedPlan().children().isEmpty()


def run_graph(spark: SparkSession, nodes: Sequence[Node], edges: Sequence[Edge],
              sources: Mapping[str, DataFrame], share: bool = True) -> tuple[dict[str, DataFrame], dict[str, Observation]]:
    """G1: every node's output DataFrame (by node id; multi-port nodes as
    ``id:port``) and the row-count observations of logger nodes (G3; read
    them after an action on a downstream DataFrame).

    What several edges lead on from is computed once: a node's output, or the
    rows that a condition splits, are written to the shared folder and read
    from there (``share=False`` leaves every branch its own plan).  Sources
    are read by each branch, with its own filters and columns, and a fork
    writes its rows itself."""
    order = topological_order(nodes, edges)
    fan_out = Counter(e.source for e in edges)
    incoming = defaultdict(list)
    for e in edges:
        incoming[e.target].append(e)
    outputs: dict[str, dict[str, DataFrame]] = {}
    observations: dict[str, Observation] = {}
    result: dict[str, DataFrame] = {}
    for n in order:
        ins = {}
        for e in incoming[n.id]:
            src = outputs[e.source]
            if e.port not in src:
                raise ValueError(f"node {e.source} has no output port {e.port!r}")
            ins[e.input] = src[e.port]
        if n.type != "source" and not ins:
            raise ValueError(f"node {n.id} has no input")
        shared = share and fan_out[n.id] > 1
        if shared and n.type == "condition" and not _is_read(ins["in"]):
            ins["in"] = written(ins["in"], f"node-{n.id}")
        outs = _node(spark, n, ins, sources, observations)
        if shared and n.type not in ("source", "condition", "fork"):
            outs = {port: written(df, f"node-{n.id}") for port, df in outs.items()}
        outputs[n.id] = outs
        for port, df in outs.items():
            result[n.id if port == "out" else f"{n.id}:{port}"] = df
    return result, observations
