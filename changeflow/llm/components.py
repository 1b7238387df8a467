"""Connected components of an edge list, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.llm.common import stored


def _map(df: DataFrame, column: str, to: DataFrame) -> DataFrame:
    """``df`` with ``column`` replaced by its image under ``to`` (node, root)."""
    m = to.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    return (df.join(m, df[column] == m["__node"], "left")
            .withColumn(column, F.coalesce("__root", column)).drop("__node", "__root"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): equal roots are
    connected, a root is the smallest node of its component.

    Every round hooks each node to its smallest neighbour, jumps until the
    hooks are stars, and contracts the edges; at least half of the nodes that
    still have an edge go in a round.  Nothing but counts reaches the driver."""
    left = stored(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = left.select(F.col("a").alias("node")).union(left.select("b")).distinct().select("node", F.col("node").alias("root"))
    roots = stored(roots, "roots")
    while not left.isEmpty():
        hooks = stored(left.select(F.col("b").alias("node"), F.col("a").alias("root"))
                       .unionByName(left.select(F.col("a").alias("node"), F.col("a").alias("root")))
                       .groupBy("node").agg(F.min("root").alias("root")), "hooks")
        while True:
            # two jumps a table: most hooks are stars by then
            jumped = stored(_map(_map(hooks.withColumn("old", F.col("root")), "root", hooks), "root", hooks), "hooks")
            moved = not jumped.filter("root != old").isEmpty()
            hooks = jumped.drop("old")
            if not moved:
                break
        roots = stored(_map(roots, "root", hooks), "roots")
        left = stored(_map(_map(left, "a", hooks), "b", hooks).filter("a != b")
                      .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return roots
