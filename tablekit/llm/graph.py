"""Connected components of a graph whose nodes are named by hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.store import keep


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of the edges ``a``, ``b``: the root is one node of the component.

    Every round sends each node to its smallest neighbour, if that is smaller, and carries the edges over to the nodes so
    reached. Because names are hashes their order is random, and the expected number of rounds is logarithmic in the number
    of nodes, on chains too. Each round is written, so that plans stay short; nothing is collected. Self-loops and repeated
    edges are allowed; an empty table gives an empty one.
    """
    edges = keep(edges.select("a", "b").where("a <> b").distinct())
    steps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = keep(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")))
        steps.append(step)
        moved = edges.join(step, "a").select("b", F.col("to").alias("x")).join(step.withColumnRenamed("a", "b"), "b")
        edges = keep(moved.select(F.col("x").alias("a"), F.col("to").alias("b")).where("a <> b").distinct())
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # From the last and smallest round to the first, so that only one join has all nodes.
    found = steps[-1].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for step in reversed(steps[:-1]):
        later = found.select(F.col("node").alias("to"), "root")
        found = keep(step.join(later, "to", "left").select(F.col("a").alias("node"), F.coalesce("root", "to").alias("root")))
    return found


def extended(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The ``components`` of the edges that gave ``roots`` and of ``edges`` together.

    Edges are carried over to the roots first, so that the rounds see only what connects different components.
    """
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    carried = edges.select("a", "b").join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    more = components(carried.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")))
    if more.isEmpty():
        return roots
    later = more.select(F.col("node").alias("root"), F.col("root").alias("next"))
    moved = roots.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return keep(moved.unionByName(more.join(roots.select("node"), "node", "left_anti")))
