"""Connected components by repeated contraction of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of ``edges`` (``a``, ``b``, longs); the root is one of them.

    In each round a node with a smaller neighbour points to its smallest one, edges move to
    the nodes pointed to, and those within one node fall away. Only edges and pointers are
    kept, each round in the shared folder; no component is ever gathered. Nodes without an edge
    to another node are not returned. Rounds end when no edge is left; their number grows with the
    logarithm of a component's size.
    """
    edges = shared_table(_oriented(edges.select("a", "b")), "edges")
    rounds = []
    while not edges.isEmpty():
        hook = shared_table(edges.groupBy("a").agg(F.min("b").alias("to")), "hooks")
        rounds.append(hook)
        moved = edges
        for end in ("a", "b"):
            moved = moved.join(hook.select(F.col("a").alias(end), "to"), end, "left").withColumn(
                end, F.coalesce("to", end)
            ).drop("to")
        # A node that is pointed to and points on itself lives on, so its pointer stays as an edge.
        onward = hook.select(F.col("to").alias("a")).join(hook.select("a", F.col("to").alias("b")), "a")
        edges = shared_table(_oriented(moved.select("a", "b").union(onward.select("a", "b"))), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = None
    for hook in reversed(rounds):
        step = hook.select(F.col("a").alias("node"), F.col("to").alias("root"))
        if labels is None:
            labels = step
            continue
        later = labels.select(F.col("node").alias("root"), F.col("root").alias("end"))
        moved = step.join(later, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
        # A later round may point a node on that an earlier one had pointed already.
        known = labels.join(step.select("node"), "node", "left_anti")
        labels = shared_table(moved.union(known), "labels")
    roots = labels.select(F.col("root").alias("node"), "root").distinct()
    return labels.union(roots)


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
