"""Connected components by contraction to smallest neighbours, in DataFrame operations over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folianth.sources.staging import staged


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the undirected ``edges`` (a, b): the smallest node that it reaches.

    Each round hooks a node to its smallest neighbour, follows such hooks four times, and renames the
    ends of all edges; edges within one node go. Every edge keeps its ends together, so no round
    parts a component, and the edges shrink fast. Only "is it empty" comes to the driver. Any
    orderable type may name the nodes; loops and repeated edges change nothing.

    A node that a large part of all nodes hook to is one key of these joins. Their sides are read from tables
    or dealt out anew, never the outcome of an aggregation by the same key, so adaptive execution may split it.
    """
    tidy = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    links = staged(edges.select(*tidy("a", "b")).where("a <> b").distinct(), "edges")
    labels = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    for _ in range(max_rounds):
        hook = staged(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "hooks")
        for _ in range(2):
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hook = hook.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
        hook = staged(hook, "hooks")
        at_root, at_a, at_b = (hook.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")) for c in ("root", "a", "b"))
        labels = staged(labels.join(at_root, "root", "left").select("node", F.coalesce("root_up", "root").alias("root")), "labels")
        renamed = links.join(at_b, "b").join(at_a, "a", "left").select(*tidy(F.coalesce("a_up", "a"), F.col("b_up")))
        links = staged(renamed.where("a <> b").distinct(), "edges")
        if links.isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
