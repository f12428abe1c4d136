"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wayloom.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b).

    Every round takes the least label among a node's neighbours and then the
    label of that label, so chains shorten by halves.  Both steps are an equi
    join plus a minimum that combines before the shuffle; nothing is gathered
    per node.  Nodes without an edge do not occur in the result; an empty edge
    list gives an empty result.  Self loops and repeated edges are harmless.
    """
    both = scratch.save(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    label = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = (
            both.join(label.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        )
        lower = label.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "seen").alias("mid"))
        jump = label.select(F.col("node").alias("mid"), F.col("component").alias("up"))
        done = scratch.save(lower.join(jump, "mid").select("node", "was", F.least("mid", "up").alias("component")), "labels")
        changed = done.where("component <> was").limit(1).count()
        scratch.drop(label)
        label = done
        if not changed:
            scratch.drop(both)
            return label.select("node", "component")

