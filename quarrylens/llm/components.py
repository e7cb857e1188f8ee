"""Connected components over an edge table, as joins; no edges or labels reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm._common import Scratch, discard, written

MAX_ROUNDS = 100


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for each endpoint of edges(a, b); root is the smallest node id of the component.

    Each round takes the smallest root among neighbours and then jumps to the root's root.
    """
    pairs = edges.select("a", "b").filter("a <> b")
    with Scratch() as scratch:
        both = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-edges")
        held = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("now")), f"{label}-roots")
        for _ in range(MAX_ROUNDS):
            roots = held.select("node", F.col("now").alias("root"))
            near = both.join(roots, both.b == roots.node).groupBy("a").agg(F.min("root").alias("near"))
            step = roots.join(near, roots.node == near.a).select("node", "root", F.least("root", "near").alias("to"))
            jump = roots.select(F.col("node").alias("to"), F.col("root").alias("far"))
            after = written(step.join(jump, "to", "left").select("node", "root", F.least("to", F.coalesce("far", "to")).alias("now")), f"{label}-roots")
            discard(held)
            held = after
            if not after.filter("now <> root").limit(1).count():
                scratch.discard(after)
                return after.select("node", F.col("now").alias("root"))
    raise RuntimeError("components did not settle")
