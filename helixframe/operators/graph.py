"""Connected components of an edge table by spreading the smallest label, with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.runtime import checkpoint

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component: the smallest node that each node of the edges is connected with.

    Alternates large-star and small-star rounds on the edge table, so that it stays as large as the graph and ends after
    a number of rounds that grows with the logarithm of the longest path. Each round is a shuffle by node with partial
    aggregation; lineage is cut by a reliable checkpoint. A self-edge stands for a node alone; null ends are left out.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    nodes = checkpoint(both.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    live = checkpoint(both.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(MAX_ROUNDS):
        # large star: the larger neighbours of a node go to the smallest of its neighbours and itself
        around = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the smaller neighbours of a node, and the node, go to the smallest of them
        down = large.where("a > b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        live = checkpoint(small)
        state = tuple(live.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components didn't settle")
    return nodes.join(live.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
