"""Connected components over an edge table, by minimum labels with pointer jumping.

Each round is a pair of shuffle joins and a map-side combined ``min``; a hub's edges are combined before the
shuffle and its join side can be split by adaptive execution. State is written to the shared folder each
round, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.storage import stored


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every endpoint; ``component`` is the smallest node reachable.

    Edges are undirected; self-loops give singletons, null endpoints are dropped, repeated edges count once.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    links = stored(both.union(both.select("b", "a")).distinct(), "links")
    labels = stored(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        # the least label among a node's neighbours
        near = links.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("least"))
        # the root of the old label takes the least label that any of its members has seen
        roots = hooked.groupBy(F.col("component").alias("root")).agg(F.min("least").alias("to"))
        moved = hooked.join(roots, hooked.component == roots.root).select("node", F.col("component").alias("was"), F.col("to").alias("now"))
        jump = moved.select(F.col("node").alias("now"), F.col("now").alias("further"))
        after = stored(moved.join(jump, "now", "left").select("node", "was", F.least("now", F.coalesce("further", "now")).alias("component")), "labels")
        labels = after.select("node", "component")
        if after.where("was <> component").isEmpty():
            return labels
