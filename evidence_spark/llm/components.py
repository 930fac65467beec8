"""Connected components of a graph given as an edge table, without gathering nodes or edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_rows, materialize


def _forest():
    """Union-find over the edges of one Arrow batch: each batch leaves one edge for each node that is not its root."""
    import numpy as np
    import pyarrow as pa

    def step(batch):
        ends = np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)])
        nodes, at = np.unique(ends, return_inverse=True)
        parent = list(range(len(nodes)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for x, y in at.reshape(2, -1).T.tolist():
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        top = np.array([root(x) for x in range(len(nodes))])
        below = top != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[below]), pa.array(nodes[top[below]])], names=["u", "v"])

    return step


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node long, component long): the smallest node that can be reached. Nodes without an edge to another are absent.

    Union-find contracts the edges of each task to a forest; then large-star and small-star rounds (Kiveris et al., 2014)
    run over the forests' edges until each node points at a root. A hub is only ever the aggregated side of a join, whose
    other side Spark may split. Every round is written to the shared folder, so a lost executor costs one round at most.
    Null ends are ignored, as are loops and repeated edges; an empty table gives an empty one.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    e = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    e = materialize(map_rows(e, _forest, "u long, v long"), "forest")
    while True:
        several = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        inner = e.select(F.col("v").alias("u")).distinct().join(e.select("u"), "u", "left_semi")
        if several.unionByName(inner).isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(e, large)
        e = after
