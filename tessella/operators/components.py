"""Connected components of edge lists, by rounds of hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.scratch import written


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Label every node of an undirected edge list with the smallest node of its component.

    ``edges(a, b)``: long ids. Returns ``(node, label)`` for nodes that stand in some edge with
    ``a <> b``. Each round hooks every node onto its smallest neighbour, flattens the hooks by
    pointer jumping, and contracts the edges; the edge list at least halves each round. All
    state lives in written tables, so a hub is only ever a skewed join side that can be split.
    """
    spark = edges.sparkSession
    edges = written(
        edges.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        tag,
    )
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")), tag)
        while True:
            up = hook.select(F.col("a").alias("p"), F.col("p").alias("q"))
            jumped = hook.join(up, "p").select("a", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved"))
            jumped = written(jumped, tag)
            moved = not jumped.where("moved").isEmpty()
            hook = jumped.select("a", "p")
            if not moved:
                break
        if labels is None:
            labels = hook.select(F.col("a").alias("node"), F.col("p").alias("label"))
        else:
            to = hook.select(F.col("a").alias("label"), "p")
            labels = written(
                labels.join(to, "label", "left").select("node", F.coalesce("p", "label").alias("label")), tag
            )
        ends = edges
        for end in ("a", "b"):
            ends = ends.join(hook.select(F.col("a").alias(end), F.col("p").alias(f"p{end}")), end)
        edges = written(
            ends.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
            tag,
        )
    if labels is None:
        return spark.createDataFrame([], "node long, label long")
    return labels
