"""Biconnected parts by joins: articulation points, bridges, and what removing a node does.

The method is that of Tarjan and Vishkin. A rooted spanning forest gives preorder numbers and subtree
sizes; each subtree's least and greatest number reached by edges outside the forest tell which tree
edges lie on a common circle; tree edges so related are the nodes of an auxiliary graph, and its
components are the blocks. No edge comes to the driver, and no task sees a whole component.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.components import connected_components
from tessella.operators.graph import degrees
from tessella.operators.trees import over_subtrees, rooted, simple, spanning_forest
from tessella.scratch import written


@dataclass(frozen=True)
class Blocks:
    """``tree(node, parent, root, pre, size, low, high, block)``: a non-root's block is that of the edge to its parent."""

    names: DataFrame  # node_id, node
    tree: DataFrame


def numbered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node_id, node`` and edges ``a, b`` between 64-bit numbers."""
    return nodes.select("node_id", F.xxhash64("node_id").alias("node")), edges.select(F.xxhash64("src").alias("a"), F.xxhash64("dst").alias("b"))


def blocks(nodes: DataFrame, edges: DataFrame) -> Blocks:
    """The blocks of a one-mode or bipartite graph; isolates have none."""
    names, pairs = numbered(nodes, edges)
    pairs = written(simple(pairs), "pairs")
    trees, labels = spanning_forest(pairs)
    tree = rooted(trees, labels)
    other = pairs.join(trees.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    end = lambda x: tree.select(F.col("node").alias(x), F.col("pre").alias(f"p{x}"), F.col("size").alias(f"s{x}"))
    other = other.join(end("a"), "a").join(end("b"), "b")
    # x comes before y in preorder.
    first = F.col("pa") < F.col("pb")
    pick = lambda c, d: F.when(first, F.col(c)).otherwise(F.col(d))
    other = written(other.select(pick("a", "b").alias("x"), pick("pa", "pb").alias("px"), pick("sa", "sb").alias("sx"), pick("b", "a").alias("y"), pick("pb", "pa").alias("py")), "other")
    reach = other.select(F.col("x").alias("node"), F.col("py").alias("to")).unionByName(other.select(F.col("y").alias("node"), F.col("px").alias("to")))
    reach = reach.unionByName(tree.select("node", F.col("pre").alias("to"))).groupBy("node").agg(F.min("to").alias("low"), F.max("to").alias("high"))
    tree = written(tree.join(over_subtrees(tree, reach), "node"), "tree")
    apart = other.where("py >= px + sx").select(F.col("px").alias("a"), F.col("py").alias("b"))
    above = tree.where("parent is not null").select(F.col("node").alias("parent"), F.col("pre").alias("p"), F.col("size").alias("s"))
    bound = tree.join(above, "parent").where("low < p or high >= p + s").select(F.col("p").alias("a"), F.col("pre").alias("b"))
    block = connected_components(apart.unionByName(bound), "blocks").select(F.col("node").alias("pre"), "label")
    placed = tree.join(block, "pre", "left").withColumn("block", F.when(F.col("parent").isNotNull(), F.coalesce("label", "pre"))).drop("label")
    return Blocks(names, written(placed, "blocks"))


def bridges(nodes: DataFrame, edges: DataFrame, found: Blocks | None = None) -> DataFrame:
    """``src, dst`` of edges whose removal splits a component: no other edge leaves the subtree below them."""
    b = found or blocks(nodes, edges)
    lone = b.tree.where("parent is not null and low >= pre and high < pre + size").select("node", "parent")
    named = lone.join(b.names.select("node", F.col("node_id").alias("n")), "node").join(b.names.select(F.col("node").alias("parent"), F.col("node_id").alias("p")), "parent")
    return named.select(F.least("n", "p").alias("src"), F.greatest("n", "p").alias("dst"))


def articulation_points(b: Blocks) -> DataFrame:
    """``node, n_blocks`` of nodes in two blocks or more."""
    inner = b.tree.where("parent is not null")
    member = inner.select("node", "block").unionByName(inner.select(F.col("parent").alias("node"), "block"))
    return member.distinct().groupBy("node").agg(F.count("*").alias("n_blocks")).where("n_blocks > 1")


def cut_points(nodes: DataFrame, edges: DataFrame, found: Blocks | None = None) -> DataFrame:
    """``node_id`` of the articulation points."""
    b = found or blocks(nodes, edges)
    return articulation_points(b).join(b.names, "node").select("node_id")


def articulation_removal(nodes: DataFrame, edges: DataFrame, found: Blocks | None = None) -> DataFrame:
    """What removing each articulation point does.

    ``node_id, degree, strength, components_before, components_after, delta_components, giant_before,
    giant_after, giant_lost, pct_giant_lost, isolates_after, verified``. Children whose block is not
    their parent's own hang on the parent alone: each such block is a part, of its children's subtrees;
    the rest of the component is one more part, unless the parent is the root. ``verified`` says that
    there are more components after than before, counted from the parts.
    """
    b = found or blocks(nodes, edges)
    points = articulation_points(b)
    own = b.tree.join(points, "node").select("node", "root", F.col("block").alias("own"))
    child = b.tree.where("parent is not null").select(F.col("parent").alias("node"), F.col("block").alias("below"), "size")
    below = own.join(child, "node").where("own is null or below <> own").groupBy("node", "below").agg(F.sum("size").alias("part"))
    per = below.groupBy("node").agg(F.count("*").alias("k"), F.sum("part").alias("gone"), F.max("part").alias("largest"), F.count(F.when(F.col("part") == 1, 1)).alias("single"))
    whole = b.tree.where("parent is null").select("root", F.col("size").alias("n"))
    per = per.join(own, "node").join(whole, "root")
    # What stays above, if the node is no root.
    rest = F.when(F.col("own").isNotNull(), F.col("n") - 1 - F.col("gone")).otherwise(0)
    per = per.select("node", "n", (F.col("k") + (rest > 0).cast("int")).alias("parts"), F.greatest("largest", rest).alias("largest"), (F.col("single") + (rest == 1).cast("int")).alias("single"))
    top = [r["size"] for r in b.tree.where("parent is null").select("size").orderBy(F.desc("size")).limit(2).collect()] + [0, 0]
    lone = nodes.count() - b.tree.count()
    components = b.tree.where("parent is null").count() + lone
    giant = top[0] or min(lone, 1)
    after = F.greatest("largest", F.when(F.col("n") == top[0], F.lit(top[1])).otherwise(F.lit(top[0])))
    out = per.join(b.names, "node").join(degrees(nodes, edges), "node_id")
    out = out.select("node_id", "degree", "strength", F.lit(components).cast("long").alias("components_before"), (F.lit(components) - 1 + F.col("parts")).cast("long").alias("components_after"), F.lit(giant).cast("long").alias("giant_before"), after.cast("long").alias("giant_after"), (F.lit(lone) + F.col("single")).cast("long").alias("isolates_after"))
    lost = F.col("giant_before") - F.col("giant_after")
    return out.select(
        "node_id", "degree", "strength", "components_before", "components_after", (F.col("components_after") - F.col("components_before")).alias("delta_components"), "giant_before", "giant_after",
        lost.alias("giant_lost"), F.round(100 * lost / F.col("giant_before"), 2).alias("pct_giant_lost"), "isolates_after", (F.col("components_after") > F.col("components_before")).alias("verified"),
    )
