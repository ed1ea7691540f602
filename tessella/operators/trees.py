"""Spanning forests, rooted by Euler tours: preorder numbers, subtree sizes, sums over subtrees.

Everything is rounds of joins over written tables, with a number of rounds that grows with the
logarithm of the nodes: hooks and contractions, pointer jumping along the tour, and doubling of
ancestors. Node ids are longs. A hub is a skewed side of a join, or a key that is pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.stats import cumulated
from tessella.scratch import replaced, written


def simple(edges: DataFrame) -> DataFrame:
    """``a, b`` with a < b: each pair once, without loops."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def spanning_forest(edges: DataFrame, tag: str = "forest") -> tuple[DataFrame, DataFrame]:
    """Tree edges ``a, b`` of a forest that spans ``edges(a, b)``, and ``node, label``: the least id of its part.

    Each round every node that has a smaller neighbour hooks onto the smallest, along an edge that
    is kept with its original ends; hooks lead to ever smaller ids, so no circle closes. Hooked nodes
    are contracted by pointer jumping.
    """
    left = written(simple(edges).select("a", "b", F.col("a").alias("oa"), F.col("b").alias("ob")), tag)
    trees, labels = None, None
    while not left.isEmpty():
        hook = left.groupBy("b").agg(F.min(F.struct("a", "oa", "ob")).alias("h")).select(F.col("b").alias("a"), F.col("h.a").alias("p"), "h.oa", "h.ob")
        hook = written(hook, tag)
        chosen = hook.select(F.col("oa").alias("a"), F.col("ob").alias("b"))
        trees = chosen if trees is None else trees.unionByName(chosen)
        to = hook.select("a", "p", F.lit(True).alias("moved"))
        while True:
            # The parent's parent; a parent that has not hooked is a root.
            up = to.select(F.col("a").alias("p"), F.col("p").alias("q"))
            jumped = written(to.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), tag)
            to = jumped
            if jumped.where("moved").isEmpty():
                break
        to = to.select("a", "p")
        if labels is None:
            roots = left.select(F.col("a")).distinct().join(to, "a", "left_anti").select(F.col("a").alias("node"), F.col("a").alias("label"))
            labels = written(to.select(F.col("a").alias("node"), F.col("p").alias("label")).unionByName(roots), tag)
        else:
            labels = replaced(labels, labels.join(to.toDF("label", "p"), "label", "left").select("node", F.coalesce("p", "label").alias("label")), tag)
        ends = left
        for end in ("a", "b"):
            ends = ends.join(to.toDF(end, f"p{end}"), end, "left").withColumn(end, F.coalesce(f"p{end}", end)).drop(f"p{end}")
        ends = ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "oa", "ob")
        left = replaced(left, ends.groupBy("a", "b").agg(F.min(F.struct("oa", "ob")).alias("o")).select("a", "b", "o.oa", "o.ob"), tag)
    if trees is None:
        spark = edges.sparkSession
        return spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "node long, label long")
    return trees, labels


def rooted(trees: DataFrame, labels: DataFrame, tag: str = "tour") -> DataFrame:
    """``node, parent, root, pre, size`` of a forest whose roots are the labels; a root's parent is null.

    ``pre`` numbers all nodes of the forest from 1, each tree in preorder, so the subtree of a node is
    ``pre`` to ``pre + size - 1``.

    Each tree edge is two arcs. After an arc u to v comes the arc out of v that follows the one back
    to u in the order of v's neighbours, round again after the last: a tour. Cut before the root's
    first arc it is a list, ranked by pointer jumping. An arc ranked before its reverse leads down.
    """
    arcs = trees.select("a", "b").unionByName(trees.select(F.col("b").alias("a"), F.col("a").alias("b")))
    arcs = arcs.withColumn("k", F.struct("a", "b")).withColumn("one", F.lit(1))
    arcs = written(cumulated(arcs, "k", "one", "at").select("a", "b", F.col("at").cast("long").alias("at")), tag)
    spans = arcs.groupBy("a").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    # The arc from v back to u, its place among v's arcs, and the arc after it.
    back = arcs.join(spans, "a").select(F.col("a").alias("b"), F.col("b").alias("a"), F.when(F.col("at") < F.col("last"), F.col("at") + 1).otherwise(F.col("first")).alias("next"))
    starts = labels.where("node = label").select(F.col("node").alias("a")).join(spans, "a").select(F.col("first").alias("next"), F.lit(True).alias("start"))
    linked = arcs.join(back, ["a", "b"]).join(starts, "next", "left")
    # The last arc of a tour points at itself.
    rank = linked.select("at", F.when(F.col("start"), F.col("at")).otherwise(F.col("next")).alias("next"), F.when(F.col("start"), 0).otherwise(1).cast("long").alias("d"), F.lit(True).alias("open"))
    rank = written(rank, tag)
    while not rank.where("open").isEmpty():
        ahead = rank.select(F.col("at").alias("next"), F.col("next").alias("n2"), F.col("d").alias("d2"))
        jumped = rank.join(ahead, "next").select("at", F.col("n2").alias("next"), (F.col("d") + F.col("d2")).alias("d"), (F.col("n2") != F.col("next")).alias("open"))
        rank = replaced(rank, jumped, tag)
    both = arcs.join(rank.select("at", "d"), "at").select("a", "b", "d")
    down = both.join(both.toDF("b", "a", "back"), ["a", "b"]).where("d > back")
    child = down.select(F.col("b").alias("node"), F.col("a").alias("parent"), ((F.col("d") - F.col("back") + 1) / 2).cast("long").alias("size"), "d").join(labels, "node")
    tops = labels.where("node = label").join(labels.groupBy("label").agg(F.count("*").alias("size")), "label")
    tops = tops.select("node", F.lit(None).cast("long").alias("parent"), "size", F.lit((1 << 62)).cast("long").alias("d"), "label")
    every = child.select("node", "parent", "size", "d", "label").unionByName(tops)
    every = every.withColumn("k", F.struct(F.col("label"), -F.col("d"))).withColumn("one", F.lit(1))
    placed = cumulated(every, "k", "one", "pre")
    return written(placed.select("node", "parent", F.col("label").alias("root"), F.col("pre").cast("long").alias("pre"), "size"), tag)


def over_subtrees(tree: DataFrame, local: DataFrame, tag: str = "low") -> DataFrame:
    """``node, low, high``: the least ``low`` and greatest ``high`` of ``local(node, low, high)`` in each subtree.

    After round k a node knows its descendants of fewer than 2^k steps, and its ancestor 2^k steps up.
    """
    state = written(tree.select("node", F.col("parent").alias("up")).join(local, "node").select("node", "up", "low", "high"), tag)
    while not state.where("up is not null").isEmpty():
        sent = state.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.min("low").alias("l"), F.max("high").alias("h"))
        above = state.where("up is not null").select(F.col("node").alias("up"), F.col("up").alias("up2"))
        new = state.join(sent, "node", "left").join(above, "up", "left")
        state = replaced(state, new.select("node", F.col("up2").alias("up"), F.least("low", "l").alias("low"), F.greatest("high", "h").alias("high")), tag)
    return state.select("node", "low", "high")
