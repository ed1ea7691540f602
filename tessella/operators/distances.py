"""Distances and betweenness by rounds of joins, in blocks of sources.

State is a table of (source, node, distance), written each round; a block holds as many sources as
keep that table and the arcs of shortest paths below a number of rows, and blocks follow one another.
Distances are relaxed from a frontier: of the rows that have changed, those of the lowest bucket of
distances. Sources that have reached their whole component relax only what can still come nearer.

Path counts run forward and dependencies backward over the arcs of shortest paths, one hop a round,
as sums over hops; with unit lengths hops are levels. No task sees the graph, nothing is shared.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import graph
from tessella.operators.components import connected_components
from tessella.operators.stats import cumulated
from tessella.scratch import new_path, remove, replaced, written

#: Rows of state and of arcs that a block of sources may have.
ROWS = 50_000_000
#: Distances that differ by less are equal.
NEAR = 1e-12


@dataclass(frozen=True)
class Network:
    """A graph in 64-bit numbers: ``names(node_id, node, whole)`` with the size of each node's component, arcs ``a, b, len`` both ways."""

    names: DataFrame
    arcs: DataFrame
    cost: int  # nodes and arcs of a source's component, summed over all sources


def network(nodes: DataFrame, edges: DataFrame, weighted: bool) -> Network:
    """Lengths are 1, or the inverse of weights."""
    length = 1 / F.greatest(F.col("weight").cast("double"), F.lit(NEAR)) if weighted else F.lit(1.0)
    one = edges.select(F.xxhash64("src").alias("a"), F.xxhash64("dst").alias("b"), length.alias("len"))
    arcs = written(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "len")), "arcs")
    label = connected_components(arcs.select("a", "b"), "parts")
    degree = arcs.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("d"))
    sizes = written(label.join(degree, "node").groupBy("label").agg(F.count("*").alias("whole"), F.sum("d").alias("arcs")), "sizes")
    cost = sizes.agg(F.sum(F.col("whole") * (F.col("whole") + F.col("arcs")).cast("double"))).first()[0] or 0
    placed = nodes.select("node_id", F.xxhash64("node_id").alias("node")).join(label.join(sizes, "label"), "node", "left")
    names = written(placed.select("node_id", "node", F.coalesce("whole", F.lit(1)).cast("long").alias("whole")), "names")
    return Network(names, arcs, int(cost))


def source_blocks(g: Network, rows: int) -> list[DataFrame]:
    """Sources ``s, whole`` in so many blocks that the nodes and arcs which those of one can reach stay below ``rows``."""
    k = max(-(-g.cost // rows), 1)
    return [g.names.where(F.pmod("node", F.lit(k)) == i).select(F.col("node").alias("s"), "whole") for i in range(k)]


def relaxed(g: Network, sources: DataFrame) -> DataFrame:
    """``s, v, dist, whole`` of all nodes that the sources reach, themselves included."""
    ends = g.arcs.agg(F.min("len").alias("short"), F.max("len").alias("long")).first()
    best = written(sources.select("s", F.col("s").alias("v"), F.lit(0.0).alias("dist"), "whole", (F.col("whole") > 1).alias("open")), "dist")
    while True:
        low = best.where("open").agg(F.min("dist").alias("d")).first()["d"]
        if low is None:
            return best.drop("open")
        turn = F.col("open") & (F.col("dist") <= low + ends["long"])
        # From a node this far, nothing of a wholly reached component comes nearer.
        far = best.groupBy("s").agg(F.count("*").alias("reached"), F.max("dist").alias("far"))
        useful = (F.col("reached") < F.col("whole")) | (F.col("dist") + ends["short"] < F.col("far") - NEAR)
        front = best.where(turn).join(far, "s").where(useful)
        sent = front.join(g.arcs, F.col("v") == F.col("a")).groupBy("s", F.col("b").alias("v")).agg(F.min(F.col("dist") + F.col("len")).alias("d"), F.min("whole").alias("w"))
        new = best.withColumn("wait", F.col("open") & ~turn).join(sent, ["s", "v"], "full")
        nearer = F.col("d").isNotNull() & (F.col("dist").isNull() | (F.col("d") < F.col("dist") - NEAR))
        new = new.select("s", "v", F.when(nearer, F.col("d")).otherwise(F.col("dist")).alias("dist"), F.coalesce("whole", "w").alias("whole"), (nearer | F.coalesce("wait", F.lit(False))).alias("open"))
        best = replaced(best, new, "dist")


def shortest_arcs(g: Network, best: DataFrame) -> DataFrame:
    """``s, v, u``: the arcs that shortest paths from ``s`` take."""
    short = g.arcs.agg(F.min("len")).first()[0] or 0.0
    far = best.groupBy("s").agg(F.max("dist").alias("far"))
    tails = best.join(far, "s").where(F.col("dist") + short <= F.col("far") + NEAR).select("s", "v", F.col("dist").alias("dv"))
    step = tails.join(g.arcs, F.col("v") == F.col("a")).select("s", "v", F.col("b").alias("u"), (F.col("dv") + F.col("len")).alias("to"), "dv")
    heads = best.select("s", F.col("v").alias("u"), F.col("dist").alias("du"))
    return step.join(heads, ["s", "u"]).where((F.abs(F.col("to") - F.col("du")) <= NEAR) & (F.col("dv") < F.col("du"))).select("s", "v", "u")


def _propagated(start: DataFrame, arcs: DataFrame, tail: str, head: str) -> tuple[DataFrame | None, list[str]]:
    """Sums of ``x(s, node, x)`` sent along arcs from ``tail`` to ``head``, hop by hop: all hops after the first table."""
    spark, paths, front = start.sparkSession, [], start
    while True:
        path = new_path(spark, "hop")
        sent = front.join(arcs.select("s", F.col(tail).alias("node"), F.col(head).alias("to")), ["s", "node"])
        sent.groupBy("s", F.col("to").alias("node")).agg(F.sum("x").alias("x")).write.parquet(path)
        front = spark.read.schema("s long, node long, x double").parquet(path)
        paths.append(path)
        if front.isEmpty():
            break
    return spark.read.schema("s long, node long, x double").parquet(*paths).groupBy("s", "node").agg(F.sum("x").alias("x")), paths


def dependencies(g: Network, best: DataFrame) -> DataFrame:
    """``node, x``: the share of shortest paths from the sources that pass through each node, summed over targets."""
    arcs = written(shortest_arcs(g, best), "sp")
    start = best.where("s = v").select("s", F.col("v").alias("node"), F.lit(1.0).alias("x"))
    counts, used = _propagated(start, arcs, "v", "u")
    counts = written(counts, "counts")
    back, more = _propagated(counts.select("s", "node", (1 / F.col("x")).alias("x")), arcs, "u", "v")
    both = counts.withColumnRenamed("x", "paths").join(back, ["s", "node"]).where("s <> node")
    out = written(both.groupBy("node").agg(F.sum(F.col("paths") * F.col("x")).alias("x")), "through")
    for path in (*used, *more):
        remove(best.sparkSession, path)
    return out


def path_sums(nodes: DataFrame, edges: DataFrame, weighted: bool, through: bool = True, rows: int = ROWS) -> DataFrame:
    """Per node: ``node_id, reached, far, total, near, through``, its distances summed up and its betweenness, unscaled.

    ``near`` sums inverse distances; ``through`` is null unless asked for.
    """
    g = network(nodes, edges, weighted)
    own, passed = None, None
    for sources in source_blocks(g, rows):
        best = relaxed(g, sources)
        part = best.groupBy(F.col("s").alias("node")).agg(
            F.count("*").alias("reached"), F.max("dist").alias("far"), F.sum("dist").alias("total"), F.sum(F.when(F.col("dist") > 0, 1 / F.col("dist")).otherwise(0.0)).alias("near")
        )
        part = written(part, "own")
        own = part if own is None else own.unionByName(part)
        if through:
            x = dependencies(g, best)
            passed = x if passed is None else passed.unionByName(x)
    out = g.names.join(own, "node")
    if not through:
        return out.select("node_id", "reached", "far", "total", "near", F.lit(None).cast("double").alias("through"))
    return out.join(passed.groupBy("node").agg(F.sum("x").alias("through")), "node", "left").select("node_id", "reached", "far", "total", "near", F.coalesce("through", F.lit(0.0)).alias("through"))


def path_measures(nodes: DataFrame, edges: DataFrame, rows: int = ROWS) -> DataFrame:
    """``node_id, closeness, harmonic, eccentricity, reached, distance_sum, betweenness, weighted_betweenness``.

    Closeness (scaled by the reached share), harmonic and both betweennesses use whole-graph node
    counts; closeness, harmonic and the weighted betweenness take weights as inverse distances,
    eccentricity and distance sums count steps. A node alone has zeros.
    """
    return scaled(both_sums(nodes, edges, rows), nodes.agg(F.count("*").alias("n")))


def both_sums(nodes: DataFrame, edges: DataFrame, rows: int = ROWS) -> DataFrame:
    """``node_id, reached, far, total, through`` in steps, ``wtotal, wnear, wthrough`` with weights as inverse distances."""
    steps = path_sums(nodes, edges, False, rows=rows).select("node_id", "reached", "far", "total", "through")
    far = path_sums(nodes, edges, True, rows=rows).select("node_id", F.col("total").alias("wtotal"), F.col("near").alias("wnear"), F.col("through").alias("wthrough"))
    return steps.join(far, "node_id")


def scaled(sums: DataFrame, n: DataFrame) -> DataFrame:
    """:func:`path_measures` from :func:`both_sums` and one row ``n``, the number of nodes."""
    x = sums.crossJoin(F.broadcast(n))
    r, many = F.col("reached") - 1, F.nullif(F.col("n") - 1, F.lit(0))
    scale = F.nullif(many * (F.col("n") - 2), F.lit(0))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return x.select(
        "node_id", zero(r / many * r / F.nullif("wtotal", F.lit(0.0))).alias("closeness"), zero(F.col("wnear") / many).alias("harmonic"), F.col("far").cast("long").alias("eccentricity"), "reached",
        F.col("total").cast("long").alias("distance_sum"), zero(F.col("through") / scale).alias("betweenness"), zero(F.col("wthrough") / scale).alias("weighted_betweenness"),
    )


def giant_paths(nodes: DataFrame, edges: DataFrame, rows: int = ROWS) -> DataFrame:
    """One row ``size, diameter, radius, mean_distance`` of the largest component, in steps."""
    p = path_sums(nodes, edges, False, through=False, rows=rows).select("far", "reached", "total")
    top = p.agg(F.max("reached").alias("reached"))  # one row
    big = p.join(F.broadcast(top), "reached")
    pairs = F.nullif(F.count("*") * (F.max("reached") - 1), F.lit(0))
    return big.agg(
        F.max("reached").alias("size"), F.max("far").cast("long").alias("diameter"), F.min("far").cast("long").alias("radius"), F.round(F.sum("total") / pairs, 4).alias("mean_distance")
    )


def giant_paths_projected(edges: DataFrame, node: str, through: str, rows: int = ROWS) -> DataFrame:
    """:func:`giant_paths` of a projection, by way of the bipartite ``edges`` and of the largest components alone; no pair is made.

    A step goes from nodes to their neighbours and on to all members of these. State is the sources
    that have reached a node, 64 in a word, in blocks of words; distances are the same both ways, so
    what has reached a node after each step tells its own distances.
    """
    x = edges.select(F.col(node).alias("node_id"), F.xxhash64(through).alias("t")).where(F.col(node).isNotNull() & F.col(through).isNotNull()).distinct()
    parts = graph.components_projected(edges, node, through)
    sizes = written(parts.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    top = sizes.agg(F.max("size")).first()[0]
    if top is None:
        return edges.sparkSession.createDataFrame([(None, None, None, None)], "size long, diameter long, radius long, mean_distance double")
    giants = parts.join(sizes.where(F.col("size") == top), "component").select(F.struct("component", "node_id").alias("place"), F.lit(1).alias("one"))
    names = written(cumulated(giants, "place", "one", "number").select("place.*", F.col("number").cast("long").alias("v")), "names")
    first = names.groupBy("component").agg(F.min("v").alias("first"))
    names = written(names.join(first, "component").select("node_id", "v", (F.col("v") - F.col("first")).alias("source")), "names")
    ties = written(x.join(names, "node_id").select("v", "t"), "ties")
    words, per = -(-top // 64), max(rows // max(ties.count(), 1), 1)
    known = None
    for low in range(0, words, per):
        full = min(top, 64 * (low + per)) - 64 * low
        word = F.floor(F.col("source") / 64).cast("int")
        state = names.where((word >= low) & (word < low + per)).select("v", word.alias("w"), F.expr("shiftleft(1L, cast(source % 64 as int))").alias("bits"))
        state, levels = written(state, "reached"), []
        while True:
            many = written(state.groupBy("v").agg(F.sum(F.bit_count("bits")).alias("n")), "many")
            if many.where(F.col("n") == full).count() == names.count():
                break
            levels.append(many)
            met = ties.join(state, "v").groupBy("t", "w").agg(F.bit_or("bits").alias("bits"))
            state = replaced(state, ties.join(met, "t").groupBy("v", "w").agg(F.bit_or("bits").alias("bits")), "reached")
        # After each step so many were still further off.
        late = reduce(DataFrame.unionByName, levels).groupBy("v").agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") == full, 1)).alias("done")) if levels else names.select("v", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("done"))
        late = late.select("v", (len(levels) * full - F.col("n")).alias("total"), (len(levels) - F.col("done")).alias("far"))
        # Nodes that nothing had reached by the last step but one.
        late = names.select("v").join(late, "v", "left").select("v", F.coalesce("total", F.lit(len(levels) * full)).alias("total"), F.coalesce("far", F.lit(len(levels))).alias("far"))
        known = late if known is None else known.unionByName(late)
    own = known.groupBy("v").agg(F.sum("total").alias("total"), F.max("far").alias("far"))
    pairs = F.nullif(F.count("*") * (F.lit(top) - 1), F.lit(0))
    return own.agg(
        F.lit(top).cast("long").alias("size"), F.max("far").cast("long").alias("diameter"), F.min("far").cast("long").alias("radius"), F.round(F.sum("total") / pairs, 4).alias("mean_distance")
    )


def ranked(df: DataFrame, columns: list[str]) -> DataFrame:
    """Places of each column from the largest, ties sharing the smallest place, nulls last.

    Places are counted over distinct values, in ranges beyond a size (:func:`stats.cumulated`).
    """
    for c in columns:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.count("*").alias("_m"))
        place = cumulated(counts, "_v", "_m", "_up", descending=True).select("_v", (F.col("_up") - F.col("_m") + 1).alias(f"rank_{c}"))
        known = df.agg((F.count(c) + 1).alias("_last"))  # one row
        df = df.join(place, F.col(c) == F.col("_v"), "left").crossJoin(F.broadcast(known)).withColumn(f"rank_{c}", F.coalesce(f"rank_{c}", "_last").cast("int")).drop("_v", "_last")
    return df
