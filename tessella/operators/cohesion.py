"""Node and edge connectivity of the largest component, through disjoint paths and flows.

The least degree bounds both, and nodes bound edges from below: where disjoint paths
(:mod:`tessella.operators.fans`) show a node connectivity of the least degree, that is the edge
connectivity too. Elsewhere flows over edges are spread over sinks. A graph keeps its connectivities up
to k when it is thinned to k breadth-first forests, each of what the ones before leave over; they have
k(n - 1) edges at most and are found by joins. Only where edges are too many to go along are they thinned
so. Articulation points and bridges settle a connectivity of one before any of that.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import blocks, graph
from tessella.operators.components import connected_components
from tessella.operators.fans import Joined, fan
from tessella.operators.trees import simple
from tessella.scratch import replaced, written

#: Most edges that go along with flows (about 200 bytes each in a worker), and members of groups that go along with fans (about 32 bytes).
MOST_EDGES, MOST_TIES = 500_000, 5_000_000
Capacity = dict[object, dict[object, int]]


def scan_forest(pairs: DataFrame) -> DataFrame:
    """Tree edges ``a, b`` of a breadth-first forest from the least node of each part; a node hangs on the least one of the level before."""
    arcs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    front = written(connected_components(pairs, "roots").select(F.col("label").alias("node")).distinct(), "level")
    seen, trees = front, None
    while True:
        reached = arcs.join(front.withColumnRenamed("node", "a"), "a").groupBy("b").agg(F.min("a").alias("a"))
        level = written(reached.join(seen.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"), "level")
        if level.isEmpty():
            return simple(trees) if trees is not None else pairs.limit(0)
        trees = level if trees is None else trees.unionByName(level)
        front = level.select(F.col("b").alias("node"))
        seen = written(seen.unionByName(front), "seen")


def certificate(pairs: DataFrame, k: int) -> DataFrame:
    """At most k(n - 1) of the edges ``a, b`` that keep connectivities up to ``k``."""
    left, kept = written(pairs, "left"), None
    for _ in range(k):
        if left.isEmpty():
            break
        trees = written(scan_forest(left), "scan")
        kept = trees if kept is None else kept.unionByName(trees)
        left = replaced(left, left.join(trees, ["a", "b"], "left_anti"), "left")
    return kept if kept is not None else pairs


def flow(capacity: Capacity, source: object, sink: object, most: int) -> int:
    """Unit flow by breadth-first augmenting paths, up to ``most``."""
    residual = {v: dict(out) for v, out in capacity.items()}
    for v, out in capacity.items():
        for u in out:
            residual.setdefault(u, {}).setdefault(v, 0)
    for total in range(most):
        came, queue = {source: None}, deque([source])
        while queue and sink not in came:
            v = queue.popleft()
            for u, c in residual[v].items():
                if c > 0 and u not in came:
                    came[u] = v
                    queue.append(u)
        if sink not in came:
            return total
        v = sink
        while came[v] is not None:
            residual[came[v]][v] -= 1
            residual[v][came[v]] += 1
            v = came[v]
    return most


def _spread(graph: Joined, checks: list[tuple[int, int]], most: int, spread: int, spark: SparkSession) -> int:
    """The least number of disjoint paths, up to ``most``, of places ``a, b``: between both, or of ``a`` to all before it where ``b`` is -1."""
    if not checks:
        return most
    shared = spark.sparkContext.broadcast(graph)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least, graph = most, shared.value
        for pdf in batches:
            for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
                least = min(least, fan(graph, a, (1 << a) - 1 if b < 0 else graph.bits(b), least))
        yield pd.DataFrame({"k": [least]})

    table = spark.createDataFrame(pd.DataFrame(checks, columns=["a", "b"])).repartition(spread)
    return table.mapInPandas(run, "k int").agg(F.min("k")).first()[0]


def node_connectivity(ties: DataFrame, n: int, least: int, spread: int = 64) -> tuple[int, Joined | None]:
    """Node connectivity of a connected, incomplete graph of ``n`` nodes and least degree ``least``, and the graph in numbers.

    ``ties(v, t)``: members ``v`` of the groups ``t`` whose members are all joined. With too many of them, 0 and none.
    """
    rows = ties.limit(MOST_TIES + 1).toPandas()
    if len(rows) > MOST_TIES:
        return 0, None
    (node, _), (group, _) = (pd.factorize(rows[c], sort=True) for c in ("v", "t"))
    order, pairs, later = Joined(node, group, n).order(least)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    graph = Joined(place[node], group, n)
    return _spread(graph, pairs + [(a, -1) for a in later], least, spread, ties.sparkSession), graph


def edge_connectivity(spark: SparkSession, graph: Joined, pairs: Callable[[], DataFrame], least: int) -> int:
    """Edge connectivity of a connected graph of least degree ``least``; ``pairs()`` are its edges, made only if they are too many to be held.

    Fewer than ``least`` edges part no group of more members, and no node from a set that hangs together
    in that sense and has so many of its neighbours. Either side of a smaller cut has a node whose
    neighbours are all on that side; so flows go from the largest such set to nodes that neither it nor
    another one chosen has as a neighbour.
    """
    label = np.arange(graph.n)
    for m in graph.larger(least):
        label[np.isin(label, label[m])] = label[m].min()
    core = label == np.argmax(np.bincount(label))
    near, new = np.zeros(graph.n, np.int64), np.flatnonzero(core)
    while len(new):
        for v in new:
            near[graph.neighbours(int(v))] += 1
        new = np.flatnonzero(~core & (near >= least))
        core[new] = True
    met, chosen = core | (near > 0), []
    for v in np.flatnonzero(~met).tolist():
        if not met[v]:
            chosen.append(v)
            met[v] = True
            met[graph.neighbours(v)] = True
    if not chosen:
        return least
    many = sum(len(graph.neighbours(v)) for v in range(graph.n)) // 2
    if many <= MOST_EDGES:
        return least_flows(spark, {v: set(graph.neighbours(v).tolist()) for v in range(graph.n)}, int(np.argmax(core)), chosen, least)
    thin = pairs()
    thin = certificate(thin, least) if least * (graph.n - 1) < many else thin
    rows = thin.limit(MOST_EDGES + 1).collect()
    if len(rows) > MOST_EDGES:
        raise ValueError(f"flows are for certificates of up to {MOST_EDGES} edges")
    of: dict[int, set[int]] = {}
    for a, b in rows:
        of.setdefault(a, set()).add(b)
        of.setdefault(b, set()).add(a)
    first = min(of)
    return least_flows(spark, of, first, [v for v in of if v != first], least)


def least_flows(spark: SparkSession, near: dict[int, set[int]], first: int, sinks: list[int], least: int, spread: int = 16) -> int:
    """The least flow, up to ``least``, from one node to some others over the edges ``near``."""
    shared = spark.sparkContext.broadcast(near)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain: Capacity = {v: dict.fromkeys(out, 1) for v, out in shared.value.items()}
        found = least
        for pdf in batches:
            for sink in pdf["b"].tolist():
                found = flow(plain, first, sink, found)
        yield pd.DataFrame({"k": [found]})

    table = spark.createDataFrame([(v,) for v in sinks], "b long").repartition(spread)
    return table.mapInPandas(run, "k int").agg(F.min("k")).first()[0]


def connectivities(ties: DataFrame, pairs: Callable[[], DataFrame], degree: DataFrame, n: int) -> tuple[int, Callable[[], int]]:
    """Node connectivity of a connected graph of ``n`` nodes, two at least, and what gives its edge connectivity; 0 if there are too many ties.

    ``ties(v, t)``: members of groups that are all joined, such as both ends of an edge; ``pairs()``
    gives the edges ``a, b``, and ``degree`` the degree of each node.
    """
    ends = degree.agg(F.min("degree").alias("least"), F.sum("degree").alias("both")).first()
    least = ends["least"]
    if least == 1 or ends["both"] == n * (n - 1):
        return least, lambda: least
    k, graph = node_connectivity(ties, n, least)

    def edges() -> int:
        if graph is None:
            raise ValueError(f"disjoint paths are for graphs of up to {MOST_TIES} members of groups")
        return least if k == least else edge_connectivity(ties.sparkSession, graph, pairs, least)

    return k, edges


def cohesion(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: connectivity of the graph (0 if it is in parts) and of its largest component, the one of the least number among equals.

    ``components, giant, node_connectivity, edge_connectivity, giant_node_connectivity,
    giant_edge_connectivity, articulation_points, bridges``; the last four are of that component.
    """

    def known(own: DataFrame, n: int) -> tuple[int, Callable[[], int]]:
        inside = blocks.numbered(nodes, edges)[1]
        inside = written(simple(inside).join(own.select(F.col("node").alias("a")), "a", "left_semi"), "pairs")
        ties = inside.select(F.explode(F.array("a", "b")).alias("v"), F.struct("a", "b").alias("t"))
        degree = ties.groupBy("v").agg(F.count("*").alias("degree"))
        return connectivities(ties.select("v", F.concat_ws(" ", "t.a", "t.b").alias("t")), lambda: inside, degree, n)

    return _cohesion(nodes, edges, known)


def cohesion_projected(edges: DataFrame, node: str, through: str) -> DataFrame:
    """:func:`cohesion` of a projection; components, cut points and bridges are those of its skeleton, and pairs are made for flows alone."""
    x = edges.select(F.col(node).alias("node_id"), F.col(through).alias("t")).where("node_id is not null and t is not null").distinct()
    x = written(x.select("node_id", F.xxhash64("t").alias("t")), "members")

    def known(own: DataFrame, n: int) -> tuple[int, Callable[[], int]]:
        ties = x.select(F.xxhash64("node_id").alias("v"), "t").join(own.select(F.col("node").alias("v")), "v", "left_semi")
        # Who is alone in a group is joined to nobody there.
        more = ties.groupBy("t").agg(F.count("*").alias("d")).where("d > 1")
        ties = written(ties.join(more, "t", "left_semi").select("v", "t"), "ties")
        degree = graph.degrees_projected(ties, "v", "t")
        return connectivities(ties, lambda: graph.projection(ties, "v", "t").select(F.col("src").alias("a"), F.col("dst").alias("b")), degree, n)

    return _cohesion(x.select("node_id").distinct(), written(graph.skeleton(x, "node_id", "t"), "skeleton"), known)


def _cohesion(nodes: DataFrame, edges: DataFrame, known: Callable[[DataFrame, int], tuple[int, Callable[[], int]]]) -> DataFrame:
    """:func:`cohesion` of a graph with the components, cut points and bridges of ``edges``; ``known`` gives the :func:`connectivities` of a component."""
    names, pairs = blocks.numbered(nodes, edges)
    labels = written(connected_components(pairs), "labels")
    sizes = written(labels.groupBy("label").agg(F.count("*").alias("size")), "sizes")
    lone = nodes.count() - labels.count()
    parts = sizes.count() + lone
    top = sizes.orderBy(F.desc("size"), "label").limit(1).collect()
    giant = top[0]["size"] if top else min(lone, 1)
    cuts = bridge = k = e = 0
    if top:
        own = written(names.join(labels.where(F.col("label") == top[0]["label"]).select("node"), "node", "left_semi").select("node_id", "node"), "giant")
        k, more = known(own, giant)
        # Where no single node parts the component, there is no articulation point and no bridge.
        if k < 2:
            inside = edges.join(own.select(F.col("node_id").alias("src")), "src", "left_semi")
            found = blocks.blocks(own, inside)
            cuts = blocks.articulation_points(found).count()
            bridge = found.tree.where("parent is not null and low >= pre and high < pre + size").count()
            if not (cuts or k):
                raise ValueError(f"disjoint paths are for graphs of up to {MOST_TIES} members of groups")
        k, e = max(k, 1), 1 if bridge else more()
    whole = parts == 1
    row = (parts, giant, k if whole else 0, e if whole else 0, k, e, cuts, bridge)
    return nodes.sparkSession.createDataFrame([row], ", ".join(f"{c} long" for c in _COHESION))


_COHESION = ["components", "giant", "node_connectivity", "edge_connectivity", "giant_node_connectivity", "giant_edge_connectivity", "articulation_points", "bridges"]
