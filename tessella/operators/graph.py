"""Bipartite participation graphs, their one-mode projections and topology.

Graphs are two tables: ``nodes(node_id, ...)``, which alone hold isolates, and ``edges(src, dst,
weight)`` with ``src < dst`` in one-mode graphs and author to item in bipartite ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import triples
from tessella.operators.components import connected_components
from tessella.operators.sharing import Piece, encoded, over_pieces
from tessella.operators.stats import correlation, quantiles
from tessella.scratch import written

#: Multiplications that cost as much as one open path of a join.
PRODUCTS = 3_000


def author_node(c: str) -> Column:
    """Node id of an author; the prefix keeps the two id spaces apart."""
    return F.concat(F.lit("A:"), F.col(c).cast("string"))


def item_node(c: str) -> Column:
    """Node id of an item."""
    return F.concat(F.lit("V:"), F.col(c).cast("string"))


def bipartite_edges(facts: DataFrame) -> DataFrame:
    """One edge an author and item: weight (rows), likes, and the sorted fact ids."""
    known = facts.where("author_id is not null and item_id is not null")
    return known.groupBy("author_id", "item_id").agg(
        F.count("*").alias("weight"), F.sum("likes").alias("likes"),
        F.array_join(F.transform(F.array_sort(F.collect_list("fact_id")), lambda x: x.cast("string")), "|").alias("fact_ids"),
    ).select(author_node("author_id").alias("src"), item_node("item_id").alias("dst"), "author_id", "item_id", "weight", "likes", "fact_ids")


def bipartite_nodes(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """Authors and observed items with degree, strength, likes and catalogue columns."""
    side = lambda k, raw, kind: edges.groupBy(F.col(k).alias("node_id"), F.col(raw).cast("long").alias("raw_id")).agg(
        F.lit(kind).alias("node_type"), F.count("*").alias("degree"), F.sum("weight").alias("strength"), F.sum("likes").alias("likes")
    )
    items = side("dst", "item_id", "item").join(catalog.select(F.col("item_id").cast("long").alias("raw_id"), "title", "channel_id", "category", "views"), "raw_id", "left")
    return side("src", "author_id", "author").unionByName(items, allowMissingColumns=True)


def invariants(facts: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``invariant, violations`` of a bipartite graph against its facts; all must be 0."""
    known = facts.where("author_id is not null and item_id is not null")
    f = known.agg(F.count("*").alias("rows"), F.count_distinct("author_id").alias("authors"), F.count_distinct("item_id").alias("items"), F.count_distinct("author_id", "item_id").alias("pairs"))
    e = edges.agg(
        F.count("*").alias("edges"), F.coalesce(F.sum("weight"), F.lit(0)).alias("mass"), F.count(F.when(F.col("weight") < 1, 1)).alias("light"),
        F.count(F.when(~F.col("src").startswith("A:") | ~F.col("dst").startswith("V:"), 1)).alias("crossed"),
    )
    n = nodes.agg(
        F.count("*").alias("nodes"), F.count_distinct("node_id").alias("ids"), F.count(F.when(F.col("node_type") == "author", 1)).alias("na"),
        F.count(F.when(F.col("node_type") == "item", 1)).alias("nv"), F.count(F.when(F.col("degree") < 1, 1)).alias("isolates"),
        F.coalesce(F.sum("strength"), F.lit(0)).alias("strength"),
    )
    one = f.crossJoin(e).crossJoin(n)  # three single rows
    checks = {
        "weights_sum_to_rows": F.abs(F.col("mass") - F.col("rows")), "edges_are_pairs": F.abs(F.col("edges") - F.col("pairs")),
        "author_nodes_are_authors": F.abs(F.col("na") - F.col("authors")), "item_nodes_are_items": F.abs(F.col("nv") - F.col("items")),
        "node_ids_unique": F.col("nodes") - F.col("ids"), "edges_cross_sides": F.col("crossed"), "weights_positive": F.col("light"),
        "no_isolates": F.col("isolates"), "strength_is_twice_weight": F.abs(F.col("strength") - 2 * F.col("mass")),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("invariant"), v.cast("long").alias("violations")) for k, v in checks.items()))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def _pairs(piece: Piece) -> Iterator[pa.RecordBatch]:
    for u, v, w in piece.pairs():
        for i in range(0, len(u), 100_000):
            part = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([piece.names.take(pa.array(u[part])), piece.names.take(pa.array(v[part])), pa.array(w[part])], ["src", "dst", "weight"])


def projection(edges: DataFrame, node: str, through: str) -> DataFrame:
    """One-mode edges: pairs of ``node`` values that share ``through`` values, weighted by how many.

    The weight counts shared neighbours and ignores how often. The output itself grows with the
    square of a neighbour's degree; it is made in pieces that hold all of a pair, and not shuffled.
    """
    kind = edges.schema[node].dataType.simpleString()
    return over_pieces(edges, node, through, _pairs, f"src {kind}, dst {kind}, weight long")


def skeleton(edges: DataFrame, node: str, through: str) -> DataFrame:
    """``src, dst, weight`` with the components, cut points and bridges of :func:`projection`, in at most two edges a bipartite one.

    A projection is made of cliques. In place of a clique all its members are tied to its two smallest,
    and those to each other: from three members on that too stays joined whichever member or edge
    is taken away, and two members have their one edge. Weights are 1; degrees are not the projection's.
    """
    x = edges.select(F.col(node).alias("n"), F.col(through).alias("t")).distinct()
    first = x.groupBy("t").agg(F.min("n").alias("first"))
    rest = x.join(first, "t").where("n > first")
    second = rest.groupBy("t").agg(F.min("n").alias("second"))
    ties = rest.join(second, "t").select(F.explode(F.array("first", "second")).alias("src"), F.col("n").alias("dst"))
    return ties.where("src <> dst").distinct().withColumn("weight", F.lit(1).cast("long"))


def projection_near(edges: DataFrame, node: str, through: str, ends: DataFrame) -> DataFrame:
    """Of :func:`projection`, the edges that have an end in ``ends(node_id)``."""
    x = edges.select(F.col(node).alias("n"), F.col(through).alias("t")).distinct()
    mine = x.join(ends.select(F.col("node_id").alias("n")).distinct(), "n", "left_semi").withColumn("mine", F.lit(True))
    x = x.join(mine, ["n", "t"], "left").select(F.col("n").alias("m"), "t", F.col("mine").isNotNull().alias("both"))
    pairs = mine.select("n", "t").join(x, "t").where("n <> m and (not both or n < m)")
    return pairs.groupBy(F.least("n", "m").alias("src"), F.greatest("n", "m").alias("dst")).agg(F.count("*").alias("weight"))


def verify_projection(edges: DataFrame, projected: DataFrame, node: str, through: str) -> DataFrame:
    """``check, violations``: weights against shared neighbours, counted pair by pair, and no pair missing.

    Each pair's first node brings its neighbours, and those that the second has too are counted; no
    node's neighbours are gathered.
    """
    own = edges.select(F.col(node).alias("src"), F.col(through).alias("t")).distinct()
    shared = projected.select("src", "dst").join(own, "src").join(own.select(F.col("src").alias("dst"), "t"), ["dst", "t"], "left_semi")
    shared = shared.groupBy("src", "dst").agg(F.count("*").alias("k"))
    wrong = projected.join(shared, ["src", "dst"], "left").agg(
        F.count(F.when(F.coalesce("k", F.lit(0)) != F.col("weight"), 1)).alias("wrong"),
        F.coalesce(F.sum("weight"), F.lit(0)).alias("mass"), F.count(F.when(F.col("src") >= F.col("dst"), 1)).alias("order"),
    )
    return _checks(wrong, edges, node, through)


def _checks(wrong: DataFrame, edges: DataFrame, node: str, through: str) -> DataFrame:
    """``check, violations`` from one row ``wrong, mass, order``."""
    # Every neighbour of degree d adds d (d - 1) / 2 to the weights.
    due = edges.groupBy(through).agg(F.count_distinct(node).alias("d")).agg(F.coalesce(F.sum(F.col("d") * (F.col("d") - 1) / 2), F.lit(0)).cast("long").alias("due"))
    one = wrong.crossJoin(due)  # two single rows
    rows = {"weights_are_intersections": F.col("wrong"), "cliques_complete": F.abs(F.col("mass") - F.col("due")), "canonical_order": F.col("order")}
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), v.cast("long").alias("violations")) for k, v in rows.items()))).alias("r")).select("r.*")


def _checked(piece: Piece) -> Iterator[pa.RecordBatch]:
    wrong = mass = order = 0
    for u, v, w in piece.pairs():
        wrong += int(np.count_nonzero(piece.shared(u, v) != w))
        mass += int(w.sum())
        order += int(np.count_nonzero(u >= v))
    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (wrong, mass, order)], ["wrong", "mass", "order"])


def verify_made(edges: DataFrame, node: str, through: str) -> DataFrame:
    """:func:`verify_projection` of :func:`projection`, pair by pair in the tasks that make the pairs."""
    sums = over_pieces(edges, node, through, _checked, "wrong long, mass long, order long")
    return _checks(sums.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums.columns)), edges, node, through)


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end."""
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, degree, strength``; isolates have zeros."""
    d = both_ways(edges).groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.select("node_id").join(d, "node_id", "left").select("node_id", zero("degree"), zero("strength"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, component``: the smallest node id of the component; works for any id type."""
    numbered = nodes.select("node_id", F.xxhash64("node_id").alias("h"))
    label = connected_components(edges.select(F.xxhash64("src").alias("a"), F.xxhash64("dst").alias("b")))
    placed = numbered.join(label, F.col("h") == F.col("node"), "left").select("node_id", F.coalesce("label", "h").alias("l"))
    least = placed.groupBy("l").agg(F.min("node_id").alias("component"))
    return placed.join(least, "l").select("node_id", "component")


def component_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``component, size``."""
    return components(nodes, edges).groupBy("component").agg(F.count("*").alias("size"))


def _triangles(edges: DataFrame) -> DataFrame:
    """Each triangle once, with its three weights.

    Edges go from the end with fewer edges to the one with more, ties by id, so no node starts more
    than about the root of twice the edges, and a hub makes no square of its degree in open paths.
    """
    e = edges.select("src", "dst", "weight")
    d = e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    e = e.join(d.toDF("src", "ds"), "src").join(d.toDF("dst", "dd"), "dst")
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    e = e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"), "weight")
    e = written(e, "oriented")
    ab, ac, bc = e.toDF("a", "b", "w1"), e.toDF("a", "c", "w2"), e.toDF("b", "c", "w3")
    # Both other corners lie above the first; the edge between them closes the triangle either way round.
    return ab.join(ac, "a").join(bc, ["b", "c"])


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, triangles, clustering, weighted_clustering`` (geometric mean of scaled weights)."""
    top = edges.agg(F.max("weight").alias("m"))  # one row
    t = _triangles(edges).crossJoin(F.broadcast(top))
    t = t.select(F.explode(F.array("a", "b", "c")).alias("node_id"), F.cbrt(F.col("w1") / F.col("m") * F.col("w2") / F.col("m") * F.col("w3") / F.col("m")).alias("g"))
    return _clustered(degrees(nodes, edges), t.groupBy("node_id").agg(F.count("*").alias("t"), F.sum("g").alias("g")))


def _clustered(d: DataFrame, per: DataFrame) -> DataFrame:
    """From ``node_id, degree`` of all nodes, and of those in triangles their number ``t`` and the weighted sum ``g``."""
    out = d.join(per, "node_id", "left")
    pairs = F.nullif(F.col("degree") * (F.col("degree") - 1) / 2.0, F.lit(0.0))
    safe = lambda c: F.coalesce(F.col(c) / pairs, F.lit(0.0))
    return out.select("node_id", "degree", F.coalesce("t", F.lit(0)).alias("triangles"), F.round(safe("t"), 6).alias("clustering"), F.round(safe("g"), 6).alias("weighted_clustering"))


def _pair_sums(piece: Piece) -> Iterator[pa.RecordBatch]:
    n = len(piece.names)
    degree, strength, top = (np.zeros(n, np.int64) for _ in range(3))
    for u, v, w in piece.pairs():
        for x in (u, v):
            degree += np.bincount(x, minlength=n)
            strength += np.bincount(x, w, n).astype(np.int64)
            np.maximum.at(top, x, w)
    yield pa.RecordBatch.from_arrays([piece.names, *(pa.array(x) for x in (degree, strength, top))], ["node_id", "degree", "strength", "top"])


def degrees_projected(edges: DataFrame, node: str, through: str) -> DataFrame:
    """:func:`degrees` of a projection and ``top``, a node's largest weight; pairs are summed where they are made."""
    kind = edges.schema[node].dataType.simpleString()
    sums = over_pieces(edges, node, through, _pair_sums, f"node_id {kind}, degree long, strength long, top long")
    sums = sums.groupBy("node_id").agg(F.sum("degree").alias("degree"), F.sum("strength").alias("strength"), F.max("top").alias("top"))
    nodes = edges.select(F.col(node).alias("node_id")).where("node_id is not null").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return written(nodes.join(sums, "node_id", "left").select("node_id", zero("degree"), zero("strength"), zero("top")), "degrees")


def components_projected(edges: DataFrame, node: str, through: str) -> DataFrame:
    """:func:`components` of a projection, on its skeleton."""
    nodes = edges.select(F.col(node).alias("node_id")).where("node_id is not null").distinct()
    return written(components(nodes, skeleton(edges, node, through)), "components")


def clustering_projected(edges: DataFrame, node: str, through: str, d: DataFrame | None = None, parts: DataFrame | None = None) -> DataFrame:
    """:func:`clustering` of a projection, of which neither pairs nor triangles are written or shuffled.

    ``d`` and ``parts`` are its degrees and components where they are known already. Only where parts
    are so sparse that products of their matrices cost more than open paths is the projection made.
    """
    d = degrees_projected(edges, node, through) if d is None else d
    parts = components_projected(edges, node, through) if parts is None else parts
    paths = d.agg(F.sum(F.col("degree") * F.col("degree").cast("double")).alias("x"), F.max("top").alias("m")).first()
    products = parts.groupBy("component").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n") * F.col("n"))).first()[0] or 0.0
    if products > PRODUCTS * (paths["x"] or 0.0):
        return clustering(d.select("node_id"), written(projection(edges, node, through), "projection"))
    t = triples.triangles(edges, node, through, parts)
    return _clustered(d, t.select("node_id", F.col("many").alias("t"), (F.col("roots") / F.lit(float(paths["m"] or 1))).alias("g")))


def _latapy_sums(piece: Piece) -> Iterator[pa.RecordBatch]:
    n, d = len(piece.names), piece.degree
    total, many = np.zeros(n), np.zeros(n, np.int64)
    for u, v, w in piece.pairs():
        share = w / (d[u] + d[v] - w)
        for x in (u, v):
            total += np.bincount(x, share, n)
            many += np.bincount(x, minlength=n)
    yield pa.RecordBatch.from_arrays([piece.names, pa.array(total), pa.array(many)], ["node_id", "total", "many"])


def latapy(edges: DataFrame, node: str, through: str) -> DataFrame:
    """``node_id, latapy``: mean over nodes two steps away of shared over united neighbours; pairs are summed where they are made."""
    kind = edges.schema[node].dataType.simpleString()
    sums = over_pieces(edges, node, through, _latapy_sums, f"node_id {kind}, total double, many long")
    per = sums.groupBy("node_id").agg(F.sum("total").alias("total"), F.sum("many").alias("many"))
    return per.select("node_id", F.round(F.coalesce(F.col("total") / F.nullif("many", F.lit(0)), F.lit(0.0)), 6).alias("latapy"))


def topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of whole-graph measures of a one-mode graph."""
    d = degrees(nodes, edges)
    ends = both_ways(edges).join(d.select(F.col("node_id").alias("src"), F.col("degree").alias("x")), "src").join(d.select(F.col("node_id").alias("dst"), F.col("degree").alias("y")), "dst")
    return _topology(d, clustering(nodes, edges), component_sizes(nodes, edges), ends.agg(correlation(F.col("x"), F.col("y")).alias("r")))


def _topology(d: DataFrame, clustered: DataFrame, sizes: DataFrame, r: DataFrame) -> DataFrame:
    """The row from degrees, clustering, component sizes and one row ``r``, the correlation of degrees along edges."""
    c = clustered.agg(F.round(F.avg("clustering"), 4).alias("mean_clustering"), F.round(F.avg("weighted_clustering"), 4).alias("mean_weighted_clustering"), (F.sum("triangles") / 3).cast("long").alias("triangles"))
    s = sizes.agg(F.count("*").alias("components"), F.max("size").alias("giant"), F.count(F.when(F.col("size") == 2, 1)).alias("pairs"), F.count(F.when(F.col("size") == 1, 1)).alias("isolates"))
    deg = d.agg(
        F.count("*").alias("n"), (F.sum("degree") / 2).cast("long").alias("m"), (F.sum("strength") / 2).cast("long").alias("total_weight"), F.round(F.avg("degree"), 4).alias("mean_degree"),
        F.median("degree").alias("median_degree"), F.percentile("degree", F.lit(0.9)).alias("p90_degree"), F.max("degree").alias("max_degree"),
        F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("triples"), F.round(100 * F.avg((F.col("degree") == 1).cast("double")), 2).alias("pct_degree_1"),
    )
    one = deg.crossJoin(c).crossJoin(s).crossJoin(r.select(F.round("r", 4).alias("assortativity")))  # four single rows
    n = F.col("n")
    return one.select(
        "n", "m", "total_weight", F.round(2 * F.col("m") / F.nullif(n * (n - 1.0), F.lit(0.0)), 6).alias("density"), "mean_degree", "median_degree", "p90_degree", "max_degree", "pct_degree_1",
        F.round(F.coalesce(3 * F.col("triangles") / F.nullif("triples", F.lit(0.0)), F.lit(0.0)), 4).alias("transitivity"), "mean_clustering", "mean_weighted_clustering",
        "assortativity", "components", "giant", F.round(100 * F.col("giant") / n, 2).alias("pct_giant"), "pairs", "isolates",
    )


def _bytes(c: Column) -> Column:
    """A long that is not negative in eight bytes, in its order."""
    return F.unhex(F.lpad(F.hex(c), 16, "0"))


def _along_edges(edges: DataFrame, node: str, through: str, d: DataFrame) -> DataFrame:
    """One row ``r``, the correlation of degrees along a projection's edges; pairs are summed where they are made."""
    mean = d.agg(F.floor(F.sum(F.col("degree") * F.col("degree")) / F.nullif(F.sum("degree"), F.lit(0))).alias("x")).first()["x"] or 0  # of the ends, so that sums are small

    def products(piece: Piece) -> Iterator[pa.RecordBatch]:
        degree = np.frombuffer(b"".join(piece.names.to_pylist()), ">i8").reshape(-1, 2)[:, 0].astype(np.float64) - mean
        yield pa.RecordBatch.from_arrays([pa.array([float(sum(np.dot(degree[u], degree[v]) for u, v, _ in piece.pairs()))])], ["p"])

    x = edges.select(F.col(node).alias("node_id"), F.col(through).alias("t")).join(d.select("node_id", "degree"), "node_id")
    both = over_pieces(x.select(F.concat(_bytes(F.col("degree")), _bytes(F.xxhash64("node_id"))).alias("n"), "t"), "n", "t", products, "p double")
    k, y = F.col("degree").cast("double"), F.col("degree").cast("double") - F.lit(float(mean))
    ends = d.agg(F.sum(k).alias("k"), F.sum(k * y).alias("a"), F.sum(k * y * y).alias("b"))
    one = ends.crossJoin(both.agg(F.sum("p").alias("p")))  # two single rows
    centred = lambda c: F.col(c) * F.col("k") - F.col("a") * F.col("a")
    return one.withColumn("p", 2 * F.col("p")).select((centred("p") / F.nullif(centred("b"), F.lit(0.0))).alias("r"))


def topology_projected(edges: DataFrame, node: str, through: str, d: DataFrame) -> DataFrame:
    """:func:`topology` of a projection with degrees ``d``, by way of its pieces and triples; pairs are not written."""
    parts = components_projected(edges, node, through)
    clustered = written(clustering_projected(edges, node, through, d, parts), "clustering")
    return _topology(d, clustered, parts.groupBy("component").agg(F.count("*").alias("size")), _along_edges(edges, node, through, d))


def bipartite_density(edges: DataFrame) -> DataFrame:
    """One row ``authors, items, edges, density``."""
    return edges.agg(F.count_distinct("src").alias("authors"), F.count_distinct("dst").alias("items"), F.count("*").alias("edges")).select(
        "authors", "items", "edges", F.round(F.col("edges") / (F.col("authors") * F.col("items")), 6).alias("density")
    )


def modularity(edges: DataFrame, partition: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row ``communities, modularity, modularity_unweighted``; ``partition(node_id, community)``."""
    p = partition.select("node_id", "community")
    x = edges.join(p.toDF("src", "cs"), "src").join(p.toDF("dst", "cd"), "dst")
    inner = x.where("cs = cd").groupBy(F.col("cs").alias("c")).agg(F.sum("weight").alias("lw"), F.count("*").alias("l"))
    ends = x.select(F.explode(F.array("cs", "cd")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("kw"), F.count("*").alias("k"))
    m = edges.agg(F.sum("weight").alias("mw"), F.count("*").alias("m"))  # one row
    y = ends.join(inner, "c", "left").crossJoin(F.broadcast(m))
    q = lambda low, k, t: F.sum(F.coalesce(F.col(low), F.lit(0)) / F.col(t) - resolution * F.pow(F.col(k) / (2 * F.col(t)), F.lit(2)))
    sums = y.agg(F.round(q("lw", "kw", "mw"), 5).alias("modularity"), F.round(q("l", "k", "m"), 5).alias("modularity_unweighted"))
    return p.agg(F.count_distinct("community").alias("communities")).crossJoin(sums)


def _by_community(piece: Piece) -> Iterator[pa.RecordBatch]:
    community, names = encoded(pc.binary_slice(piece.names.cast(pa.binary()), 0, 8))
    k = len(names)
    lw, lone, kw, many = (np.zeros(k, np.int64) for _ in range(4))
    for u, v, w in piece.pairs():
        a, b = community[u], community[v]
        for c in (a, b):
            kw += np.bincount(c, w, k).astype(np.int64)
            many += np.bincount(c, minlength=k)
        own = a == b
        lw += np.bincount(a[own], w[own], k).astype(np.int64)
        lone += np.bincount(a[own], minlength=k)
    yield pa.RecordBatch.from_arrays([names, pa.array(lw), pa.array(lone), pa.array(kw), pa.array(many)], ["c", "lw", "l", "kw", "k"])


def modularity_projected(edges: DataFrame, node: str, through: str, partition: DataFrame, resolution: float = 1.0) -> DataFrame:
    """:func:`modularity` of a projection, whose pairs are summed by community where they are made; ``partition`` holds every node."""
    p = partition.select("node_id", "community")
    code = lambda c: F.unhex(F.lpad(F.hex(F.xxhash64(c)), 16, "0"))
    x = edges.select(F.col(node).alias("node_id"), F.col(through).alias("t")).join(p, "node_id")
    x = x.select(F.concat(code("community"), code("node_id")).alias("n"), "t")
    y = over_pieces(x, "n", "t", _by_community, "c binary, lw long, l long, kw long, k long")
    y = y.groupBy("c").agg(*(F.sum(c).alias(c) for c in ("lw", "l", "kw", "k"))).where("k > 0")
    y = written(y, "sums")  # as many rows as communities
    m = y.agg((F.sum("kw") / 2).alias("mw"), (F.sum("k") / 2).alias("m"))  # one row
    q = lambda low, k, t: F.sum(F.col(low) / F.col(t) - resolution * F.pow(F.col(k) / (2 * F.col(t)), F.lit(2)))
    sums = y.crossJoin(F.broadcast(m)).agg(F.round(q("lw", "kw", "mw"), 5).alias("modularity"), F.round(q("l", "k", "m"), 5).alias("modularity_unweighted"))
    return p.agg(F.count_distinct("community").alias("communities")).crossJoin(sums)


def core_subgraph(edges: DataFrame) -> DataFrame:
    """Edges of authors with more than one item."""
    active = edges.groupBy("src").agg(F.count("*").alias("d")).where("d > 1").select("src")
    return edges.join(active, "src", "left_semi")


def _kind() -> Column:
    """What a member of a small component is."""
    return F.when(F.col("degree") == 0, "isolate").when(F.col("size") == 2, "pair").when(F.col("degree") == 1, "leaf").otherwise("member").alias("kind")


def _outer(label: DataFrame, small: int) -> DataFrame:
    """``component, node_id, size`` of the members of small components."""
    sizes = label.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") <= small)
    return label.join(sizes, "component")


def peripheral(nodes: DataFrame, edges: DataFrame, small: int = 5) -> DataFrame:
    """Members of small components, with size, degree and kind: isolate, pair, leaf or member."""
    return _outer(components(nodes, edges), small).join(degrees(nodes, edges), "node_id").select("node_id", "component", "size", "degree", _kind())


def peripheral_projected(edges: DataFrame, node: str, through: str, small: int = 5) -> DataFrame:
    """:func:`peripheral` of a projection, of which only the small components are made."""
    nodes = edges.select(F.col(node).alias("node_id")).distinct()
    outer = written(_outer(components(nodes, skeleton(edges, node, through)), small), "outer")
    inside = edges.join(outer.select(F.col("node_id").alias(node)), node, "left_semi")
    return outer.join(degrees(outer, projection(inside, node, through)), "node_id").select("node_id", "component", "size", "degree", _kind())


def _held_alone(piece: Piece) -> Iterator[pa.RecordBatch]:
    alone = np.zeros(len(piece.through), np.int64)
    for key, by in piece.meetings():
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate(([True], key[1:] != key[:-1], [True]))
        alone += np.bincount(by[order[new[:-1] & new[1:]]], minlength=len(alone))
    some = np.flatnonzero(alone)
    yield pa.RecordBatch.from_arrays([piece.through.take(pa.array(some)), pa.array(alone[some])], ["src", "k"])


def bridge_authors(edges: DataFrame, catalog: DataFrame, communities: DataFrame | None = None) -> DataFrame:
    """Per author: items, channels, communities touched, and what the item projection loses without them.

    Taking an author away lowers the weight of each of their item pairs by one; pairs at zero vanish,
    and are counted where pairs are made. Components are counted for all authors at once, as parts of
    the bipartite graph that hang together in its articulation points only.
    """
    from tessella.operators import blocks  # which needs this module

    by = edges.select("src", "dst").join(catalog.select(item_node("item_id").alias("dst"), "channel_id"), "dst", "left")
    if communities is not None:
        by = by.join(communities.select(F.col("node_id").alias("dst"), "community"), "dst", "left")
    else:
        by = by.withColumn("community", F.lit(None).cast("string"))
    base = by.join(edges.select("src", "dst", "weight"), ["src", "dst"]).groupBy("src").agg(
        F.sum("weight").alias("n_rows"), F.count("*").alias("n_items"), F.count_distinct("channel_id").alias("n_channels"),
        F.count_distinct("community").alias("n_communities"), F.array_join(F.array_sort(F.collect_set("dst")), "|").alias("items"),
    )
    # Without an author, the projection is that of the bipartite graph without this node: it falls into the parts that this one does.
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    found = blocks.blocks(nodes, edges)
    delta = blocks.articulation_points(found).join(found.names, "node").select(F.col("node_id").alias("src"), (F.col("n_blocks") - 1).alias("delta_components"))
    # An author alone holds a pair of weight one.
    single = over_pieces(edges, "dst", "src", _held_alone, f"src {edges.schema['src'].dataType.simpleString()}, k long")
    count = single.groupBy("src").agg(F.sum("k").alias("lost_edges"))
    out = base.join(delta, "src", "left").join(count, "src", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        F.col("src").alias("author"), "n_rows", "n_items", "n_channels", "n_communities", "items", zero("delta_components"), zero("lost_edges"),
        (F.coalesce("delta_components", F.lit(0)) > 0).alias("is_bridge"), (F.col("n_rows") > 1).alias("is_recurrent"), (F.col("n_channels") > 1).alias("is_multichannel"),
    )


def community_profile(edges: DataFrame, items: DataFrame, partition: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row a community of items: size, channels, rows, authors, likes, views, inner edges."""
    info = partition.join(catalog.withColumn("node_id", item_node("item_id")), "node_id", "left")
    base = info.groupBy("community").agg(
        F.count("*").alias("n_items"), F.count_distinct("channel_id").alias("n_channels"), F.array_join(F.array_sort(F.collect_set("channel_id")), " || ").alias("channels"),
        F.array_join(F.array_sort(F.collect_set("category")), " || ").alias("categories"), F.round(F.sum("views"), 2).alias("views"),
    )
    base = base.join(quantiles(info, "views", "community", {"m": 0.5}).select("community", F.round("m", 3).alias("median_views")), "community", "left")
    seen = edges.join(partition.select(F.col("node_id").alias("dst"), "community"), "dst")
    per = seen.groupBy("community", "src").agg(F.sum("weight").alias("w"), F.count("*").alias("k"), F.sum("likes").alias("l"))
    per = per.groupBy("community").agg(F.sum("w").alias("n_rows"), F.count("*").alias("n_authors"), F.count(F.when(F.col("k") > 1, 1)).alias("n_multi_item_authors"), F.sum("l").alias("likes"))
    side = lambda c: partition.select(F.col("node_id").alias(c), F.col("community").alias(f"c{c}"))
    inner = items.join(side("src"), "src").join(side("dst"), "dst").where("csrc = cdst").groupBy(F.col("csrc").alias("community")).agg(F.count("*").alias("inner_edges"), F.sum("weight").alias("inner_weight"))
    out = base.join(per, "community", "left").join(inner, "community", "left")
    n, zero = F.col("n_items"), lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        "community", "n_items", (n == 1).alias("is_singleton"), "n_channels", "channels", "categories", "views", "median_views", zero("n_rows"), zero("n_authors"), zero("n_multi_item_authors"), zero("likes"),
        F.round(F.col("n_rows") / F.col("n_authors"), 3).alias("rows_per_author"), F.round(F.coalesce("n_rows", F.lit(0)) / n, 2).alias("rows_per_item"), zero("inner_edges"), zero("inner_weight"),
        F.round(2 * F.coalesce("inner_edges", F.lit(0)) / F.nullif(n * (n - 1.0), F.lit(0.0)), 4).alias("inner_density"),
    )
