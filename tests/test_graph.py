"""Graph operators on small graphs and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import blocks, centrality, graph
from tessella.operators.components import connected_components


def made(spark, edges, extra=()):
    """Nodes and edges from (a, b, weight), with isolates."""
    names = sorted({x for a, b, _ in edges for x in (a, b)} | set(extra))
    return spark.createDataFrame([(x,) for x in names], "node_id string"), spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in edges], "src string, dst string, weight long")


STARS = [("a", "x1", 1), ("b", "x1", 1), ("b", "x2", 2), ("c", "x2", 1)]


def test_components_brute_force(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    parent = list(range(300))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: root(x) for x in touched}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bipartite_and_projection(spark):
    facts = spark.createDataFrame([(i, a, v, 1) for i, (a, v) in enumerate([(1, 7)] * 5 + [(1, 8), (2, 7), (2, 8), (3, 9), (None, 7)])], "fact_id long, author_id long, item_id int, likes long")
    catalog = spark.createDataFrame([(7, "t", "c", "k", 1.0), (8, "t", "c", "k", 1.0), (9, "t", "d", "k", 1.0)], "item_id int, title string, channel_id string, category string, views double")
    edges = graph.bipartite_edges(facts)
    assert {(r["src"], r["dst"]): r["weight"] for r in edges.collect()} == {("A:1", "V:7"): 5, ("A:1", "V:8"): 1, ("A:2", "V:7"): 1, ("A:2", "V:8"): 1, ("A:3", "V:9"): 1}
    nodes = graph.bipartite_nodes(edges, catalog)
    assert graph.invariants(facts, edges, nodes).where("violations <> 0").count() == 0
    authors = graph.projection(edges, "src", "dst")
    assert [tuple(r) for r in authors.collect()] == [("A:1", "A:2", 2)]
    assert graph.verify_projection(edges, authors, "src", "dst").where("violations <> 0").count() == 0


def test_bridge_author(spark):
    edges = spark.createDataFrame([("A:1", "V:1", 1, 1), ("A:1", "V:2", 2, 1), ("A:2", "V:2", 2, 1), ("A:3", "V:1", 1, 1)], "src string, dst string, item_id int, weight long")
    catalog = spark.createDataFrame([(1, "c"), (2, "d")], "item_id int, channel_id string")
    got = {r["author"]: (r["delta_components"], r["lost_edges"], r["is_bridge"]) for r in graph.bridge_authors(edges, catalog).collect()}
    assert got == {"A:1": (1, 1, True), "A:2": (0, 0, False), "A:3": (0, 0, False)}


def test_topology_of_a_triangle_with_tail(spark):
    nodes, edges = made(spark, [("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("c", "d", 1)], ["e"])
    t = graph.topology(nodes, edges).first()
    assert (t["n"], t["m"], t["components"], t["isolates"], t["giant"]) == (5, 4, 2, 1, 4)
    assert t["transitivity"] == pytest.approx(3 / 5) and t["density"] == pytest.approx(0.4)
    assert {r["node_id"] for r in graph.peripheral(nodes, edges).where("kind = 'isolate'").collect()} == {"e"}


def test_pagerank_sums_to_one(spark):
    nodes, edges = made(spark, STARS, ["z"])
    got = centrality.pagerank(nodes, edges).collect()
    assert sum(r["pagerank"] for r in got) == pytest.approx(1, abs=1e-4) and len(got) == 6


def test_k_core(spark):
    nodes, edges = made(spark, [("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("c", "d", 1)], ["e"])
    assert {r["node_id"]: r["core"] for r in centrality.k_core(nodes, edges).collect()} == {"a": 2, "b": 2, "c": 2, "d": 1, "e": 0}


def test_eigenvector(spark):
    nodes, edges = made(spark, [("a", "b", 1), ("b", "c", 1)])
    x = {r["node_id"]: r["eigenvector"] for r in centrality.eigenvector(nodes, edges).collect()}
    assert x["b"] == pytest.approx(2**-0.5, abs=1e-3) and x["a"] == pytest.approx(0.5, abs=1e-3)
    nodes, edges = made(spark, [("a", "b", 1)], ["z"])
    assert centrality.eigenvector(nodes, edges).where("eigenvector is not null").count() == 0


def test_bridge_authors_against_removal(spark):
    """Every author taken away in turn, and components counted anew."""
    rng = random.Random(11)
    for items, authors in ((14, 9), (30, 40), (6, 12)):
        seen = sorted({(rng.randrange(authors), rng.randrange(items)) for _ in range(int(items * 1.7))})
        rows = [(f"A:{a}", f"V:{v}", 1) for a, v in seen]
        edges = spark.createDataFrame(rows, "src string, dst string, weight long")
        catalog = spark.createDataFrame([(v, f"c{v % 3}") for v in range(items)], "item_id int, channel_id string")

        def parts(without, seen=seen):
            """Components of the items, and item pairs, without one author."""
            pairs = {(v, w) for a, v in seen for b, w in seen if a == b and a != without and v < w}
            of = {v: v for _, v in seen}
            for _ in of:
                for v, w in pairs:
                    of[v] = of[w] = min(of[v], of[w])
            return len(set(of.values())), len(pairs)

        whole, pairs = parts(None)
        want = {f"A:{a}": (parts(a)[0] - whole, pairs - parts(a)[1]) for a, _ in seen}
        assert {r["author"]: (r["delta_components"], r["lost_edges"]) for r in graph.bridge_authors(edges, catalog).collect()} == want


def test_pagerank_and_cores_against_plain_loops(spark):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(25)]
    pairs = sorted({tuple(sorted(rng.sample(names[:22], 2))) for _ in range(60)})
    nodes = spark.createDataFrame([(n,) for n in names], "node_id string")
    edges = spark.createDataFrame([(a, b, rng.randrange(1, 5)) for a, b in pairs], "src string, dst string, weight long")
    weight = {}
    for a, b, w in edges.collect():
        weight[a, b] = weight[b, a] = w
    out = {n: sum(w for (a, _), w in weight.items() if a == n) for n in names}
    rank = dict.fromkeys(names, 1 / 25)
    for _ in range(200):
        lost = sum(rank[n] for n in names if not out[n])
        rank = {n: 0.85 * (sum(rank[a] * w / out[a] for (a, b), w in weight.items() if b == n) + lost / 25) + 0.15 / 25 for n in names}
    got = {r["node_id"]: r["pagerank"] for r in centrality.pagerank(nodes, edges, tolerance=1e-9).collect()}
    assert got == pytest.approx(rank, abs=2e-6)
    core, left, k = {}, set(names), 0
    while left:
        low = [n for n in left if sum(b in left for a, b in weight if a == n) <= k]
        core |= dict.fromkeys(low, k)
        left -= set(low)
        k += not low
    assert {r["node_id"]: r["core"] for r in centrality.k_core(nodes, edges).collect()} == core


def test_skeleton_keeps_parts_points_and_bridges(spark):
    """Against the whole projection, on a random graph with cliques of all sizes; the skeleton stays linear."""
    rng = random.Random(8)
    for cells, people in ((45, 40),):
        rows = {(f"A:{c:03d}", f"V:{rng.randrange(people):03d}") for c in range(cells) for _ in range(rng.choice([1, 2, 2, 2, 3, 5]))}
        e = spark.createDataFrame([(a, v, 1) for a, v in sorted(rows)], "src string, dst string, weight long")
        nodes, whole, thin = e.select(F.col("dst").alias("node_id")).distinct(), graph.projection(e, "dst", "src"), graph.skeleton(e, "dst", "src")
        assert sorted(map(tuple, graph.components(nodes, thin).collect())) == sorted(map(tuple, graph.components(nodes, whole).collect()))
        assert sorted(map(tuple, blocks.bridges(nodes, thin).collect())) == sorted(map(tuple, blocks.bridges(nodes, whole).collect()))
        found = blocks.blocks(nodes, thin)
        near = graph.projection_near(e, "dst", "src", blocks.cut_points(nodes, thin, found))
        assert sorted(map(tuple, blocks.articulation_removal(nodes, near, found).collect())) == sorted(map(tuple, blocks.articulation_removal(nodes, whole).collect()))
        assert sorted(map(tuple, graph.peripheral_projected(e, "dst", "src").collect())) == sorted(map(tuple, graph.peripheral(nodes, whole).collect()))
    crowd = spark.createDataFrame([("A:1", f"V:{i}", 1) for i in range(500)], "src string, dst string, weight long")
    assert graph.skeleton(crowd, "dst", "src").count() == 997


def test_projection_is_dealt_out_by_node(spark):
    """A table of few bytes makes its pairs in many tasks."""
    e = spark.createDataFrame([(f"A:{i}", f"V:{i % 2}", 1) for i in range(60)], "src string, dst string, weight long")
    pairs = graph.projection(e, "src", "dst")
    assert "REPARTITION_BY_NUM" in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 2 * 30 * 29 // 2


def test_core_numbers_take_no_round_a_level(spark, monkeypatch):
    """Cliques of ten sizes are ten levels; their nodes' bounds are their cores from the start."""
    rounds, kept = [], centrality.written
    monkeypatch.setattr(centrality, "written", lambda df, tag: rounds.append(tag) or kept(df, tag))
    rows = [(f"c{k:02}n{i:02}", f"c{k:02}n{j:02}", 1) for k in range(2, 12) for i in range(k) for j in range(i + 1, k)]
    nodes, edges = made(spark, rows)
    assert {r["node_id"]: r["core"] for r in centrality.k_core(nodes, edges).collect()} == {f"c{k:02}n{i:02}": k - 1 for k in range(2, 12) for i in range(k)}
    assert len(rounds) < 10
