"""Distances, betweenness, connectivity and communities against plain loops."""

import itertools
import random

import pytest

from tessella.operators import cohesion, community, distances, graph
from tests import plain_graphs as plain
from tests.test_blocks import some_graph
from tests.test_graph import made


def measures(graph_):
    """Closeness, harmonic, eccentricity, reached, distance sum and both betweennesses by single sources."""
    n = len(graph_)
    out = {v: [0.0] * 7 for v in graph_}
    for s in graph_:
        for k, weighted in enumerate((False, True)):
            order, dist, count, before = plain.shortest(graph_, s, weighted)
            flow = dict.fromkeys(order, 0.0)
            for v in reversed(order):
                for u in before[v]:
                    flow[u] += count[u] / count[v] * (1 + flow[v])
                if v != s and n > 2:
                    out[v][5 + k] += flow[v] / ((n - 1) * (n - 2))
            far = sum(dist.values())
            if weighted:
                out[s][0] = (len(dist) - 1) / (n - 1) * (len(dist) - 1) / far if far else 0.0
                out[s][1] = sum(1 / d for d in dist.values() if d) / (n - 1) if n > 1 else 0.0
            else:
                out[s][2:5] = max(dist.values()), len(dist), far
    return out


LINE = [("a", "b", 10), ("b", "c", 10)]
TIES = [("a", "b", 2), ("b", "c", 2), ("a", "c", 1)]  # a to c: one step of 1, and two of a half


@pytest.mark.parametrize(("case", "rows"), [((TIES, ["z"]), 10**6), (some_graph(7, 30, 45), 2000), (some_graph(8, 24, 90), 10**6), (([], ["a", "b"]), 9)])
def test_path_measures_against_loops(spark, case, rows):
    edges, extra = case
    nodes, pairs = made(spark, edges, extra) if edges else (spark.createDataFrame([(x,) for x in extra], "node_id string"), spark.createDataFrame([], "src string, dst string, weight long"))
    graph_ = plain.adjacency({x for a, b, _ in edges for x in (a, b)} | set(extra), edges)
    got = {r["node_id"]: r for r in distances.path_measures(nodes, pairs, rows).collect()}
    want = measures(graph_)
    names = ["closeness", "harmonic", "eccentricity", "reached", "distance_sum", "betweenness", "weighted_betweenness"]
    assert set(got) == set(want)
    for v, w in want.items():
        assert [got[v][c] for c in names] == pytest.approx(w, abs=2e-6), v


def test_giant_paths(spark):
    nodes, pairs = made(spark, LINE, ["z"])
    g = distances.giant_paths(nodes, pairs).first()
    assert (g["size"], g["diameter"], g["radius"]) == (3, 2, 1) and g["mean_distance"] == pytest.approx(4 / 3, abs=1e-4)


def test_ranks_share_the_smallest_place(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 7.0), ("d", None), ("e", 1.0)], "node_id string, x double")
    assert {r["node_id"]: r["rank_x"] for r in distances.ranked(df, ["x"]).collect()} == {"c": 1, "a": 2, "b": 2, "e": 4, "d": 5}


def ring(n, step=(1, 2)):
    return [tuple(sorted((f"r{i:02}", f"r{(i + k) % n:02}"))) for i in range(n) for k in step]


TWO = [(a, b) for g in ("abcd", "wxyz") for a, b in itertools.combinations(g, 2)]


@pytest.mark.parametrize("pairs", [list(itertools.combinations("abcd", 2)), [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")], [("a", "b")], ring(11), ring(13, (1, 2, 3)), [*TWO, ("a", "w"), ("b", "x")], [*TWO, ("a", "w"), ("a", "x"), ("b", "x"), ("c", "y")]])
def test_connectivity_through_certificates(spark, pairs):
    graph_ = plain.adjacency({x for p in pairs for x in p}, [(*p, 1) for p in pairs])
    nodes, edges = made(spark, [(a, b, 1) for a, b in pairs])
    c = cohesion.cohesion(nodes, edges).first()
    assert (c["node_connectivity"], c["edge_connectivity"]) == plain.connectivity(graph_)


def test_certificate_is_sparse_and_keeps_connectivity(spark):
    rng = random.Random(2)
    pairs = sorted({tuple(sorted(rng.sample(range(24), 2))) for _ in range(150)})
    df = spark.createDataFrame(pairs, "a long, b long")
    thin = [tuple(r) for r in cohesion.certificate(df, 3).collect()]
    assert len(set(thin)) == len(thin) <= 3 * 23 and set(thin) <= set(pairs)
    of = lambda ps: plain.connectivity(plain.adjacency(set(range(24)), [(*p, 1) for p in ps]))
    assert [min(k, 3) for k in of(thin)] == [min(k, 3) for k in of(pairs)]


def test_cohesion_of_parts(spark):
    nodes, edges = made(spark, [("a", "x1", 1), ("b", "x1", 1), ("b", "x2", 2), ("c", "x2", 1)], ["z"])
    c = cohesion.cohesion(nodes, edges).first()
    assert tuple(c) == (2, 5, 0, 0, 1, 1, 3, 4)


RING = [(f"{g}{a}", f"{g}{b}", 1) for g in range(6) for a, b in itertools.combinations(range(5), 2)] + [(f"{g}0", f"{(g + 1) % 6}1", 1) for g in range(6)]


def planted(seed):
    rng = random.Random(seed)
    return [(f"n{a:02}", f"n{b:02}", rng.randrange(1, 4)) for a, b in itertools.combinations(range(48), 2) if rng.random() < (0.5 if a % 4 == b % 4 else 0.06)]


@pytest.mark.parametrize("edges", [RING, planted(1)])
def test_louvain_is_as_good_as_one_node_after_the_other(spark, edges):
    graph_ = plain.adjacency({x for a, b, _ in edges for x in (a, b)}, edges)
    nodes, pairs = made(spark, edges, ["alone"])
    q = lambda of: graph.modularity(pairs, of).first()["modularity"]
    found = community.detect(nodes, pairs)
    rows = plain.louvain_groups(graph_, sum(w for *_, w in edges))
    loops = spark.createDataFrame(list(rows.items()), "node_id string, community string")
    assert q(found) >= q(loops) - 0.01
    sizes = {}
    for r in found.collect():
        sizes[r["community"]] = sizes.get(r["community"], 0) + 1
    assert [sizes[f"C{i}"] for i in range(len(sizes))] == sorted(sizes.values(), reverse=True)


@pytest.mark.parametrize("method", ["louvain", "greedy", "propagation"])
def test_communities_of_cliques(spark, method):
    nodes, edges = made(spark, [(a, b, 1) for a, b in TWO] + [("d", "w", 1)], ["q"])
    of = {r["node_id"]: r["community"] for r in community.detect(nodes, edges, method).collect()}
    assert len({of[x] for x in "abcd"}) == 1 and len({of[x] for x in "wxyz"}) == 1 and of["q"] not in (of["a"], of["w"])
    assert method == "propagation" or (of["a"] != of["w"] and of["q"] == "C2")
    nodes, edges = made(spark, RING)
    of = {r["node_id"]: r["community"] for r in community.detect(nodes, edges, method).collect()}
    assert all(len({of[f"{g}{a}"] for a in range(5)}) == 1 for g in range(6))
    assert method == "propagation" or len(set(of.values())) == 6


def test_communities_of_nothing(spark):
    nodes, none = spark.createDataFrame([("a",), ("b",)], "node_id string"), spark.createDataFrame([], "src string, dst string, weight long")
    for method in community.METHODS:
        assert {tuple(r) for r in community.detect(nodes, none, method).collect()} == {("a", "C0"), ("b", "C1")}
        assert community.detect(nodes.limit(0), none, method).count() == 0


@pytest.mark.parametrize(("seed", "rows"), [(1, 1), (3, 10**6)])
def test_giant_paths_of_a_projection(spark, monkeypatch, seed, rows):
    """A long chain of days and some others, in blocks of one word and of all; two largest components in one case."""
    rng = random.Random(seed)
    ties = {(f"A:{i}", f"V:{14 * i + k}") for i in range(6) for k in range(15)} | {(f"A:{rng.randrange(20)}", f"V:{rng.randrange(50)}") for _ in range(20)}
    ties |= {(f"{a}x", f"{v}x") for a, v in ties} if seed == 3 else {("A:alone", "V:alone")}
    edges = spark.createDataFrame([(*t, 1) for t in sorted(ties)], "src string, dst string, weight long")
    want = distances.giant_paths(edges.select("dst").distinct().toDF("node_id"), graph.projection(edges, "dst", "src")).first()
    monkeypatch.setattr(graph, "projection", None)
    assert distances.giant_paths_projected(edges, "dst", "src", rows).first() == want
