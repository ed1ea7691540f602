"""Connectivity by fans, of graphs and of projections that are not made, against plain flows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import blocks, cohesion, fans, graph
from tests import plain_graphs as plain


def all_joined(seed):
    """Groups of which some hang together in few members."""
    rng = random.Random(seed)
    n = rng.randrange(8, 20)
    half = [range(n // 2 + 2), range(n // 2 - 1, n)]
    return [rng.sample(half[i % 2], rng.randrange(2, 3 + seed % 4)) for i in range(3 * n)]


@pytest.mark.parametrize("groups", [all_joined(s) for s in range(60)])
def test_fans_against_flows(groups):
    """Node connectivity of all graphs from searches for single nodes, whatever the least degree."""
    pairs = sorted({p for g in groups for p in itertools.combinations(sorted(g), 2)})
    names = sorted({x for p in pairs for x in p})
    want = plain.connectivity(plain.adjacency(set(names), [(*p, 1) for p in pairs]))[0]
    node, group = (np.array(x) for x in zip(*((names.index(v), i) for i, g in enumerate(groups) for v in g), strict=True))
    least = int(np.bincount(np.array([names.index(x) for p in pairs for x in p])).min())
    for k in (least, 2 * least):  # a bound that is too high gives what is there
        order, both, later = fans.Joined(node, group, len(names)).order(k)
        place = np.argsort(order)
        made_ = fans.Joined(place[node], group, len(names))
        found = [fans.fan(made_, a, made_.bits(b), k) for a, b in both] + [fans.fan(made_, a, (1 << a) - 1, k) for a in later]
        assert min([least, *found]) == want or len(pairs) == len(names) * (len(names) - 1) // 2


def test_cohesion_of_a_projection(spark):
    """Days and customers whose least cuts are of fewer nodes than the least degree, and of one, in the projection and in its groups."""
    cliques = {("A:1", v) for v in range(6)} | {("A:2", v) for v in range(4, 10)} | {("A:3", v) for v in (0, 1, 8, 9)}
    parted = {t for t in cliques if t[0] != "A:3"} | {("A:4", 5), ("A:4", 11), ("A:5", 20), ("A:6", 20), ("A:6", 21)}
    for ties in (cliques, cliques - {("A:3", 0), ("A:3", 1)}, parted):
        edges = spark.createDataFrame([(a, f"V:{v}", 1) for a, v in sorted(ties)], "src string, dst string, weight long")
        pairs = graph.projection(edges, "dst", "src").collect()
        nodes = edges.select(F.col("dst").alias("node_id")).distinct()
        want = cohesion.cohesion(nodes, spark.createDataFrame(pairs)).first()
        assert cohesion.cohesion_projected(edges, "dst", "src").first() == want
        if want["components"] == 1:
            of = plain.adjacency({r["node_id"] for r in nodes.collect()}, [tuple(r) for r in pairs])
            assert (want["node_connectivity"], want["edge_connectivity"]) == plain.connectivity(of)


def test_no_blocks_where_paths_show_more(spark, monkeypatch):
    """A ring of cliques of two shared nodes each: neither pairs nor blocks are made."""
    edges = spark.createDataFrame([(f"A:{i}", f"V:{(2 * i + k) % 12}", 1) for i in range(6) for k in range(4)], "src string, dst string, weight long")
    monkeypatch.setattr(graph, "projection", None)
    monkeypatch.setattr(blocks, "blocks", None)
    assert tuple(cohesion.cohesion_projected(edges, "dst", "src").first()) == (1, 12, 4, 5, 4, 5, 0, 0)
