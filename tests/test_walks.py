"""Distances and betweenness of projections from blocks of sources, against plain loops and rounds of joins."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessella import catalogue
from tessella.operators import centrality, graph, walks
from tests import plain_graphs as plain
from tests.test_paths import measures


def walked(rows, n):
    """``measures`` of the nodes below ``n`` whose neighbours are ``rows`` of days and nodes."""
    days = {}
    for t, v in rows:
        days.setdefault(t, []).append(v)
    alone = set(range(n)) - {v for _, v in rows}
    lists = [*days.values(), *([v] for v in alone)]
    weights = {}
    for vs in days.values():
        for a in vs:
            for b in vs:
                if a < b:
                    weights[a, b] = weights.get((a, b), 0) + 1
    walk = walks.Walk(pa.array(lists, pa.list_(pa.int32())), n)
    own, through, wthrough = np.zeros((5, n)), 0, 0
    for i in range(0, n, max(walks.CELLS // n, 1)):
        s = np.arange(i, min(i + max(walks.CELLS // n, 1), n))
        own[:, s], x, y = walk.sums(s)
        through, wthrough = through + x, wthrough + y
    reached, far, total, wtotal, wnear = own
    m, scale = n - 1, (n - 1) * (n - 2)
    got = [(reached - 1) / m * (reached - 1) / np.where(wtotal > 0, wtotal, 1), wnear / m, far, reached, total, through / scale, wthrough / scale]
    return walk, np.stack(got, 1), measures(plain.adjacency(set(range(n)), [(*p, w) for p, w in weights.items()]))


def some_ties(seed, n, days, ties):
    rng = random.Random(seed)
    return sorted({(rng.randrange(days), min(int(rng.expovariate(3 / n)), n - 1)) for _ in range(ties)})


@pytest.mark.parametrize(("light", "few"), [(0, 0), (0, 0.3), (0, 10**9), (10**9, 0)])
@pytest.mark.parametrize(("seed", "n", "days", "ties"), [(1, 40, 30, 120), (2, 60, 20, 700), (3, 50, 60, 90), (4, 80, 12, 900), (5, 30, 1, 25)])
def test_walks_against_loops(monkeypatch, light, few, seed, n, days, ties):
    """By way of neighbours, with levels met or followed, and along arcs; a few sources and arcs at a time, few marks of lengths."""
    for name, value in {"LIGHT": light, "ONES": 0, "FEW": few, "CELLS": 200, "CHUNK": 40, "TABLE": 300}.items():
        monkeypatch.setattr(walks, name, value)
    walk, got, want = walked(some_ties(seed, n, days, ties), n)
    assert walk.light == (light == 0)
    assert got == pytest.approx(np.array([want[v] for v in range(n)]), abs=1e-9)


@pytest.mark.parametrize("consts", [{"SMALL": 8, "SOURCES": 5}, {"SMALL": 8, "ARCS": 50}])
def test_path_measures_of_a_projection(spark, monkeypatch, consts):
    """Several components, small ones together, in several blocks; a large one is left to joins."""
    ties = {(f"A:{t}", f"V:{v}") for t, v in some_ties(6, 24, 20, 60)} | {(f"A:{t}x", f"V:{v}x") for t, v in some_ties(7, 8, 5, 9)} | {("A:alone", "V:alone")}
    if "ARCS" in consts:  # joins take their time
        ties = {("A:0", f"V:{i}") for i in range(9)} | {("A:1", f"V:{i}x") for i in range(3)} | {("A:alone", "V:alone")}
    edges = spark.createDataFrame([*((*t, 1) for t in sorted(ties)), ("A:1", None, 1), (None, "V:1", 1)], "src string, dst string, weight long")
    of, weights = {}, {}
    for a, v in ties:
        of.setdefault(a, []).append(v)
    for vs in of.values():
        for a in vs:
            for b in vs:
                if a < b:
                    weights[a, b] = weights.get((a, b), 0) + 1
    want = measures(plain.adjacency({v for _, v in ties}, [(*p, w) for p, w in weights.items()]))
    for name, value in consts.items():
        monkeypatch.setattr(walks, name, value)
    if "ARCS" not in consts:
        monkeypatch.setattr(graph, "projection", None)
    rows = walks.path_measures_projected(edges, "dst", "src").collect()
    names = ["closeness", "harmonic", "eccentricity", "reached", "distance_sum", "betweenness", "weighted_betweenness"]
    got = {r["node_id"]: [r[c] for c in names] for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert all(got[v] == pytest.approx(want[v], abs=2e-6) for v in want)


def test_paths_of_nothing(spark):
    none = spark.createDataFrame([], "src string, dst string, weight long")
    assert walks.path_measures_projected(none, "dst", "src").count() == 0


def test_paths_make_no_projection(spark, monkeypatch):
    monkeypatch.setattr(graph, "projection", None)
    assert catalogue.QUERIES["meeting_paths"](spark, "/root/testdata/sf0.001").count() == 150


def test_summary_walks_no_written_pairs(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "_customers", None)
    monkeypatch.setattr(catalogue.distances, "path_measures", None)
    monkeypatch.setattr(catalogue, "meeting_articulation", lambda s, d: s.createDataFrame([], "network string, node_id string, delta_components long, verified boolean"))
    bridges = "author string, n_items long, n_communities long, delta_components long, is_bridge boolean, is_recurrent boolean, is_multichannel boolean"
    monkeypatch.setattr(catalogue, "meeting_bridge_authors", lambda s, d: s.createDataFrame([], bridges))
    rows = catalogue.QUERIES["meeting_centrality_summary"](spark, "/root/testdata/sf0.001").where("measure = 'n_nodes'").collect()
    assert [r["value"] for r in rows] == [150.0]


def test_core_numbers_and_eigenvector_of_a_projection(spark, monkeypatch):
    """One component without even degrees, whose nodes share days, and beside it one in which all have one degree."""
    ties = {(f"A:{t}", f"V:{v}") for t, v in some_ties(8, 12, 10, 40)} | {("A:all", f"V:{i}") for i in (0, 5, 11)}
    rows = sorted(ties | {(f"A:{t}", f"V:{v}") for t in "xy" for v in ("even1", "even2", "even3")})
    both = spark.createDataFrame([(*t, 1) for t in rows], "src string, dst string, weight long")
    one = both.where("not dst like 'V:even%'")
    even = both.where("dst like 'V:even%'")
    value = lambda df, c: {r["node_id"]: r[c] for r in df.collect()}
    part = lambda e: (e.select("dst").distinct().toDF("node_id"), graph.projection(e, "dst", "src"))
    known = lambda e: graph.components_projected(e, "dst", "src")
    cores = value(centrality.k_core(*part(both)), "core")
    vector = value(centrality.eigenvector(*part(one), tolerance=1e-9, most=300), "eigenvector")
    assert value(centrality.k_core_projected(both, "dst", "src", graph.degrees_projected(both, "dst", "src"), known(both)), "core") == cores
    got = value(centrality.eigenvector_projected(one, "dst", "src", known(one), tolerance=1e-9, most=300), "eigenvector")
    assert got == pytest.approx(vector, abs=2e-5) and set(value(centrality.eigenvector_projected(both, "dst", "src", known(both)), "eigenvector").values()) == {None}
    monkeypatch.setattr(centrality, "projection", None)
    assert set(value(centrality.k_core_projected(even, "dst", "src", graph.degrees_projected(even, "dst", "src"), known(even)), "core").values()) == {2}
