"""Trees, blocks, articulation points and bridges against plain loops."""

import itertools
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tessella.operators import blocks, trees
from tests import plain_graphs as plain
from tests.test_graph import made


def some_graph(seed, n=60, m=75):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    return [(f"n{a:02}", f"n{b:02}", rng.randrange(1, 4)) for a, b in sorted(pairs)], [f"n{i:02}" for i in range(n)]


PATH = [(f"p{i:03}", f"p{i + 1:03}", 1) for i in range(70)]
HUB = [("hub", f"x{i:03}", 1) for i in range(60)] + [("x000", "x001", 1), ("x002", "y", 1)]
CLIQUE = [(a, b, 1) for a, b in itertools.combinations("abcdef", 2)]
GRAPHS = [*(some_graph(s) for s in range(2)), (PATH, ["alone"]), (HUB, []), (CLIQUE, ["alone", "more"]), ([], ["a", "b"]), ([], [])]


@pytest.mark.parametrize("case", range(len(GRAPHS)))
def test_blocks_against_loops(spark, case):
    edges, extra = GRAPHS[case]
    nodes, pairs = made(spark, edges, extra) if edges or extra else (spark.createDataFrame([], "node_id string"), spark.createDataFrame([], "src string, dst string, weight long"))
    graph = plain.adjacency({x for a, b, _ in edges for x in (a, b)} | set(extra), edges)
    found = blocks.blocks(nodes, pairs)
    cuts, bridge = plain.cut_points(graph)
    assert sorted((r["src"], r["dst"]) for r in blocks.bridges(nodes, pairs, found).collect()) == sorted(bridge)
    rows = {r["node_id"]: r for r in blocks.articulation_removal(nodes, pairs, found).collect()}
    assert set(rows) == cuts
    home = {v: frozenset(plain.shortest(graph, v, False)[1]) for v in graph}
    parts = set(home.values())
    for v, r in rows.items():
        sizes = plain.parts_without(graph, v)
        others = [len(p) for p in parts if v not in p]
        assert r["components_before"] == len(parts) and r["components_after"] == len(parts) - 1 + len(sizes) and r["verified"]
        assert (r["degree"], r["giant_before"], r["giant_after"]) == (len(graph[v]), max(map(len, parts)), max(sizes + others))
        assert r["isolates_after"] == others.count(1) + sizes.count(1)


def test_rooted_trees(spark):
    edges = spark.createDataFrame([(5, 9), (9, 2), (2, 7), (9, 8), (11, 12)], "a long, b long")
    forest, labels = trees.spanning_forest(edges)
    assert forest.count() == 5
    got = {r["node"]: r for r in trees.rooted(forest, labels).collect()}
    assert {v: r["parent"] for v, r in got.items()} == {2: None, 9: 2, 7: 2, 5: 9, 8: 9, 11: None, 12: 11}
    assert {v: r["size"] for v, r in got.items()} == {2: 5, 9: 3, 7: 1, 5: 1, 8: 1, 11: 2, 12: 1}
    assert sorted(r["pre"] for r in got.values()) == list(range(1, 8))
    inside = lambda v, u: got[u]["pre"] <= got[v]["pre"] < got[u]["pre"] + got[u]["size"]
    assert all(inside(v, r["parent"]) for v, r in got.items() if r["parent"])


def test_forest_spans_and_has_no_circle(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(500)]
    forest, labels = trees.spanning_forest(spark.createDataFrame(pairs, "a long, b long"))
    label = {r["node"]: r["label"] for r in labels.collect()}
    parent = list(range(400))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    given = {tuple(sorted(p)) for p in pairs}
    for r in forest.collect():
        a, b = root(r["a"]), root(r["b"])
        assert a != b and (min(r["a"], r["b"]), max(r["a"], r["b"])) in given
        parent[max(a, b)] = min(a, b)
    assert all(root(a) == root(b) for a, b in pairs) and label == {x: root(x) for p in pairs if p[0] != p[1] for x in p}


def test_scratch_without_a_configured_folder(tmp_path):
    """Spark's defaults name no folder and refuse to change the setting: a local run makes its own."""
    code = """
from tessella.session import local_session
from tessella.scratch import shared_root, written
s = local_session("1", 1, "1g")
assert s.conf.get("spark.checkpoint.dir", None) is None
assert written(s.range(3), "x").count() == 3 and shared_root(s) == shared_root(s)
print("fine")
"""
    import os

    env = {k: v for k, v in os.environ.items() if k not in ("SPARK_HOME",)} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.getcwd(), "TMPDIR": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("fine"), out.stderr[-2000:]
