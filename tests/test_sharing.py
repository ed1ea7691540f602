"""Pairs made in pieces, against brute force, and without a shuffle of pairs."""

import itertools
import random

import pyarrow as pa
import pytest

from tessella import catalogue
from tessella.operators import centrality, graph, sharing, triples


def some_days(seed, people=40, days=25, rows=160):
    rng = random.Random(seed)
    return sorted({(f"A:{rng.randrange(days)}", f"V:{rng.randrange(people)}") for _ in range(rows)})


def bipartite(spark, rows):
    return spark.createDataFrame([(a, v, 1) for a, v in rows], "src string, dst string, weight long")


def shared(rows):
    of = {}
    for a, v in rows:
        of.setdefault(v, set()).add(a)
    return of, {(u, v): len(of[u] & of[v]) for u, v in itertools.combinations(sorted(of), 2) if of[u] & of[v]}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def pieces(monkeypatch):
    """So many blocks that a small graph has 21 pieces."""
    monkeypatch.setattr(sharing, "MEMBERS", 30)


def test_chunks_hold_every_meeting_once(monkeypatch):
    rows = some_days(1)
    of, want = shared(rows)
    days = {}
    for a, v in rows:
        days.setdefault(a, []).append(v)
    table = pa.table({"g": [0] * len(days), "k": pa.array([0] * len(days), pa.int32()), "t": list(days), "ns": list(days.values())})
    for chunk in (1, 7, 10**6):
        monkeypatch.setattr(sharing, "CHUNK", chunk)
        piece = sharing.Piece(table, 1)
        names = piece.names.to_pylist()
        got = [(names[a], names[b], k) for u, v, w in piece.pairs() for a, b, k in zip(u, v, w, strict=True)]
        assert len(got) == len(want) and {(a, b): k for a, b, k in got} == want
        assert dict(zip(names, piece.degree, strict=True)) == {v: len(x) for v, x in of.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_latapy_in_pieces(spark, pieces, seed):
    rows = some_days(seed)
    of, want = shared([*rows, ("A:alone", "V:alone")])
    df = graph.latapy(bipartite(spark, [*rows, ("A:alone", "V:alone"), rows[0]]), "dst", "src")
    got = {r["node_id"]: r["latapy"] for r in df.collect()}
    for v in of:
        parts = [k / len(of[a] | of[b]) for (a, b), k in want.items() if v in (a, b)]
        assert got[v] == pytest.approx(sum(parts) / len(parts) if parts else 0.0, abs=2e-6)
    assert set(got) == set(of)


def test_latapy_shuffles_no_pairs(spark):
    assert "hashpartitioning(src" not in plan(graph.latapy(bipartite(spark, some_days(3)), "dst", "src"))


def test_pagerank_of_a_projection_without_pairs(spark, monkeypatch):
    rows = [*some_days(4), ("A:alone", "V:alone")]
    edges = bipartite(spark, [*rows, rows[0]])
    nodes = edges.select("dst").distinct().toDF("node_id")
    want = {r["node_id"]: r["pagerank"] for r in centrality.pagerank(nodes, graph.projection(edges, "dst", "src"), tolerance=1e-12).collect()}
    monkeypatch.setattr(graph, "projection", None)
    got = {r["node_id"]: r["pagerank"] for r in centrality.pagerank_projected(edges, "dst", "src", tolerance=1e-12).collect()}
    assert set(got) == set(want) and all(got[v] == pytest.approx(want[v], abs=2e-6) for v in want)
    assert centrality.pagerank_projected(edges.limit(0), "dst", "src").count() == 0


def test_bridge_authors_without_a_projection(spark, pieces, monkeypatch):
    rows = some_days(5, 30, 30, 70)
    of, want = shared(rows)
    monkeypatch.setattr(graph, "projection", None)
    catalog = spark.createDataFrame([(int(v[2:]), "c") for v in of], "item_id int, channel_id string")
    got = {r["author"]: (r["delta_components"], r["lost_edges"]) for r in graph.bridge_authors(bipartite(spark, rows), catalog).collect()}

    def parts(without):
        label = {v: v for v in of}
        for u, v in want:
            if of[u] & of[v] - {without}:
                old, new = label[u], label[v]
                label = {x: new if y == old else y for x, y in label.items()}
        return len(set(label.values()))

    whole = parts(None)
    assert got == {a: (parts(a) - whole, sum(of[u] & of[v] == {a} for u, v in want)) for a, _ in rows}
    assert any(k for k, _ in got.values())


def test_projection_shuffles_no_pairs(spark, pieces):
    rows = some_days(6)
    df = graph.projection(bipartite(spark, [*rows, rows[0]]), "dst", "src")
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len({x[:2] for x in got}) and {x[:2]: x[2] for x in got} == shared(rows)[1]
    assert "hashpartitioning(src" not in plan(df)


def test_verification_where_pairs_are_made(spark, pieces, monkeypatch):
    edges = bipartite(spark, some_days(7))
    monkeypatch.setattr(graph, "projection", None)
    assert {r["check"]: r["violations"] for r in graph.verify_made(edges, "dst", "src").collect()} == {"weights_are_intersections": 0, "cliques_complete": 0, "canonical_order": 0}


def test_wrong_weights_are_seen(monkeypatch):
    rows = some_days(8)
    days = {}
    for a, v in rows:
        days.setdefault(a, []).append(v)
    # Two blocks, by the parity of names.
    lists = [(a, k, [v for v in vs if int(v[2:]) % 2 == k]) for a, vs in days.items() for k in (0, 1)]
    table = pa.table({"g": [1] * len(lists), "k": pa.array([k for _, k, _ in lists], pa.int32()), "t": [a for a, _, _ in lists], "ns": [x for *_, x in lists]})
    piece = sharing.Piece(table, 2)
    for marks in (1, 200, 10**6):
        monkeypatch.setattr(sharing, "MARKS", marks)
        assert all((piece.shared(u, v) == w).all() for u, v, w in piece.pairs())
    right = next(graph._checked(piece)).to_pylist()[0]
    pairs = list(piece.pairs())
    monkeypatch.setattr(piece, "pairs", lambda: ((u, v, w + 1) for u, v, w in pairs))
    assert right["wrong"] == 0 and next(graph._checked(piece)).to_pylist()[0]["wrong"] == sum(len(u) for u, *_ in pairs) > 0


def test_modularity_of_a_projection(spark, pieces, monkeypatch):
    rows = some_days(9)
    edges = bipartite(spark, rows)
    parts = spark.createDataFrame([(v, f"c{int(v[2:]) % 3}") for v in shared(rows)[0]], "node_id string, community string")
    want = tuple(graph.modularity(graph.projection(edges, "dst", "src"), parts).first())
    monkeypatch.setattr(graph, "projection", None)
    assert tuple(graph.modularity_projected(edges, "dst", "src", parts).first()) == want


@pytest.mark.parametrize("seed", [10, 11])
def test_clustering_and_topology_in_triples(spark, pieces, monkeypatch, seed):
    """Blocks of a few nodes: triangles have corners in one, two and three of them, in several components."""
    monkeypatch.setattr(triples, "SIDE", 6)
    monkeypatch.setattr(triples, "SMALL", 4)
    monkeypatch.setattr(triples, "WIDE", 3)
    rows = [*some_days(seed), *((f"{a}x", f"{v}x") for a, v in some_days(seed + 1, 5, 4, 8)), ("A:alone", "V:alone")]
    edges = bipartite(spark, [*rows, rows[0]])
    nodes, pairs = edges.select("dst").distinct().toDF("node_id"), graph.projection(edges, "dst", "src")
    wants = [graph.clustering(nodes, pairs).collect(), graph.topology(nodes, pairs).collect()]
    monkeypatch.setattr(graph, "projection", None)
    d = graph.degrees_projected(edges, "dst", "src")
    gots = [graph.clustering_projected(edges, "dst", "src").collect(), graph.topology_projected(edges, "dst", "src", d).collect()]
    for want, got in zip(wants, gots, strict=True):
        key = lambda r: str(r[0])
        for a, b in zip(sorted(want, key=key), sorted(got, key=key), strict=True):
            assert a.asDict() == pytest.approx(b.asDict(), abs=2e-6)


def test_sparse_parts_are_joined(spark, monkeypatch):
    """Where products of matrices would cost more than open paths, the projection's triangles are joined."""
    monkeypatch.setattr(graph, "PRODUCTS", 0)
    monkeypatch.setattr(triples, "triangles", None)
    got = {r["node_id"]: r["triangles"] for r in graph.clustering_projected(bipartite(spark, [("A:1", f"V:{i}") for i in range(4)]), "dst", "src").collect()}
    assert got == {f"V:{i}": 3 for i in range(4)}


@pytest.mark.parametrize(("dense", "heavy", "meeting"), [(0, 0, 0), (2, 0, 10**9), (0, 2, 10**9), (2, 2, 0)])
def test_ways_to_count_closed_paths_agree(monkeypatch, dense, heavy, meeting):
    """Bits or products, rows or products, meetings or products: one answer, against plain loops."""
    for name, value in {"DENSE": dense, "HEAVY": heavy, "MEETING": meeting, "CHUNK": 50, "WIDE": 3}.items():
        monkeypatch.setattr(triples, name, value)
    rows = some_days(12, 90, 30, 400)
    of, want = shared(rows)
    names = sorted(of)
    place = {v: (i % 3, i // 3) for i, v in enumerate(names)}
    days = {}
    for a, v in rows:
        days.setdefault((place[v][0], int(a[2:])), []).append(place[v][1])
    weight = lambda u, v: want.get((min(u, v), max(u, v)), 0)
    many, roots = {v: 0 for v in names}, {v: 0.0 for v in names}
    for t in itertools.combinations(names, 3):
        w = weight(t[0], t[1]) * weight(t[0], t[2]) * weight(t[1], t[2])
        for v in t:
            many[v] += w > 0
            roots[v] += w ** (1 / 3)
    got = {(k, n): [0, 0.0] for k, n in place.values()}
    for blocks in itertools.combinations_with_replacement(range(3), 3):
        mine = {x: ns for x, ns in days.items() if x[0] in blocks}
        table = pa.table({"k": pa.array([k for k, _ in mine], pa.int32()), "t": pa.array([t for _, t in mine], pa.int64()), "ns": pa.array(list(mine.values()), pa.list_(pa.int32()))})
        for k, x, y in triples.Triple(table).corners(*blocks):
            for n in range(len(x)):
                got[k, n][0] += x[n]
                got[k, n][1] += y[n]
    assert {v: got[place[v]][0] for v in names} == many and all(got[place[v]][1] == pytest.approx(roots[v]) for v in names)


@pytest.mark.parametrize("name", ["meeting_metrics", "network_metrics"])
def test_metrics_make_no_projection(spark, monkeypatch, name):
    monkeypatch.setattr(graph, "projection", None)
    df = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.columns == ["network", "metric", "value"]
