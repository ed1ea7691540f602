"""Plain loops over small graphs, which the distributed operators are tested against."""

from __future__ import annotations

import heapq
from collections import defaultdict, deque

Adjacency = dict[str, dict[str, float]]


def adjacency(nodes, edges) -> Adjacency:
    graph = {x: {} for x in sorted(nodes)}
    for a, b, w in sorted(edges):
        graph[a][b] = graph[b][a] = float(w)
    return {k: dict(sorted(v.items())) for k, v in graph.items()}


def shortest(graph: Adjacency, source: str, weighted: bool) -> tuple[list[str], dict[str, float], dict[str, float], dict[str, list[str]]]:
    """Nodes by distance, distances, path counts and predecessors; a weight w is a distance 1 / w.

    Distances that differ by less than 1e-12 are equal.
    """
    dist, count, before, order = {source: 0.0}, {source: 1.0}, {source: []}, []
    if not weighted:
        queue = deque([source])
        while queue:
            v = queue.popleft()
            order.append(v)
            for u in graph[v]:
                if u not in dist:
                    dist[u], count[u], before[u] = dist[v] + 1, 0.0, []
                    queue.append(u)
                if dist[u] == dist[v] + 1:
                    count[u] += count[v]
                    before[u].append(v)
        return order, dist, count, before
    heap, done = [(0.0, source)], set()
    while heap:
        d, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        order.append(v)
        for u, w in graph[v].items():
            far = d + 1 / max(w, 1e-12)
            if u not in dist or far < dist[u] - 1e-12:
                dist[u], count[u], before[u] = far, count[v], [v]
                heapq.heappush(heap, (far, u))
            elif u not in done and abs(far - dist[u]) <= 1e-12:
                count[u] += count[v]
                before[u].append(v)
    return order, dist, count, before


def cut_points(graph: Adjacency) -> tuple[set[str], list[tuple[str, str]]]:
    """Articulation points and bridges by low links, without recursion."""
    seen: dict[str, int] = {}
    low: dict[str, int] = {}
    cuts, bridges = set(), []
    for root in graph:
        if root in seen:
            continue
        seen[root] = low[root] = len(seen)
        stack, children = [(root, "", iter(graph[root]))], 0
        while stack:
            v, parent, rest = stack[-1]
            for u in rest:
                if u == parent:
                    continue
                if u in seen:
                    low[v] = min(low[v], seen[u])
                    continue
                seen[u] = low[u] = len(seen)
                stack.append((u, v, iter(graph[u])))
                break
            else:
                stack.pop()
                if parent:
                    low[parent] = min(low[parent], low[v])
                    if low[v] > seen[parent]:
                        bridges.append((min(v, parent), max(v, parent)))
                    if parent == root:
                        children += 1
                    elif low[v] >= seen[parent]:
                        cuts.add(parent)
        if children > 1:
            cuts.add(root)
    return cuts, bridges


def parts_without(graph: Adjacency, gone: str, within: set[str] | None = None) -> list[int]:
    """Sizes of the components that a node leaves behind, among the nodes of its own component."""
    left = within if within is not None else set(shortest(graph, gone, False)[1])
    left = left - {gone}
    sizes = []
    while left:
        queue, n = [left.pop()], 0
        while queue:
            v = queue.pop()
            n += 1
            new = [u for u in graph[v] if u in left]
            left.difference_update(new)
            queue += new
        sizes.append(n)
    return sizes


def _flow(capacity: dict, source, sink, most: int) -> int:
    """Unit flow by breadth-first augmenting paths, up to ``most``."""
    residual = {v: dict(out) for v, out in capacity.items()}
    for v, out in capacity.items():
        for u in out:
            residual.setdefault(u, {}).setdefault(v, 0)
    total = 0
    while total < most:
        came, queue = {source: None}, deque([source])
        while queue and sink not in came:
            v = queue.popleft()
            for u, c in residual[v].items():
                if c > 0 and u not in came:
                    came[u] = v
                    queue.append(u)
        if sink not in came:
            break
        v = sink
        while came[v] is not None:
            residual[came[v]][v] -= 1
            residual[v][came[v]] += 1
            v = came[v]
        total += 1
    return total


def connectivity(graph: Adjacency) -> tuple[int, int]:
    """Node and edge connectivity of a connected graph; a cut point or bridge settles them at one."""
    n = len(graph)
    if n < 2:
        return 0, 0
    cuts, bridge = cut_points(graph)
    least = min(map(len, graph.values()))
    if all(len(x) == n - 1 for x in graph.values()):
        return n - 1, n - 1
    edge = 1
    if not bridge:
        capacity = {v: dict.fromkeys(out, 1) for v, out in graph.items()}
        first, *rest = graph
        edge = least
        for other in rest:
            edge = min(edge, _flow(capacity, first, other, edge))
    if cuts:
        return 1, edge
    split = {}
    for v, out in graph.items():
        split[v, 0] = {(v, 1): 1}
        split[v, 1] = {(u, 0): 1 for u in out}
    v = min(graph, key=lambda x: (len(graph[x]), x))
    node = least
    pairs = [(v, u) for u in graph if u != v and u not in graph[v]]
    pairs += [(a, b) for a in graph[v] for b in graph[v] if a < b and b not in graph[a]]
    for a, b in pairs:
        node = min(node, _flow(split, (a, 1), (b, 0), node))
    return node, edge


def louvain_groups(graph: Adjacency, mass: float, resolution: float = 1.0) -> dict[str, str]:
    """Move nodes in order to the neighbouring community of largest gain, then contract, until none moves."""
    of = {v: v for v in graph}
    level: dict[str, dict[str, float]] = {v: dict(out) for v, out in graph.items()}
    while True:
        home = {v: v for v in level}
        strength = {v: sum(w * (2 if u == v else 1) for u, w in out.items()) for v, out in level.items()}
        total = dict(strength)
        moved = again = True
        changed = False
        while again:
            again = False
            for v in sorted(level):
                near: dict[str, float] = defaultdict(float)
                for u, w in level[v].items():
                    if u != v:
                        near[home[u]] += w
                own = home[v]
                total[own] -= strength[v]
                gain = lambda c: near.get(c, 0.0) - resolution * total[c] * strength[v] / (2 * mass)  # noqa: B023, E731
                best = max(sorted(near), key=gain, default=own)
                if best != own and gain(best) > gain(own) + 1e-12:
                    home[v] = best
                    again = changed = True
                total[home[v]] += strength[v]
        moved = changed
        if not moved:
            return of
        of = {v: home[c] for v, c in of.items()}
        merged: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        for v, out in level.items():
            for u, w in out.items():
                a, b = home[v], home[u]
                # An inner edge is seen from both ends, a loop once.
                merged[a][b] += w / 2 if a == b and u != v else w
        level = {v: dict(out) for v, out in merged.items()}


def greedy_groups(graph: Adjacency, mass: float) -> dict[str, str]:
    """Merge the two communities that raise modularity most, smallest names first, while any does."""
    of = {v: v for v in graph}
    between = {v: dict(out) for v, out in graph.items()}
    strength = {v: sum(out.values()) for v, out in graph.items()}
    while True:
        best = max(
            ((w / mass - strength[a] * strength[b] / (2 * mass * mass), a, b) for a, out in between.items() for b, w in out.items() if a < b),
            key=lambda x: (x[0], [-ord(c) for c in x[1]], [-ord(c) for c in x[2]]), default=(0, "", ""),
        )
        if best[0] <= 1e-12:
            return of
        _, a, b = best
        for c, w in between.pop(b).items():
            between[c].pop(b)
            if c != a:
                between[a][c] = between[c][a] = between[a].get(c, 0.0) + w
        strength[a] += strength.pop(b)
        of = {v: a if c == b else c for v, c in of.items()}


def propagated_groups(graph: Adjacency, rounds: int = 100) -> dict[str, str]:
    """Each node in order takes its neighbours' heaviest label, of ties its own, then the smallest."""
    of = {v: v for v in graph}
    for _ in range(rounds):
        moved = False
        for v in sorted(graph):
            near: dict[str, float] = defaultdict(float)
            for u, w in graph[v].items():
                near[of[u]] += w
            top = max(near.values(), default=0.0)
            best = of[v] if near.get(of[v], -1.0) == top else min((c for c, w in near.items() if w == top), default=of[v])
            moved |= best != of[v]
            of[v] = best
        if not moved:
            break
    return of
