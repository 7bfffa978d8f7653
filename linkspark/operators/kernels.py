"""Graph and tree kernels in plain Python and numpy, run inside one component or one bounded training set."""

from __future__ import annotations

import heapq
import random
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np

Edges = list[tuple[int, int, float]]


def adjacency(edges: Edges) -> dict[int, dict[int, float]]:
    """Undirected neighbour weights; the last weight of a repeated edge counts."""
    adj: dict[int, dict[int, float]] = defaultdict(dict)
    for u, v, w in edges:
        adj[u][v] = w
        adj[v][u] = w
    return adj


# --- communities -------------------------------------------------------------------


def _move(adj: dict, loops: dict, member: dict, total: float, rnd: random.Random, within: dict | None = None) -> bool:
    """Local moves that raise modularity, until none does; ``within`` keeps nodes inside an outer partition."""
    degree = {u: sum(n.values()) + 2 * loops.get(u, 0.0) for u, n in adj.items()}
    sums: dict = defaultdict(float)
    for u, c in member.items():
        sums[c] += degree[u]
    any_, moved = False, True
    nodes = sorted(adj)
    while moved:
        moved = False
        rnd.shuffle(nodes)
        for u in nodes:
            here = member[u]
            links: dict = defaultdict(float)
            for v, w in adj[u].items():
                if v != u and (within is None or within[v] == within[u]):
                    links[member[v]] += w
            sums[here] -= degree[u]
            best, gain = here, links[here] - sums[here] * degree[u] / (2 * total)
            for c in sorted(links):
                g = links[c] - sums[c] * degree[u] / (2 * total)
                if g > gain + 1e-12:
                    best, gain = c, g
            sums[best] += degree[u]
            if best != here:
                member[u] = best
                moved = any_ = True
    return any_


def louvain(edges: Edges, total: float | None = None, seed: int = 0, refine: bool = False) -> dict[int, int]:
    """Node to community by modularity; ``refine`` splits communities into well-joined parts before merging (Leiden).

    ``total`` is the weight of the whole graph, if ``edges`` are one component of it.
    """
    rnd, adj = random.Random(seed), adjacency(edges)
    total = total or sum(sum(n.values()) for n in adj.values()) / 2 or 1.0
    loops: dict = {}
    part = {u: u for u in adj}
    inner = {u: {u} for u in adj}
    start = None
    while True:
        member = dict(start) if start else {u: u for u in adj}
        changed = _move(adj, loops, member, total, rnd)
        for u, c in member.items():
            for x in inner[u]:
                part[x] = c
        if not changed and start is None or len(set(member.values())) == len(adj):
            break
        low = {u: u for u in adj}
        if refine:
            _move(adj, loops, low, total, rnd, within=member)
        groups = low if refine and len(set(low.values())) < len(adj) else member
        new_adj: dict = defaultdict(lambda: defaultdict(float))
        new_loops: dict = defaultdict(float)
        new_inner: dict = defaultdict(set)
        for u, n in adj.items():
            g = groups[u]
            new_inner[g] |= inner[u]
            new_adj[g]
            new_loops[g] += loops.get(u, 0.0)
            for v, w in n.items():
                if groups[v] == g:
                    new_loops[g] += w / 2
                else:
                    new_adj[g][groups[v]] += w
        start = {groups[u]: member[u] for u in adj} if refine else None
        if refine:
            names = {c: min(g for g in start if start[g] == c) for c in set(start.values())}
            start = {g: names[c] for g, c in start.items()}
        adj, loops, inner = {u: dict(n) for u, n in new_adj.items()}, dict(new_loops), new_inner
    names = {}
    for x in sorted(part):
        names.setdefault(part[x], x)
    return {x: names[c] for x, c in part.items()}


def label_propagation(edges: Edges, seed: int = 0, rounds: int = 200) -> dict[int, int]:
    """Asynchronous weighted label propagation in a seeded order; of equal labels the present one, else the smallest."""
    rnd, adj = random.Random(seed), adjacency(edges)
    label, nodes = {u: u for u in adj}, sorted(adj)
    for _ in range(rounds):
        rnd.shuffle(nodes)
        changed = False
        for u in nodes:
            weight: dict = defaultdict(float)
            for v, w in adj[u].items():
                weight[label[v]] += w
            top = max(weight.values())
            best = [c for c, w in weight.items() if w >= top - 1e-12]
            if label[u] not in best:
                label[u] = min(best)
                changed = True
        if not changed:
            break
    names = {}
    for u in sorted(label):
        names.setdefault(label[u], u)
    return {u: names[c] for u, c in label.items()}


def first_split(nodes: list[int], edges: Edges) -> dict[int, int]:
    """Communities after taking the heaviest edges away until one component more is left.

    These are the components of the edges lighter than the heaviest edge of
    the minimum spanning forest.
    """
    parent = {u: u for u in nodes}

    def root(u: int) -> int:
        while parent[u] != u:
            parent[u] = parent[parent[u]]
            u = parent[u]
        return u

    ordered = sorted(edges, key=lambda e: (e[2], -e[0], -e[1]))
    last = -1
    for k, (u, v, _) in enumerate(ordered):
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
            last = k
    parent = {u: u for u in nodes}
    for u, v, _ in ordered[: max(last, 0)]:
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {u: root(u) for u in nodes}


# --- centralities and distances -------------------------------------------------------


def _dijkstra(adj: dict, s: int) -> tuple[dict, dict, list, dict]:
    dist, sigma, order, before = {s: 0.0}, defaultdict(float), [], defaultdict(list)
    sigma[s] = 1.0
    heap, done = [(0.0, s)], set()
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        order.append(u)
        for v, w in adj[u].items():
            new = d + w
            if v not in dist or new < dist[v] - 1e-12:
                dist[v], sigma[v], before[v] = new, sigma[u], [u]
                heapq.heappush(heap, (new, v))
            elif abs(new - dist[v]) <= 1e-12 and v not in done:
                sigma[v] += sigma[u]
                before[v].append(u)
    return dist, sigma, order, before


def betweenness(edges: Edges, nodes: list[int]) -> dict[int, float]:
    """Normalised betweenness by weighted shortest paths (Brandes)."""
    adj, score = adjacency(edges), dict.fromkeys(nodes, 0.0)
    for s in nodes:
        if s not in adj:
            continue
        _, sigma, order, before = _dijkstra(adj, s)
        delta: dict = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    n = len(nodes)
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return {u: x * scale for u, x in score.items()}


def closeness(edges: Edges, nodes: list[int]) -> dict[int, float]:
    """Closeness by weighted distance, scaled by the share of nodes that are reached."""
    adj, n, out = adjacency(edges), len(nodes), {}
    for s in nodes:
        dist = _dijkstra(adj, s)[0] if s in adj else {s: 0.0}
        total, reached = sum(dist.values()), len(dist) - 1
        out[s] = reached / total * reached / (n - 1) if total > 0 and n > 1 else 0.0
    return out


def pagerank(edges: Edges, nodes: list[int], damping: float = 0.85, rounds: int = 100, tol: float = 1e-8) -> dict[int, float]:
    """Weighted PageRank; nodes without edges spread evenly."""
    adj, n = adjacency(edges), len(nodes)
    rank = dict.fromkeys(nodes, 1 / n)
    out = {u: sum(adj[u].values()) for u in nodes if u in adj}
    for _ in range(rounds):
        loose = sum(rank[u] for u in nodes if not out.get(u))
        new = {u: (1 - damping) / n + damping * loose / n for u in nodes}
        for u, total in out.items():
            for v, w in adj[u].items():
                if total:
                    new[v] += damping * rank[u] * w / total
        if sum(abs(new[u] - rank[u]) for u in nodes) < n * tol:
            return new
        rank = new
    return rank


def diameter(edges: Edges) -> float:
    """Largest weighted shortest distance between nodes that reach each other."""
    adj = adjacency(edges)
    return max((max(_dijkstra(adj, s)[0].values()) for s in adj), default=0.0)


# --- bridges and cuts -----------------------------------------------------------------------


def bridges(edges: Edges) -> set[tuple[int, int]]:
    """Edges whose removal disconnects their ends, as (smaller, larger)."""
    adj, low, seen, out, clock = adjacency(edges), {}, {}, set(), 0
    for s in sorted(adj):
        if s in seen:
            continue
        stack = [(s, None, iter(sorted(adj[s])))]
        seen[s] = low[s] = clock
        clock += 1
        while stack:
            u, parent, it = stack[-1]
            for v in it:
                if v == parent or v == u:
                    continue
                if v in seen:
                    low[u] = min(low[u], seen[v])
                else:
                    seen[v] = low[v] = clock
                    clock += 1
                    stack.append((v, u, iter(sorted(adj[v]))))
                    break
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[u])
                    if low[u] > seen[parent]:
                        out.add((min(u, parent), max(u, parent)))
    return out


def loose_bridges(edges: Edges, keep: set[tuple[int, int]]) -> set[tuple[int, int]]:
    """Bridges whose ends both have more than two neighbours and lie in a triangle, without those to keep."""
    adj = adjacency(edges)

    def joined(u: int) -> bool:
        n = list(adj[u])
        return len(n) > 2 and any(b in adj[a] for i, a in enumerate(n) for b in n[:i])

    return {b for b in bridges(edges) if b not in keep and joined(b[0]) and joined(b[1])}


def min_cut(edges: Edges, s: int, t: int) -> set[tuple[int, int]]:
    """Edges of a minimum cut between s and t (shortest augmenting paths), as (smaller, larger)."""
    cap: dict = defaultdict(lambda: defaultdict(float))
    for u, v, w in edges:
        cap[u][v] += w
        cap[v][u] += w
    while True:
        back, queue = {s: s}, deque([s])
        while queue and t not in back:
            u = queue.popleft()
            for v in sorted(cap[u]):
                if v not in back and cap[u][v] > 1e-12:
                    back[v] = u
                    queue.append(v)
        if t not in back:
            side = set(back)
            return {(min(u, v), max(u, v)) for u, v, _ in edges if (u in side) != (v in side)}
        flow, v = float("inf"), t
        while v != s:
            flow, v = min(flow, cap[back[v]][v]), back[v]
        v = t
        while v != s:
            u = back[v]
            cap[u][v] -= flow
            cap[v][u] += flow
            v = u


def reachable(edges: Edges, s: int, t: int) -> bool:
    """Whether a path joins s and t."""
    adj = adjacency(edges)
    seen, stack = {s}, [s]
    while stack:
        u = stack.pop()
        if u == t:
            return True
        stack += [v for v in adj[u] if v not in seen]
        seen.update(adj[u])
    return s == t


def _bits(x: int) -> Iterator[int]:
    """Places of the bits of ``x``, lowest first."""
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def _unit_side(adj: list[int], s: int, t: int) -> int:
    """The side of s of its smallest minimum cut from t, as bits; ``adj`` holds each node's neighbours as bits, all capacities are 1.

    Any maximum flow leaves the same nodes in reach of s, so this is the side
    that ``min_cut`` finds. Flow by a common neighbour is taken at once, then
    by one edge between a neighbour of s and one of t, then by shortest paths.
    """
    both = adj[s] & adj[t]
    out, into = adj[s] & ~both & ~(1 << t), adj[t] & ~both & ~(1 << s)
    rest: dict[int, int] = {}  # what inner nodes with flow can still send to
    for x in _bits(out):
        y = adj[x] & into
        if y:
            y &= -y
            rest[x], out, into = adj[x] ^ y, out ^ (1 << x), into ^ y
    while out:
        seen, end = out | (1 << s) | (1 << t), None
        back, queue = dict.fromkeys(_bits(out), s), deque(_bits(out))
        while queue and end is None:
            u = queue.popleft()
            new = rest.get(u, adj[u]) & ~seen
            if new & into:
                end = next(_bits(new & into))
                back[end] = u
            else:
                seen |= new
                for v in _bits(new):
                    back[v] = u
                    queue.append(v)
        if end is None:
            return seen ^ (1 << t)
        into ^= 1 << end
        while back[end] != s:
            u, v = back[end], end
            if rest.get(v, adj[v]) >> u & 1:
                rest[u] = rest.get(u, adj[u]) & ~(1 << v)
            else:  # flow from v to u is taken back
                rest[v] |= 1 << u
            end = u
        out ^= 1 << end
    return 1 << s


def cut_apart(edges: Edges, apart: list[tuple[int, int]]) -> Edges:
    """What is left of ``edges`` when each pair of ``apart`` in turn that a path still joins is cut by its minimum cut.

    Equal to ``reachable`` and ``min_cut`` per pair. Where all capacities are
    1 and the graph is small or dense, neighbours are kept as bits; a cut
    splits one part into two that are connected, so reach is a lookup.
    """
    nodes = sorted({x for u, v, _ in edges for x in (u, v)})
    if any(w != 1 for _, _, w in edges) or len(nodes) ** 2 > 256 * len(edges) + (1 << 24):
        for s, t in apart:
            if reachable(edges, s, t):
                gone = min_cut(edges, s, t)
                edges = [x for x in edges if (x[0], x[1]) not in gone]
        return edges
    at = {x: i for i, x in enumerate(nodes)}
    adj = [0] * len(nodes)
    for u, v, _ in edges:
        if u != v:
            adj[at[u]] |= 1 << at[v]
            adj[at[v]] |= 1 << at[u]
    part, parts = [-1] * len(nodes), []
    for i in range(len(nodes)):
        if part[i] < 0:
            found = front = 1 << i
            while front:
                reach = 0
                for x in _bits(front):
                    reach |= adj[x]
                front = reach & ~found
                found |= front
            for x in _bits(found):
                part[x] = len(parts)
            parts.append(found)
    for u, v in apart:
        s, t = at.get(u), at.get(v)
        if s is None or t is None or s == t or part[s] != part[t]:
            continue
        whole, side = parts[part[s]], _unit_side(adj, s, t)
        few = min(side, whole ^ side, key=int.bit_count)
        parts[part[s]] = whole ^ few
        for x in _bits(few):
            for y in _bits(adj[x] & ~few):
                adj[y] ^= 1 << x
            adj[x] &= few
            part[x] = len(parts)
        parts.append(few)
    return [x for x in edges if x[0] == x[1] or adj[at[x[0]]] >> at[x[1]] & 1]


# --- small learners ----------------------------------------------------------------------------


class Tree:
    """A binary classification tree on Gini impurity, for training sets of at most a few thousand rows."""

    def __init__(self, depth: int = 32, min_leaf: int = 1, features: int | None = None, seed: int = 0) -> None:
        self.depth, self.min_leaf, self.features, self.rnd = depth, min_leaf, features, np.random.default_rng(seed)
        self.feature, self.cut, self.left, self.right, self.p = [], [], [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        """Grow from features ``x`` and 0/1 labels ``y``."""
        self._grow(x, y.astype(float), np.arange(len(y)), 0)
        for name in ("feature", "cut", "left", "right", "p"):
            setattr(self, name, np.array(getattr(self, name)))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, at: np.ndarray, depth: int) -> int:
        me = len(self.p)
        for name, v in (("feature", -1), ("cut", 0.0), ("left", -1), ("right", -1), ("p", float(y[at].mean()))):
            getattr(self, name).append(v)
        if depth >= self.depth or len(at) < 2 * self.min_leaf or y[at].min() == y[at].max():
            return me
        best = (1e-12, -1, 0.0)
        n, pos = len(at), y[at].sum()
        whole = 2 * pos * (n - pos) / n
        cols = np.arange(x.shape[1]) if self.features is None else self.rnd.permutation(x.shape[1])
        for tried, f in enumerate(cols):
            if self.features is not None and tried >= self.features and best[1] >= 0:
                break  # further features are only drawn while none splits
            order = np.argsort(x[at, f], kind="stable")
            v, c = x[at[order], f], np.cumsum(y[at[order]])
            k = np.flatnonzero(v[1:] > v[:-1]) + 1
            k = k[(k >= self.min_leaf) & (n - k >= self.min_leaf)]
            if len(k):
                l, r = c[k - 1], pos - c[k - 1]
                gain = whole - 2 * l * (k - l) / k - 2 * r * (n - k - r) / (n - k)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), int(f), float((v[k[i] - 1] + v[k[i]]) / 2))
        if best[1] < 0:
            return me
        mask = x[at, best[1]] <= best[2]
        self.feature[me], self.cut[me] = best[1], best[2]
        self.left[me] = self._grow(x, y, at[mask], depth + 1)
        self.right[me] = self._grow(x, y, at[~mask], depth + 1)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Share of label 1 in the leaf of each row."""
        node = np.zeros(len(x), np.int64)
        while True:
            open_ = self.feature[node] >= 0
            if not open_.any():
                return self.p[node]
            rows = np.flatnonzero(open_)
            n = node[rows]
            go = x[rows, self.feature[n]] <= self.cut[n]
            node[rows] = np.where(go, self.left[n], self.right[n])


def committee(x: np.ndarray, y: np.ndarray, k: int, seed: int = 0, features: int | None = None) -> list[Tree]:
    """``k`` trees on bootstrap samples."""
    rnd = np.random.default_rng(seed)
    out = []
    for i in range(k):
        at = rnd.integers(0, len(y), len(y))
        out.append(Tree(seed=seed + i, features=features).fit(x[at], y[at]))
    return out


def vote(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """Share of trees that vote for 1."""
    return np.mean([t.predict(x) >= 0.5 for t in trees], axis=0) if trees else np.zeros(len(x))


def farthest_first(points: np.ndarray, k: int, seed: int = 0, initial: np.ndarray | None = None) -> list[int]:
    """Indices of ``k`` points, each of least average cosine to those before it (and to ``initial`` points)."""
    norm = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    sums, chosen = np.zeros(len(points)), []
    if initial is not None and len(initial):
        sums = norm @ (initial / np.maximum(np.linalg.norm(initial, axis=1, keepdims=True), 1e-12)).T.sum(1)
    elif len(points):
        chosen = [int(np.random.default_rng(seed).integers(len(points)))]
        sums = norm @ norm[chosen[0]]
    while len(chosen) < min(k, len(points)):
        free = sums.copy()
        free[chosen] = np.inf
        at = int(free.argmin())
        chosen.append(at)
        sums = sums + norm @ norm[at]
    return chosen
