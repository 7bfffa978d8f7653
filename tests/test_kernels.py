"""Graph, statistics and tree kernels against naive versions."""

import itertools
import random
import time

import numpy as np
import pytest

from linkspark.operators import distribution, kernels


def random_graph(rnd, n=8, p=0.35):
    return [(u, v, rnd.randint(1, 5) / 5) for u, v in itertools.combinations(range(n), 2) if rnd.random() < p]


def parts(nodes, edges):
    seen, out = set(), []
    adj = kernels.adjacency(edges)
    for s in nodes:
        if s in seen:
            continue
        stack, comp = [s], set()
        while stack:
            u = stack.pop()
            if u not in comp:
                comp.add(u)
                stack += list(adj[u]) if u in adj else []
        seen |= comp
        out.append(frozenset(comp))
    return set(out)


def paths(edges, n):
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for u, v, w in edges:
        d[u, v] = d[v, u] = w
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k])
    return d


@pytest.mark.parametrize("seed", range(12))
def test_cuts_bridges_and_splits(seed):
    rnd = random.Random(seed)
    n = 8
    e = random_graph(rnd, n)
    whole = parts(range(n), e)
    naive = {(u, v) for u, v, w in e if len(parts(range(n), [x for x in e if x != (u, v, w)])) > len(whole)}
    assert kernels.bridges(e) == naive
    for s, t in itertools.combinations(range(n), 2):
        if kernels.reachable(e, s, t):
            cut = kernels.min_cut(e, s, t)
            assert not kernels.reachable([x for x in e if (x[0], x[1]) not in cut], s, t)
            value = sum(w for u, v, w in e if (u, v) in cut)
            best = min(sum(w for u, v, w in e if (u in side) != (v in side)) for k in range(n - 1) for rest in itertools.combinations([x for x in range(n) if x not in (s, t)], k) for side in [{s, *rest}])
            assert abs(value - best) < 1e-9
            break
    # the first split removes heaviest edges one at a time
    left, order = list(e), sorted(e, key=lambda x: (x[2], -x[0], -x[1]))
    while order and len(parts(range(n), left)) == len(whole):
        left.remove(order.pop())
    got = kernels.first_split(list(range(n)), e)
    groups = {frozenset(u for u in got if got[u] == c) for c in set(got.values())}
    assert groups == parts(range(n), left)


@pytest.mark.parametrize("seed", range(6))
def test_centralities(seed):
    rnd = random.Random(seed)
    n = 7
    e = random_graph(rnd, n, 0.5)
    d = paths(e, n)
    close = kernels.closeness(e, list(range(n)))
    for s in range(n):
        reach = [d[s, t] for t in range(n) if t != s and np.isfinite(d[s, t])]
        want = len(reach) / sum(reach) * len(reach) / (n - 1) if reach else 0.0
        assert abs(close[s] - want) < 1e-9
    assert abs(kernels.diameter(e) - d[np.isfinite(d)].max()) < 1e-9
    rank = kernels.pagerank(e, list(range(n)))
    assert abs(sum(rank.values()) - 1) < 1e-6
    between = kernels.betweenness(e, list(range(n)))

    def count(s, t):
        """Shortest paths and how many pass each inner node."""
        total, through = 0, np.zeros(n)
        stack = [(s, 0.0, (s,))]
        adj = kernels.adjacency(e)
        while stack:
            u, length, path = stack.pop()
            if length > d[s, t] + 1e-9:
                continue
            if u == t:
                total += 1
                for x in path[1:-1]:
                    through[x] += 1
                continue
            stack += [(v, length + w, (*path, v)) for v, w in adj[u].items() if v not in path]
        return total, through

    want = np.zeros(n)
    for s, t in itertools.permutations(range(n), 2):
        if np.isfinite(d[s, t]):
            total, through = count(s, t)
            want += through / total
    assert np.allclose([between[i] for i in range(n)], want / ((n - 1) * (n - 2)))


def modularity(e, part):
    m = sum(w for *_, w in e)
    deg = {}
    for u, v, w in e:
        deg[u] = deg.get(u, 0) + w
        deg[v] = deg.get(v, 0) + w
    return sum(w for u, v, w in e if part[u] == part[v]) / m - sum((sum(d for u, d in deg.items() if part[u] == c) / (2 * m)) ** 2 for c in set(part.values()))


@pytest.mark.parametrize("refine", [False, True])
def test_two_cliques_are_two_communities(refine):
    e = [(u, v, 1.0) for k in (0, 10) for u, v in itertools.combinations(range(k, k + 5), 2)] + [(0, 10, 0.1)]
    part = kernels.louvain(e, seed=3, refine=refine)
    assert len(set(part.values())) == 2 and part[0] != part[10] and part[0] == part[4]
    assert kernels.louvain(e, seed=3, refine=refine) == part
    lpa = kernels.label_propagation(e, 1)
    assert lpa[0] == lpa[4] != lpa[14]


@pytest.mark.parametrize("seed", range(10))
def test_communities_are_near_the_best_modularity(seed):
    e = random_graph(random.Random(seed), 7, 0.4)
    if not e:
        return
    nodes = sorted({x for u, v, _ in e for x in (u, v)})

    def partitions(xs):
        if not xs:
            yield []
            return
        for p in partitions(xs[1:]):
            yield [[xs[0]], *p]
            for i in range(len(p)):
                yield [*p[:i], [xs[0], *p[i]], *p[i + 1 :]]

    best = max(modularity(e, {u: i for i, g in enumerate(p) for u in g}) for p in partitions(nodes))
    for refine in (False, True):
        assert modularity(e, kernels.louvain(e, seed=seed, refine=refine)) >= best - 0.08


def test_exact_and_limiting_ks_p_values():
    def naive(d, m, n):
        total = hit = 0
        for pos in itertools.combinations(range(m + n), m):
            a, f, g, worst = set(pos), 0, 0, 0.0
            for i in range(m + n):
                f, g = (f + 1, g) if i in a else (f, g + 1)
                worst = max(worst, abs(f / m - g / n))
            total += 1
            hit += worst >= d - 1e-12
        return hit / total

    for m, n in ((3, 4), (5, 5), (2, 6), (6, 4)):
        for k in range(1, 11):
            assert abs(distribution.ks_p_value(k / 10, m, n) - naive(_reachable(k / 10, m, n), m, n)) < 1e-9
    # published critical value: D = 1.358 sqrt((m + n) / (m n)) at 5 %
    assert abs(distribution.ks_p_value(1.358 * (2 / 2000) ** 0.5, 2000, 2000) - 0.05) < 0.002


@pytest.mark.parametrize("seed", range(20))
def test_cuts_in_turn_equal_cuts_one_by_one(seed):
    """Unit capacities, sparse to dense, with a loop, an unknown node and several parts; other capacities go the plain way."""
    rnd = random.Random(seed)
    n, share = rnd.choice([6, 12, 25]), rnd.choice([0.12, 0.3, 0.8])
    every = list(itertools.combinations(range(0, 3 * n, 3), 2))
    e = sorted((u, v, 1.0 if seed % 5 else rnd.choice([0.5, 1.0])) for u, v in every if rnd.random() < share) + [(3, 3, 1.0)]
    apart = sorted([x for x in every if rnd.random() < 0.2 and x not in {(u, v) for u, v, _ in e}] + [(0, 10_000)])
    want = list(e)
    for s, t in apart:
        if kernels.reachable(want, s, t):
            gone = kernels.min_cut(want, s, t)
            want = [x for x in want if (x[0], x[1]) not in gone]
    assert kernels.cut_apart(e, apart) == want


def test_many_cuts_of_a_dense_graph_are_quick():
    """300 nodes, 40,000 edges, 4,500 pairs to part."""
    rnd = random.Random(5)
    every = list(itertools.combinations(range(300), 2))
    apart = [x for x in every if rnd.random() < 0.1]
    e = [(u, v, 1.0) for u, v in sorted(set(every) - set(apart))]
    start = time.process_time()
    left = kernels.cut_apart(e, apart)
    assert time.process_time() - start < 20
    found = parts(range(300), left)
    assert not any({s, t} <= set(p) for s, t in apart for p in found)


def _reachable(d, m, n):
    """The statistic's grid value that a rounding of d means."""
    import math

    lcm = m * n // math.gcd(m, n)
    return round(d * lcm) / lcm


def test_trees_learn_and_farthest_points_spread():
    rnd = np.random.default_rng(0)
    x = rnd.uniform(size=(300, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert (np.round(kernels.Tree().fit(x, y).predict(x)) == y).all()
    assert ((kernels.vote(kernels.committee(x, y, 15, 1), x) >= 0.5) == y).mean() > 0.95
    pts = np.array([[1, 0], [0.99, 0.01], [0, 1], [0.01, 0.99]], float)
    chosen = kernels.farthest_first(pts, 2, seed=0)
    assert {i // 2 for i in chosen} == {0, 1}
    assert kernels.farthest_first(pts, 1, initial=pts[:1])[0] in (2, 3) and len(kernels.farthest_first(pts, 9)) == 4
