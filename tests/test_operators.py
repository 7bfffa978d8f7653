"""Relational operators against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkspark.functions.registry import Comparison, ComparisonSpec
from linkspark.operators import active, classify, distribution, evaluation, graph, keylearning, pairs, scores, transfer
from linkspark.operators.components import connected_components
from linkspark.plans import budget


def naive_components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 1), (2, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)] + [(i, 100 + i) for i in range(1, 40, 3)], "random"])
def test_components(spark, edges):
    if edges == "random":
        rnd = random.Random(4)
        edges = [(rnd.randrange(90), rnd.randrange(90)) for _ in range(70)]
    got = connected_components(spark.createDataFrame([*edges, (None, 5)], "u long, v long")).collect()
    assert {r.node: r.component for r in got} == naive_components(edges) and len(got) == len({r.node for r in got})


RECORDS = [("a", 1, "x", "anna"), ("a", 2, "x", "bob"), ("b", 3, "x", "anna"), ("b", 4, "", "bob"), ("c", 5, None, "zoe"), ("c", 6, "x", "ana"), ("a", 7, "y", "li")]


def test_candidates_and_features(spark):
    r = spark.createDataFrame(RECORDS, "source string, rec_id int, bkv string, name string")
    keyed = pairs.with_keys(r, F.col("bkv"))
    want = {(a[1], b[1]) for a, b in itertools.product(RECORDS, RECORDS) if a[2] and a[2] == b[2] and a[0] < b[0]}
    inside = want | {(1, 2)}
    for salts in (1, 3):
        assert {(x.id_a, x.id_b) for x in pairs.candidates(keyed, salts=salts).collect()} == want
        assert {(x.id_a, x.id_b) for x in pairs.candidates(keyed, intra=True, salts=salts).collect()} == inside
    spec = ComparisonSpec([Comparison("dice", "name"), Comparison("exact", "name")])
    one = {(x.id_a, x.id_b): x.features for x in pairs.block_join(keyed, spec).collect()}
    two = {(x.id_a, x.id_b): x.features for x in pairs.compare(pairs.candidates(keyed), r, spec).collect()}
    assert one == two and one[1, 3] == [1.0, 1.0] and one[2, 3][1] == 0.0
    stats = pairs.block_statistics(keyed).first()
    assert (stats.blocks, stats.min_size, stats.max_size) == (2, 1, 4)
    multi = pairs.with_keys(r, F.array(F.col("bkv"), F.col("name")))
    assert {(x.id_a, x.id_b) for x in pairs.candidates(multi).collect()} == want | {(2, 4), (1, 3)}
    p = spark.createDataFrame([(1, 3), (3, 1), (9, 1), (4, 2)], "x int, y int")
    a, b = (r.where(F.col("source") == s) for s in "ab")
    assert {(x.lo, x.hi, x.id_a, x.id_b) for x in pairs.given_pairs(p, a, b).collect()} == {(1, 3, 1, 3), (2, 4, 2, 4)}


def test_keys_are_learnt(spark):
    rnd = random.Random(0)
    a = [(i, f"n{i}", rnd.choice("xy"), f"c{rnd.randrange(30)}") for i in range(60)]
    b = [(i + 100, n if i % 4 else "?", k, c) for i, n, k, c in a]
    da, db = (spark.createDataFrame(x, "rec_id int, name string, kind string, city string") for x in (a, b))
    gold = spark.createDataFrame([(i, i + 100) for i in range(60)], "id_a int, id_b int")
    cols = {c: F.col(c) for c in ("name", "kind", "city")}
    chosen = keylearning.select_keys(da, db, gold, cols, 40, eps=0.05)
    assert chosen[0] in ("name", "city") and "kind" not in chosen
    sample = keylearning.sample_pairs(da, db, gold, 20)
    rows = sample.collect()
    assert sum(r.label for r in rows) == 20 and all(r.label == (r.id_b - r.id_a == 100) for r in rows)
    v = keylearning.agreement(sample, da, db, cols)
    f = {r.key: r.score for r in keylearning.fisher(v).collect()}
    for key in cols:
        x = {k: np.array([r.agrees for r in v.collect() if r.key == key and r.label == k]) for k in (0, 1)}
        m = np.concatenate([x[0], x[1]]).mean()
        low = sum(len(y) * y.var() ** 2 for y in x.values())
        assert abs(f[key] - sum(len(y) * (y.mean() - m) ** 2 for y in x.values()) / (low or 1e-6)) < 1e-6 * max(1, f[key])


def test_evaluation(spark):
    predicted = spark.createDataFrame([(1, 2, True), (1, 3, False), (2, 3, True), (4, 5, False)], "id_a int, id_b int, match boolean")
    gold = spark.createDataFrame([(1, 2), (1, 3), (8, 9)], "id_a int, id_b int")
    c = evaluation.confusion(predicted, gold, 10).first()
    assert (c.tp, c.fp, c.fn, c.tn) == (1, 1, 2, 6) and abs(c.f1 - 0.4) < 1e-9 and abs(c.f_star - 0.25) < 1e-9 and c.accuracy == 0.7
    b = evaluation.blocking_quality(predicted, gold, 100).first()
    assert (round(b.reduction_ratio, 6), round(b.pairs_completeness, 6), b.pairs_quality) == (0.96, 0.666667, 0.5)
    assert evaluation.blocking_quality(predicted.limit(0), gold.limit(0), 0).first().reduction_ratio == 1
    per = {r.leader: (r.tp, r.fp, r.fn, r.f1) for r in evaluation.per_group(predicted.withColumn("leader", F.col("id_a") % 2), gold, "leader", ("id_a", "id_b")).collect()}
    assert per == {1: (1, 0, 1, 2 / 3), 0: (0, 1, 0, 0.0)}
    links = evaluation.cluster_links(spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "c string, i int"), "c", "i")
    assert {(r.lo, r.hi) for r in links.collect()} == {(1, 2), (1, 3), (2, 3)}


A, B = [0, 0.1, 0.2, 0.2, 0.5, 1], [0, 0, 0.3, 0.4, 0.9]


def test_distribution_statistics(spark):
    rows = [("s", "t", f"a{i}", "b", [float(x), 1.0]) for i, x in enumerate(A)] + [("u", "v", f"a{i}", "b", [float(x), 1.0]) for i, x in enumerate(B)]
    f = spark.createDataFrame(rows, "src_a string, src_b string, id_a string, id_b string, features array<double>")
    hist = distribution.histogram(f)
    tp = spark.createDataFrame([("s|t", "u|v")], "task_a string, task_b string")
    t = {r.feature: r for r in distribution.with_ks_p(distribution.ks_and_wasserstein(hist, tp)).collect()}
    assert abs(t[0].ks - 0.266667) < 1e-6 and abs(t[0].wasserstein - 0.106667) < 1e-6 and (t[1].ks, t[1].wasserstein, t[1].p_value) == (0, 0, 1)
    p = {r.feature: r for r in distribution.psi(hist, tp).collect()}
    assert abs(p[0].psi - 17.778767) < 1e-5 and abs(p[1].psi) < 1e-9 and abs(distribution.PSI_SCALE - 27.631023) < 1e-5
    s = distribution.similarity(distribution.long_form(distribution.psi(hist, tp), "psi_scaled", "psi")).first()
    assert s.similarity == 0.5 and abs(s.avg_similarity - (1 + 1 - 17.778767 / 27.631023) / 2) < 1e-5
    faithful = distribution.similarity(distribution.long_form(distribution.psi(hist, tp), "psi_scaled", "psi"), faithful=True).first()
    assert abs(faithful.avg_similarity - (1 - 17.778767 / 27.631023)) < 1e-5


def test_distribution_against_numpy(spark):
    rnd = np.random.default_rng(2)
    x, y = rnd.normal(size=200).round(1), rnd.normal(0.4, 1.2, 150).round(1)
    rows = [("s", "t", "a", "b", [float(v)]) for v in x] + [("u", "v", "a", "b", [float(v)]) for v in y]
    hist = distribution.histogram(spark.createDataFrame(rows, "src_a string, src_b string, id_a string, id_b string, features array<double>"))
    t = distribution.ks_and_wasserstein(hist, spark.createDataFrame([("s|t", "u|v")], "task_a string, task_b string")).first()
    grid = np.unique(np.concatenate([x, y]))
    fx, fy = (np.searchsorted(np.sort(z), grid, "right") / len(z) for z in (x, y))
    assert abs(t.ks - np.abs(fx - fy).max()) < 1e-12
    assert abs(t.wasserstein - (np.abs(fx - fy)[:-1] * np.diff(grid)).sum()) < 1e-9
    edges = np.histogram_bin_edges(np.concatenate([x, y]), bins=100)
    p, q = (np.histogram(z, edges)[0] / len(z) for z in (x, y))
    want = ((p - q) * np.log((p + 1e-6) / (q + 1e-6))).sum()
    got = distribution.psi(hist, spark.createDataFrame([("s|t", "u|v")], "task_a string, task_b string")).first().psi
    assert abs(got - want) < 0.35  # values on an edge may fall to either side


def test_mmd(spark):
    rnd = np.random.default_rng(1)
    x, y = rnd.normal(size=(20, 3)), rnd.normal(1, 1, (15, 3))
    k = lambda a, b: np.exp(-0.3 * ((a[:, None] - b[None]) ** 2).sum(2))
    want = k(x, x).sum() / (20 * 19) - 2 * k(x, y).sum() / 300 + k(y, y).sum() / (15 * 14)
    dx, dy = (spark.createDataFrame([(v.tolist(),) for v in z], "vector array<double>") for z in (x, y))
    assert abs(distribution.mmd(dx, dy, 0.3).first().mmd2 - want) < 1e-9
    both = dx.selectExpr("'p' as pair", "0 as side", "vector").unionByName(dy.selectExpr("'p' as pair", "1 as side", "vector"))
    whole = distribution.mmd_permutation_blocks(both, 0.3, 60, block=7).first()
    assert abs(whole.mmd - distribution.mmd(both.where("side = 0"), both.where("side = 1"), 0.3).first().mmd) < 1e-9
    r = distribution.mmd_permutation(both, 0.3, 60).first()
    assert abs(whole.p_value - r.p_value) < 0.15
    assert abs(r.mmd**2 - want) < 1e-9 and r.p_value < 0.06


def naive_otsu(values, kind):
    s = sorted(values, reverse=True)
    n = len(s)
    hist = np.histogram(s, bins=n, range=(0.0, 1.0))[0] / n
    rounded = [round(x, 2) for x in s]
    top = max(rounded.count(x) for x in rounded)
    best, at = -999, -1.0
    for t in range(1, n - 1):
        q1, q2 = hist[:t].sum(), hist[t:].sum()
        if q1 > 1e-12 and q2 > 1e-12:
            m1, m2 = (np.arange(t) * hist[:t]).sum() / q1, (np.arange(t, n) * hist[t:]).sum() / q2
            v = q1 * (1 - q1) * (m1 - m2) ** 2
            v *= 1 - rounded.count(round(s[t], 2)) / top if kind == "valley" else 1
            if v > best + 1e-9:
                best, at = v, s[t]
    return at


@pytest.mark.parametrize("seed", range(4))
def test_thresholds(spark, seed):
    rnd = random.Random(seed)
    v = [min(1.0, max(0.0, rnd.gauss(0.25 if rnd.random() < 0.6 else 0.75, 0.1))) for _ in range(80)]
    df = spark.createDataFrame([(x,) for x in v], "s double")
    assert abs(scores.threshold(df, "s", "otsu") - naive_otsu(v, "otsu")) < 1e-9
    assert abs(scores.threshold(df, "s", "valley") - naive_otsu(v, "valley")) < 1e-9
    o = sorted(v)
    dx, dy = len(o) - 1, o[-1] - o[0]
    far = [abs(dx * (y - o[0]) - dy * i) for i, y in enumerate(o)]
    assert scores.threshold(df, "s", "elbow") == o[int(np.argmax(far))] and scores.threshold(df, "s", "static") == 0.5
    lab = spark.createDataFrame([(x, int(x > 0.5)) for x in v], "s double, y int")
    scan = {round(r.threshold, 2): r for r in scores.threshold_scan(lab, "s", "y").collect()}
    for t in (0.0, 0.3, 0.5, 0.77, 1.0):
        assert scan[t].fp == sum(x >= t and x <= 0.5 for x in v) and scan[t].fn == sum(x < t and x > 0.5 for x in v)


def test_link_types_and_clusters(spark):
    src = {1: "A", 2: "B", 3: "B", 4: "A", 5: "C"}
    e = [(1, 2, 0.9), (1, 3, 0.8), (3, 4, 0.7), (2, 4, 0.9), (4, 5, 0.5)]
    edges, nodes = spark.createDataFrame(e, "u int, v int, sim double"), spark.createDataFrame(list(src.items()), "node int, source string")
    kind = {(r.u, r.v): r.kind for r in graph.link_types(edges, nodes).collect()}

    def best(u, other):
        return max(s for a, b, s in e for x, y in ((a, b), (b, a)) if x == u and src[y] == other)

    want = {(u, v): n for u, v, s in e for n in [(s == best(u, src[v])) + (s == best(v, src[u]))]}
    assert kind == {k: "strong" if n == 2 else "normal" for k, n in want.items() if n}
    assert {(r.u, r.v) for r in graph.link_types(edges, nodes, normal=False).collect()} == {k for k, n in want.items() if n == 2}
    comp = {r.node: r.component for r in graph.clusters(nodes, edges.where("sim > 0.85")).collect()}
    assert comp == {1: 1, 2: 1, 4: 1, 3: 3, 5: 5}


def test_correspondence_cuts_labelled_nonmatches(spark):
    rows = [(1, 2, True, 0.9, None), (2, 3, True, 0.6, None), (3, 4, True, 0.95, True), (1, 3, False, 0.9, False), (7, 8, True, 0.7, False), (5, 6, False, 0.9, None)]
    p = spark.createDataFrame(rows, "u int, v int, predicted boolean, probability double, label boolean")
    assert {(r.u, r.v) for r in graph.correspondence(p).collect()} == {(1, 2), (3, 4)}


def test_task_graph_and_ranking(spark):
    sims = spark.createDataFrame([("t1", "t2", 1.0, 0.9), ("t2", "t3", 0.5, 0.4), ("t1", "t3", 1.0, 0.8)], "task_a string, task_b string, similarity double, avg_similarity double")
    sizes = spark.createDataFrame([("t1", 10, False), ("t2", 50, False), ("t3", 90, True), ("t4", 5, False)], "task string, n long, intra boolean")
    nodes, edges = graph.task_graph(sizes, sims)
    assert {(r.u, r.v) for r in edges.collect()} == {(1, 2), (1, 3)} and nodes.count() == 4
    for method in graph.DETECTORS:
        m = {r.node: r.community for r in graph.communities(nodes, edges, method).collect()}
        assert set(m) == {1, 2, 3, 4} and m[4] not in (m[1], m[2])
    member = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "node long, community long")
    ranked = graph.representatives(member, nodes, sizes, graph.centrality(edges, member, "betweenness")).collect()
    first = {r.community: r for r in ranked if r["rank"] == 1}
    assert first[1].task == "t1" and first[4].leader == "t4" and next(r for r in ranked if r.task == "t3").score == -1
    by_size = {r.community: r.task for r in graph.representatives(member, nodes, sizes).collect() if r["rank"] == 1}
    assert by_size == {1: "t2", 4: "t4"}
    q = graph.modularity(edges, member).first()[0]
    assert -0.5 <= q <= 1
    pr = {r.node: r["rank"] for r in graph.pagerank_rounds(edges, nodes, 30).collect()}
    assert abs(sum(pr.values()) - 1) < 1e-9 and pr[1] == max(pr.values())


def test_budget(spark):
    sizes = spark.createDataFrame([("a", 100, False), ("b", 300, False), ("c", 50, False), ("d", 50, False)], "task string, n long, intra boolean")
    ranked = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.5), ("c", "c", 1.0), ("d", "d", 1.0)], "leader string, task string, score double")
    got = {r.leader: r.budget for r in budget.allocate(ranked, sizes, 10, 130).collect()}
    # 100 left: half of the tasks are in the community, so it gets 50, the single tasks 25 each
    assert got == {"a": 60, "c": 35, "d": 35}
    with pytest.raises(ValueError):
        budget.allocate(ranked, sizes, 200, 100)
    tight = budget.allocate(ranked, sizes, 10, 25)
    sims = spark.createDataFrame([("a", "c", 0.9), ("d", "b", 0.2)], "task_a string, task_b string, avg_similarity double")
    new, budgets = budget.merge_singletons(tight, sims, ranked, sizes, 10)
    b = {r.leader: r.budget for r in budgets.collect()}
    assert "a" in b and set(b) <= {"a", "c", "d"} and "d" in b
    assert {r.task for r in new.collect()} == {"a", "b", "c", "d"}


def pool(spark, n=400, seed=0):
    rnd = np.random.default_rng(seed)
    x = rnd.uniform(size=(n, 3))
    y = (x[:, 0] + x[:, 1] > 1.4).astype(float)
    return spark.createDataFrame([(f"p{i}", v.tolist(), float(t), 1.0) for i, (v, t) in enumerate(zip(x, y))], "pair_id string, features array<double>, label double, inter double"), x, y


def test_committee_learns_within_budget(spark):
    df, x, y = pool(spark)
    got = active.bootstrap(df, 40, 10, 12)
    assert len(got.y) == 40 == len(set(got.ids)) and 0 < got.y.sum() < 40
    from linkspark.operators import kernels

    assert ((kernels.vote(kernels.committee(got.x, got.y, 20), x) >= 0.5) == y).mean() > 0.9
    again = active.bootstrap(df, 40, 10, 12)
    assert again.ids == got.ids


def test_strategies_and_batches(spark):
    rows = [(f"p{i}", "d1" if i < 4 else "d2", 0.1 * i, 0.5 - 0.05 * i, i % 2 == 0, i % 3 == 0, int((i % 2 == 0) != (i % 3 == 0)), 0.5, 1.0, 1.0) for i in range(8)]
    df = spark.createDataFrame(rows, "pair_id string, datasource_pair string, disagreement double, uncertainty double, predicted boolean, graph_label boolean, graph_vs_prediction int, frequency double, weight double, relatedness double")
    for s in active.STRATEGIES:
        for it in (0, 30):
            scored = active.informativeness(df, s, it, ["d1"])
            assert {"inf_score", "sel_weight"} <= set(scored.columns) and scored.count() == 8
            assert active.select_batch(scored, s, 3).count() == 3
    best = {r.pair_id for r in active.select_batch(active.informativeness(df, "disagreement"), "disagreement", 2).collect()}
    assert best == {"p7", "p6"}
    with pytest.raises(ValueError):
        active.informativeness(df, "nonsense")
    rel = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.95), ("b", "b", 1.0), ("b", "a", 0.2), ("c", "c", 1.0), ("c", "a", 0.0), ("a", "c", 0.1)], "task_a string, task_b string, score double")
    assert active.best_transfer(rel, 0.1) == ["a", "c"] and sorted(active.best_transfer(rel, 0.1, greedy=True)) == ["a", "c"]
    import itertools

    rnd = np.random.default_rng(8)
    for n in (4, 9, 13):
        m = np.round(rnd.random((n, n)), 2)
        table = spark.createDataFrame([(f"t{i:02}", f"t{j:02}", float(m[i, j])) for i in range(n) for j in range(n)], "task_a string, task_b string, score double")
        value = lambda s: float(m[list(s)].max(axis=0).mean()) - 0.03 * len(s)  # noqa: B023, E731
        want = max(value(s) for k in range(1, n + 1) for s in itertools.combinations(range(n), k))
        assert abs(value([int(t[1:]) for t in active.best_transfer(table, 0.03)]) - want) < 1e-12
    assert active.enough_tasks(["a"], {"a": 1, "b": 5}, 4) == ["a", "b"]


def test_graph_boosted_loop(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(150):
        same = i % 3 == 0
        f = [min(1.0, max(0.0, rnd.gauss(0.85 if same else 0.3, 0.08))) for _ in range(3)]
        rows.append((f"p{i}", f"a{i}", f"b{i if same else (i + 7) % 150}", f, f"s{i % 3}", same))
    df = spark.createDataFrame(rows, "pair_id string, u string, v string, features array<double>, datasource_pair string, label boolean")
    learners, labelled, log = active.graph_boosted(df, 24, 3, batch=12)
    assert labelled.count() == 24 + 6 and log[-1]["asked"] == 24
    x, y = np.array([r[3] for r in rows]), np.array([r[5] for r in rows])
    assert ((learners.probability(x) >= 0.5) == y).mean() > 0.95


def test_transfer_and_boost(spark):
    rnd = np.random.default_rng(3)

    def table(n, shift):
        x = np.clip(np.concatenate([rnd.normal(0.2 + shift, 0.05, (n, 2)), rnd.normal(0.8 + shift, 0.05, (n, 2))]), 0, 1)
        return spark.createDataFrame([(i, v.tolist(), int(i >= n)) for i, v in enumerate(x)], "id long, features array<double>, label int")

    src, tgt = table(60, 0.0), table(50, 0.02)
    s = {r.id: r for r in transfer.instance_scores(src, tgt, 5).collect()}
    assert len(s) == 120 and all(r.confidence == 1 and r.structure > 0.7 for r in s.values())
    got = transfer.transfer(src, tgt, 5, 0.9, 0.7, 0.9)
    assert all(r.prediction == (r.label == 1) for r in got.collect()) and got.count() == 100
    assert transfer.transfer(src.limit(10), tgt, 5) is None
    few = src.where("id % 4 = 0")
    more = transfer.boost(few, tgt).collect()
    truth = {r.id: r.label for r in tgt.collect()}
    assert all(truth[r.id] == r.label for r in more)
    info = {r.id: r for r in transfer.informative(few).collect()}
    assert len(info) == 30 and all(0 < r.reach <= 1 for r in info.values())


def test_rules_and_models(spark):
    df, x, y = pool(spark, 300)
    rows = df.withColumn("label", F.col("label"))
    for name in classify.CLASSIFIERS:
        model = classify.train(rows.select("features", "label"), name)
        p = classify.apply(rows.select("pair_id", "features", "label"), model)
        assert p.columns == ["pair_id", "features", "label", "prediction", "confidence"]
        assert p.where("prediction = (label = 1)").count() > 250
    tuned = classify.train(rows.select("features", "label"), "dt", tune=3, calibrate=True)
    assert classify.apply(rows.select("features", "label"), tuned).where("prediction = (label = 1)").count() > 270
    assert len(classify.importances(classify.train(rows.select("features", "label"), "rf"))) == 3
    f = spark.createDataFrame([([1.0, 1.0],), ([1.0, 0.4],), ([0.0, 0.0],)], "features array<double>")
    got = f.select(classify.exact_rule(), classify.mean_rule(0.7)[0], classify.min_rule(0.4)[0], classify.weighted_rule([3, 1], 0.8)[0]).collect()
    assert [list(r) for r in got] == [[True] * 4, [False, True, True, True], [False] * 4]
    m = {(r.train_task, r.test_task): r.f1 for r in classify.transfer_matrix(rows.select(F.when(F.col("pair_id") < "p2", "s").otherwise("t").alias("task"), "features", F.col("label").cast("int").alias("label")), ["s", "t"], 200, 5).collect()}
    assert len(m) == 4 and min(m.values()) > 0.7


def test_scores_and_profiles(spark):
    f = spark.createDataFrame([([0.5, -1.0],), ([1.0, 0.2],), ([0.0, 0.4],)], "features array<double>")
    assert [r[0] for r in f.select(scores.mean_present(F.col("features"))).collect()] == [0.5, 0.6, 0.2]
    for fn in (scores.score_by_deviation, scores.score_by_density, lambda d: scores.score_by_best_features(d, {"a": [0], "b": [1]})):
        v = [r.agg_score for r in fn(f).collect()]
        assert min(v) == 0 and max(v) == 1
    assert [scores.sources_of(n) for n in (0, 1, 3, 4, 6)] == [0, 2, 3, 4, 4]
    t = spark.createDataFrame([("12", "2020-01-01", "a b", "one two three four five six seven eight")], "n string, d string, s string, l string")
    assert {r.attribute: r.type for r in scores.column_types(t, t.columns).collect()} == {"n": "numeric", "d": "date", "s": "str", "l": "long_str"}


def test_running_sums(spark):
    from linkspark.plans.prefix import running

    rnd = random.Random(3)
    keys = sorted(rnd.sample(range(10_000), 500))
    df = spark.createDataFrame([(k, rnd.randrange(9)) for k in keys], "k long, n long").repartition(7)
    values, total, before = {r.k: r.n for r in df.collect()}, 0, None
    got = {r.k: r for r in running(df, "k", ["n"]).collect()}
    for k in keys:
        total += values[k]
        assert (got[k].run_n, got[k].prev) == (total, before)
        before = k


def test_seed_points_are_sought_among_all_rows(spark):
    rows = [(f"{i}", [1.0, 1.0 + i % 7 / 100]) for i in range(20_000)] + [("far", [-1.0, -1.0])]
    got = active.seed_points(spark.createDataFrame(rows, "pair_id string, features array<double>"), 2, seed=1)
    ids = {r.pair_id for r in got.collect()}
    assert len(ids) == 2 and "far" in ids


def test_overlapping_leaves_out_no_alike_sets(spark):
    rnd = np.random.default_rng(6)
    rows = []
    for i in range(120):
        base = [f"w{x}" * (1 + x % 3) for x in rnd.integers(0, 40, rnd.integers(0, 14))]
        rows.append((f"s{i % 3}", i, "b" if i % 2 else "c", sorted(set(base))))
    table = spark.createDataFrame(rows, "source string, rec_id long, bkv string, words array<string>").withColumn("words", pairs.word_keys(F.col("words")))
    found = {(r.id_a, r.id_b) for r in pairs.overlapping(table, 0.5).collect()}
    due = {(a[1], b[1]) for a in rows for b in rows if a[0] < b[0] and a[2] == b[2] and a[3] and b[3] and len(set(a[3]) & set(b[3])) / len(set(a[3]) | set(b[3])) >= 0.5}
    assert due and due <= found
