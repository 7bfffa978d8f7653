"""Readers and writers over small files, model reuse end to end, and the stream."""

import gzip
import json
import random

import numpy as np
from pyspark.sql import functions as F

from linkspark.operators import kernels
from linkspark.plans import reuse, staging
from linkspark.sources import features, graphs, offers, records
from linkspark.streaming import arrivals


def test_record_csv(spark, tmp_path):
    with gzip.open(tmp_path / "r.csv.gz", "wt") as f:
        f.write("rec_id,name,city\nR1, Anna ,Rome\nr2,Bob,\nr1,ANNA B,Oslo\n")
    got = {r.rec_id: (r.name, r.city) for r in records.read_records(spark, f"file://{tmp_path}/r.csv.gz", "rec_id").collect()}
    assert got == {"r1": ("anna b", "oslo"), "r2": ("bob", "")}
    assert {r.city for r in records.read_records(spark, f"file://{tmp_path}/r.csv.gz", "rec_id", ["name"]).collect()} == {""}
    assert records.duplicate_ids(spark, f"file://{tmp_path}/r.csv.gz", "rec_id") == 1
    (tmp_path / "t.csv").write_text("A1,B1\na1,b1\nb1,a1\n")
    assert {(r.id_a, r.id_b) for r in records.read_truth(spark, f"file://{tmp_path}/t.csv").collect()} == {("a1", "b1"), ("b1", "a1")}


def test_graph_folders(spark, tmp_path):
    j = tmp_path / "json"
    j.mkdir()
    (j / "vertices.json").write_text("\n".join(json.dumps({"id": f"v{i}", "data": {"srcId": "ab"[i % 2], "recId": "r", "x": str(i)}}) for i in range(4)))
    (j / "edges.json").write_text("\n".join(json.dumps({"source": a, "target": b, "data": {"value": 0.5}}) for a, b in (("v0", "v1"), ("v0", "v2"), ("v1", "gone"))))
    e, edges = graphs.read_graph(spark, f"file://{j}")
    assert e.count() == 4 and {(r.u, r.v, r.sim) for r in edges.collect()} == {("v0", "v1", 0.5), ("v0", "v2", 0.5)}
    e, edges = graphs.read_graph(spark, f"file://{j}", ("a", "a"))
    assert {r.iri for r in e.collect()} == {"v0", "v2"} and edges.count() == 1 and e.first().props["x"] == "0"
    c = tmp_path / "csv"
    c.mkdir()
    (c / "metadata.csv").write_text("v;s1;gtId:string,name:string,size:double\ne;x;y\n")
    (c / "vertices.csv").write_text("v1;l;s1;g1|a\\;b\\|c|1.50\nv2;l;s1;g2||\n")
    (c / "edges.csv").write_text("e1;l;v1;v2;;0.7\ne2;l;v1;v9;;0.1\n")
    e, edges = graphs.read_graph(spark, f"file://{c}")
    got = {r.iri: (r.rec_id, r.props) for r in e.collect()}
    assert got["v1"] == ("g1", {"gtId": "g1", "name": "a;b|c", "size": "1.5"}) and got["v2"][1]["size"] == ""
    assert [(r.u, r.v, r.sim) for r in edges.collect()] == [("v1", "v2", 0.7)]


def test_offers_and_labels(spark, tmp_path):
    lines = [{"nodeID": "n1", "url": "https://shop.x/p", "schema.org_properties": [{"/name": "[Foo-1, Bar]"}, {"/name": "[Last]"}]}, {"nodeID": "n2", "url": "nohost", "schema.org_properties": []}, {"nodeID": "n3", "url": "http://b.y?q", "schema.org_properties": [{"/brand": "[null]"}]}]
    with gzip.open(tmp_path / "o.json.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, lines)))
    (tmp_path / "l.txt").write_text("n1 https://shop.x/p#####n3 http://b.y?q#####1\nz#####a#####0\n")
    links = offers.read_labels(spark, f"file://{tmp_path}/l.txt")
    assert {(r.lo, r.hi, r.label) for r in links.collect()} == {("n1 https://shop.x/p", "n3 http://b.y?q", True), ("a", "z", False)}
    got = {r.source: r.props for r in offers.read_offers(spark, f"file://{tmp_path}/o.json.gz").collect()}
    assert got == {"https://shop.x": {"name": "Last"}, "http://b.y": {"brand": ""}}
    assert offers.read_offers(spark, f"file://{tmp_path}/o.json.gz", links.where("not label")).count() == 0
    offers.write_kept_lines(spark, f"file://{tmp_path}/o.json.gz", links, f"file://{tmp_path}/kept")
    assert spark.read.text(f"file://{tmp_path}/kept").count() == 2
    assert offers.read_link_sets(spark, f"file://{tmp_path}/l.txt", f"file://{tmp_path}/l.txt").groupBy("part").count().count() == 2


def test_feature_and_task_files(spark, tmp_path):
    d = tmp_path / "f"
    d.mkdir()
    (d / "a_b.csv").write_text("source_id,target_id,pair,label,x,y\n1,2,p,True,0.5,\n3,4,q,False,1,-1\n")
    f = features.read_feature_files(spark, f"file://{d}")
    got = {r.id_a: (r.src_a, r.src_b, r.label, r.features) for r in f.collect()}
    assert got == {"1": ("a", "b", True, [0.5, None]), "3": ("a", "b", False, [1.0, -1.0])}
    tasks = f"file://{tmp_path}/tasks"
    rows = spark.createDataFrame([("a", "b", "1", "2", [0.1]), ("a", "a", "1", "3", [0.2])], "src_a string, src_b string, id_a string, id_b string, features array<double>")
    features.write_tasks(rows, tasks)
    assert features.read_tasks(spark, tasks).count() == 2 and features.read_tasks(spark, tasks, across_only=True).first().id_b == "2"
    features.append_result(spark, f"file://{tmp_path}/res", {"test": "ks", "f1": 0.5})
    features.append_result(spark, f"file://{tmp_path}/res", {"test": "psi", "f1": 0.6})
    assert sum(r.n for r in features.rows_per_file(spark, f"file://{tmp_path}/res").collect()) == 2
    (tmp_path / "tr.csv").write_text("source_id,target_id,label,unsupervised_label\n1,2,True,False\n")
    (tmp_path / "te.csv").write_text("source_id,target_id,label\n3,4,0\n")
    assert {tuple(r) for r in features.read_pair_labels(spark, f"file://{tmp_path}/tr.csv", f"file://{tmp_path}/te.csv").collect()} == {("train", "1", "2", True, False), ("test", "3", "4", False, None)}
    scaled = [r.features for r in features.rescaled_features(spark.createDataFrame([([0.0, 5.0],), ([2.0, -1.0],), ([1.0, 10.0],)], "features array<double>"), [1]).collect()]
    assert scaled == [[0.0, 1.0], [1.0, -1.0], [0.5, 0.0]]
    d = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "token string, vector array<double>")
    d.write.parquet(f"file://{tmp_path}/emb")
    m = features.mean_embedding(spark.createDataFrame([(1, ["x", "y", "x", "?"])], "i long, t array<string>"), "i", F.col("t"), features.read_embeddings(spark, f"file://{tmp_path}/emb")).first()
    assert m.vector == [0.5, 0.5]


def linkage_tasks(spark, n=120):
    """Eight tasks of two families: in one the first feature tells matches, in the other the second."""
    rnd = random.Random(7)
    rows, gold = [], []
    sources = "abcdefgh"
    for k in range(8):
        s, t = sources[k], sources[(k + 3) % 8]
        s, t = min(s, t), max(s, t)
        family = k % 2
        for i in range(n):
            match = i % 4 == 0
            sharp, flat = rnd.gauss(0.85 if match else 0.2, 0.06), rnd.gauss(0.5 if family else 0.9, 0.03)
            f = [sharp, flat, 0.5] if family == 0 else [flat, sharp, 0.1]
            a, b = f"{s}{k}_{i}", f"{t}{k}_{i}"
            rows.append((s, t, a, b, [min(1.0, max(0.0, x)) for x in f]))
            if match:
                gold.append((min(a, b), max(a, b)))
    return spark.createDataFrame(rows, arrivals.PAIRS), spark.createDataFrame(gold, "lo string, hi string")


def test_reuse_end_to_end(spark):
    pairs, gold = linkage_tasks(spark)
    cfg = reuse.ReuseConfig(test="ks", total_budget=240, min_budget=20, batch=10, committee=8, new_task_budget=30, ratio=0.6)
    predicted, registry = reuse.run(pairs, gold, cfg)
    overall, per_model = reuse.evaluate(predicted, gold)
    r = overall.first()
    assert r.f1 > 0.9 and per_model.count() >= 1
    assert sum(len(x) for x in registry.training.values()) <= 240 + 4 * 30
    again, _ = reuse.run(pairs, gold, cfg)
    assert {tuple(x) for x in again.select("id_a", "match").collect()} == {tuple(x) for x in predicted.select("id_a", "match").collect()}


def test_stream_holds_tasks_back(spark, tmp_path):
    pairs, _ = linkage_tasks(spark, 40)
    rnd = np.random.default_rng(0)
    x = rnd.uniform(size=(60, 3))
    registry = reuse.Registry({"m": kernels.committee(x, (x[:, 0] > 0.5).astype(float), 5)}, {"m": x}, {"m": ["m"]})
    tasks = sorted({(r.src_a, r.src_b) for r in pairs.select("src_a", "src_b").distinct().collect()})
    folder = tmp_path / "in"
    for i, (a, b) in enumerate(tasks):
        pairs.where((F.col("src_a") == a) & (F.col("src_b") == b)).coalesce(1).write.mode("append").parquet(f"file://{folder}")
    state = arrivals.Arrivals(registry, {"a"}, f"file://{tmp_path}/out", f"file://{tmp_path}/wait", reuse.ReuseConfig(test="wasserstein"))
    q = arrivals.start(arrivals.read_stream(spark, f"file://{folder}", 2), state, f"file://{tmp_path}/cp")
    q.awaitTermination()
    done = {(r.src_a, r.src_b) for r in spark.read.option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/out").select("src_a", "src_b").distinct().collect()}
    reach, grown = {"a"}, True
    while grown:
        more = {s for t in tasks if set(t) & reach for s in t}
        grown = not more <= reach
        reach |= more
    assert done == {t for t in tasks if set(t) & reach}
    assert spark.read.option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/out").count() == pairs.count()


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    pairs, _ = linkage_tasks(spark, 40)
    x = np.random.default_rng(0).uniform(size=(60, 3))
    tasks = sorted({(r.src_a, r.src_b) for r in pairs.select("src_a", "src_b").distinct().collect()})
    far, link = next((f, t) for f in tasks for t in tasks if len(set(f) & set(t)) == 1)
    hub = next(iter(set(link) - set(far)))
    folder, out, wait = (f"file://{tmp_path}/{n}" for n in ("in", "out", "wait"))

    def fresh():  # as a new driver would start: nothing but models and the first sources
        registry = reuse.Registry({"m": kernels.committee(x, (x[:, 0] > 0.5).astype(float), 5)}, {"m": x}, {"m": ["m"]})
        return arrivals.Arrivals(registry, {hub}, out, wait, reuse.ReuseConfig(test="wasserstein"))

    def arrive(task):
        pairs.where((F.col("src_a") == task[0]) & (F.col("src_b") == task[1])).coalesce(1).write.mode("append").parquet(folder)
        state = fresh()
        arrivals.start(arrivals.read_stream(spark, folder), state, f"file://{tmp_path}/cp").awaitTermination()
        return state

    assert not (tmp_path / "out").exists()
    held = arrive(far)
    assert held.held and not (tmp_path / "out").exists()
    state = arrive(link)
    name = {"|".join(t) for t in (far, link)}
    assert {r.task for r in spark.read.parquet(out).select("task").distinct().collect()} == name
    assert set(state.registry.members["m"]) == {"m"} | name and {*far, *link} <= state.ready
    before = spark.read.parquet(out).count()
    repeated = fresh()  # the last batch once more, as after a loss between its end and the commit
    repeated.batch(pairs.where((F.col("src_a") == link[0]) & (F.col("src_b") == link[1])), 1)
    assert spark.read.parquet(out).count() == before and repeated.registry.members == state.registry.members


def test_staging_is_released(spark):
    a = staging.stage(spark.range(10), "x")
    assert a.count() == 10 and staging.release(spark) >= 1
    hinted = lambda d: "strategy=broadcast" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(staging.broadcast_if_small(spark.range(5), 8))
    assert not hinted(staging.broadcast_if_small(spark.range(5), 8, limit=10))
