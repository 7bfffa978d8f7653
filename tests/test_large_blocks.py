"""Queries over blocks too large for every pair to be made, against their SQL on odd tables."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from linkspark.operators import active, pairs


def _odd_parts(spark, folder, copies=1):
    """A part table with repeated keys, null keys, names, brands and types, and one large block; and its folder."""
    rng = random.Random(7)
    rows = [(i if rng.random() > 0.1 else rng.randrange(60), rng.choice(["old nut", "hot nut", "old bolt", "", None]), rng.choice(["B1", "B1", "B1", "B2", "B3", None]), rng.choice(["ECONOMY", "LARGE", "SMALL", None]), rng.randrange(1, 4), 900.0 + i % 5) for i in range(60 * copies)]
    rows += [(None, "old nut", "B1", "ECONOMY", 1, 900.0), (None, "old nut", "B2", "SMALL", 1, 901.0)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def _by_sql(name, folder):
    """What the query's SQL gives for the part table below ``folder``."""
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{folder}/part.parquet/*.parquet'")
    found = con.execute(__spark_entry__.oracle_sql()[name])
    cols = [d[0] for d in found.description]
    return sorted((tuple(r[cols.index(c)] for c in sorted(cols)) for r in found.fetchall()), key=str)


def _by_spark(name, spark, folder):
    got = __spark_entry__.queries()[name](spark, folder)
    return sorted((tuple(r[c] for c in sorted(got.columns)) for r in got.collect()), key=str)


def _rows_joined(df):
    """The most rows that a join of the executed plan put out."""
    df.collect()
    plan, most = df._jdf.queryExecution().executedPlan(), 0
    waiting = [plan]
    while waiting:
        p = waiting.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            waiting.append(p.executedPlan())
            continue
        if hasattr(p, "plan") and "QueryStage" in p.nodeName():
            waiting.append(p.plan())
        if "Join" in p.nodeName() and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        waiting += [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_links_are_counted_without_pairs(spark, tmp_path):
    folder = _odd_parts(spark, tmp_path, 10)
    assert _by_spark("AGG-09_links", spark, folder) == _by_sql("AGG-09_links", folder)
    assert _rows_joined(__spark_entry__.queries()["AGG-09_links"](spark, folder)) <= 30


def _no_pairs(*args, **kwargs):
    raise AssertionError("pairs were made")


def test_sources_are_counted_without_pairs(spark, tmp_path, monkeypatch):
    folder = _odd_parts(spark, tmp_path, 10)
    monkeypatch.setattr(pairs, "candidates", _no_pairs)
    assert _by_spark("AGG-21_sources", spark, folder) == [(3,)]  # three pairs of sources


def test_largest_task_without_pairs(spark, tmp_path, monkeypatch):
    folder = _odd_parts(spark, tmp_path, 10)
    monkeypatch.setattr(pairs, "block_join", _no_pairs)
    assert _by_spark("GRF-14_largest_task", spark, folder) == _by_sql("GRF-14_largest_task", folder)


def test_occurrence_without_all_pairs(spark, tmp_path, monkeypatch):
    folder = _odd_parts(spark, tmp_path, 10)
    monkeypatch.setattr(pairs, "candidates", _no_pairs)
    want, got = ([tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows] for rows in (_by_sql("AGG-12_occurrence", folder), _by_spark("AGG-12_occurrence", spark, folder)))
    assert len({r[-1] for r in want}) > 20 and sorted(got, key=str) == sorted(want, key=str)


def test_semi_gold_without_all_pairs(spark, tmp_path, monkeypatch):
    folder = _odd_parts(spark, tmp_path, 10)
    monkeypatch.setattr(pairs, "candidates", _no_pairs)
    assert _by_spark("JOI-08_semi_gold", spark, folder) == _by_sql("JOI-08_semi_gold", folder)


def test_anti_gold_without_all_pairs(spark, tmp_path, monkeypatch):
    folder = _odd_parts(spark, tmp_path, 10)
    monkeypatch.setattr(pairs, "candidates", _no_pairs)
    assert _by_spark("JOI-09_anti_gold", spark, folder) == _by_sql("JOI-09_anti_gold", folder)


VALUE_QUERIES = ["FVS-01_num_equal", "FVS-02_norm_sim", "FVS-03_abs_diff", "FVS-04_letter_jaccard", "FVS-05_word_jaccard", "FVS-06_relaxed_jaccard", "FVS-07_containment", "FVS-08_levenshtein", "FVS-09_missing", "FVS-10_overlap", "SIM-02_jaccard", "SIM-04_dice", "SIM-05_jaro_standard", "SIM-06_jaro_winkler"]


@pytest.mark.parametrize("name", VALUE_QUERIES)
def test_pair_features_are_computed_once_per_pair_of_values(spark, tmp_path, name):
    """One brand of 300 parts with three names, sizes and prices; null names keep their pairs."""
    rows = [(i, ["old nut", "hot bolt", "nut", None][i % 4 if i < 8 else i % 3], "B1", ["ECONOMY", "LARGE", "SMALL"][i % 7 % 3], i % 3, 900.0 + i % 3) for i in range(300)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    column = {"FVS-01_num_equal": 4, "FVS-02_norm_sim": 4, "FVS-03_abs_diff": 5}.get(name, 1)
    known = {r[0]: r[column] is not None for r in rows}
    made = __spark_entry__.queries()[name](spark, str(tmp_path))
    cols = sorted(made.columns)
    got = sorted((tuple(r[c] for c in cols) for r in made.collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(f"select id_a, id_b, sim from ({__spark_entry__.oracle_sql()[name]})").fetchall() if name in __spark_entry__.oracle_sql() else None
    if want:
        assert {r[:2] for r in got} == {r[:2] for r in want} and len(got) == len(want)
        sims = {r[:2]: r[2] for r in want}
        assert all(abs(s - sims[a, b]) < 1e-9 for a, b, s in got if known[a] and known[b])
    assert len(got) == sum(a[3] < b[3] for a in rows for b in rows)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan and "round(" not in plan and "Aggregate [x" not in plan  # values are looked up, pairs of records never made distinct


GATHERED = ["FVS-02_norm_sim", "FVS-03_abs_diff", "FVS-04_letter_jaccard", "FVS-05_word_jaccard", "FVS-06_relaxed_jaccard", "FVS-07_containment", "FVS-08_levenshtein", "FVS-09_missing", "SIM-04_dice", "SIM-05_jaro_standard"]


@pytest.mark.parametrize("name", GATHERED)
def test_pairs_are_unfolded_after_the_joins(spark, tmp_path, name):
    """One brand of 900 parts with three names, sizes and prices: the joins put out pairs of arrays, a small part of the pairs."""
    rows = [(i, ["old nut", "hot bolt", "nut"][i % 3], "B1", ["ECONOMY", "LARGE", "SMALL"][i // 3 % 3], i % 3, 900.0 + i % 3) for i in range(900)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    made = __spark_entry__.queries()[name](spark, str(tmp_path))
    assert _rows_joined(made) < 3000
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(f"select id_a, id_b, sim from ({__spark_entry__.oracle_sql()[name]}) order by 1, 2").fetchall()
    got = sorted((r.id_a, r.id_b, r.sim) for r in made.collect())
    assert len(got) == 270_000 and [r[:2] for r in got] == [r[:2] for r in want]
    assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want, strict=True))


@pytest.mark.parametrize("limit", [pairs.BROADCAST_BYTES, 0])
def test_valued_pairs_on_odd_parts(spark, tmp_path, monkeypatch, limit):
    """Null and repeated ids keep their pairs, looked up or not; arrays of more than CHUNK ids are cut."""
    monkeypatch.setattr(pairs, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(pairs, "CHUNK", 4)
    parts = spark.read.parquet(f"{_odd_parts(spark, tmp_path, 5)}/part.parquet")
    records = parts.select(F.col("p_type").alias("source"), F.col("p_partkey").alias("rec_id"), F.col("p_brand").alias("bkv"), "p_name")
    made = pairs.valued_pairs(records, "p_name", lambda x, y: F.concat(F.coalesce(x, F.lit("-")), F.lit("|"), F.coalesce(y, F.lit("-"))))
    all_ = records.collect()
    want = [(a.rec_id, b.rec_id, f"{'-' if a.p_name is None else a.p_name}|{'-' if b.p_name is None else b.p_name}") for a in all_ for b in all_ if a.bkv is not None and a.bkv == b.bkv and a.source and b.source and a.source < b.source]
    assert any(r[0] is None for r in want) and sorted(map(tuple, made.collect()), key=str) == sorted(want, key=str)


def test_bootstrap_labels_sort_only_the_ends(spark):
    """Ties by hash as before, null scores smallest; 400 rows of two source pairs, of which few are at an end."""
    rows = [(f"{i}", "A|B" if i % 2 else "A|C", None if i in (5, 9) else float(i % 40)) for i in range(400)]
    df = spark.createDataFrame(rows, "pair_id string, datasource_pair string, agg_score double")
    tie = {r.pair_id: r.t for r in df.select("pair_id", F.xxhash64("pair_id", F.lit(42)).alias("t")).collect()}
    want = set()
    for p in ("A|B", "A|C"):
        mine = [(i, -1.0 if s is None else s) for i, q, s in rows if q == p]
        want |= {(min(mine, key=lambda r: (-r[1], tie[r[0]]))[0], p, True), (min(mine, key=lambda r: (r[1], tie[r[0]]))[0], p, False)}
    got = active.bootstrap_labels(df)
    assert {(r.pair_id, r.datasource_pair, r.label) for r in got.collect()} == want
    assert "Join" in got._jdf.queryExecution().optimizedPlan().toString()  # rows meet the ends before they are sorted


def test_bootstrap_query_makes_no_feature_arrays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pairs, "block_join", _no_pairs)
    rows = [(i, ["old nut", "hot bolt", "nut"][i % 3], f"B{i % 2}", ["ECONOMY", "LARGE", "SMALL"][i % 7 % 3], i % 5 + 1, 900.0 + i % 11) for i in range(120)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    assert _by_spark("ACT-05_bootstrap_labels", spark, str(tmp_path)) == _by_sql("ACT-05_bootstrap_labels", str(tmp_path))


def test_farthest_first_passes_stay_in_generated_code(spark):
    rng = random.Random(3)
    rows = [(f"{i:03}", [rng.random(), rng.random(), rng.choice([0.0, 1.0])]) for i in range(300)] + [("zero", [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "pair_id string, features array<double>")
    near = active._cosine_sum(df, np.array([0.3, 0.5, 1.2]), "near")
    assert "Python" not in near._jdf.queryExecution().executedPlan().toString()
    for r in near.collect():
        v = np.array(r.features)
        assert abs(r.near - v @ [0.3, 0.5, 1.2] / max(np.linalg.norm(v), 1e-12)) < 1e-12


def test_bootstrap_query_compares_like_parts_once(spark, tmp_path):
    """40 copies of each part, and source pairs of one score only; the joins make no pair twice."""
    rows = [(i, ["old nut", "hot bolt"][i // 40 % 2], "B1", "ECONOMY" if i % 2 else "LARGE", 1 + i // 40 % 2, 900.0) for i in range(160)] + [(1000 + i, "old nut", "B2", ["PROMO", "SMALL"][i % 2], 2, 901.0) for i in range(80)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    assert _by_spark("ACT-05_bootstrap_labels", spark, str(tmp_path)) == _by_sql("ACT-05_bootstrap_labels", str(tmp_path))
    assert _rows_joined(__spark_entry__.queries()["ACT-05_bootstrap_labels"](spark, str(tmp_path))) <= 20
