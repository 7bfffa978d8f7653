"""The pipeline's stages on a small corpus whose right result is known."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from linkspark.llm import near

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def build(spark, folder):
    rnd = random.Random(1)

    def text(n=80):
        return " ".join(f"w{rnd.randrange(4000)}" for _ in range(n))

    docs, labels = [], []
    for i in range(500):
        t = text()
        bad = i % 5 == 0
        if bad:
            t += " " + rnd.choice(["nasty", "vile"])
        docs.append((i, t))
        labels.append((i, 1, int(bad)))
    item = text(30)
    docs += [(600, docs[1][1].upper()), (601, docs[2][1] + " tail"), (602, text() + " " + item), (603, None), (604, ""), (None, docs[3][1]), (605, text()), (605, text())]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages(spark, tmp_path):
    docs = build(spark, f"file://{tmp_path}")
    table = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = f"file://{tmp_path}/{name}"
        stage(spark, table, f"file://{tmp_path}").write.parquet(out)
        assert spark.read.parquet(out).dtypes == table.dtypes
        table = spark.read.parquet(out)
        seen.append([r.doc_id for r in table.collect()])
    clean = {i for i, _ in docs} - set(range(0, 500, 5))
    toxic, same, alike, free = seen
    assert set(toxic) == clean and len(toxic) == len(docs) - 100
    assert set(same) == clean - {1, None, 603} and same.count(605) == 2
    assert set(alike) == set(same) - {2}
    assert set(free) == set(alike) - {602}
    packed = corpus_pipeline.pack_sequences(spark, table, "").groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r.n for r in packed) <= 4096 and near.SIMILARITY == 0.8


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, clashing column names and very long texts; every stage, each on its own."""
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    more = ", own_id long, rid long, ukey string, size int, kept boolean, score double, tkey string"
    rnd = random.Random(2)
    long = " ".join(f"w{rnd.randrange(9000)}" for _ in range(60_000))
    rows = [(i, t, "en", "s", 1, 9, 9, "u", 3, True, 0.5, "k") for i, t in [(1, long), (2, long + " end"), (3, None), (None, "none"), (4, "few words"), (4, "other words")]]
    full, none = (spark.createDataFrame(r, DOCS + more) for r in (rows, []))
    kept = {"toxicity": 6, "exact dedup": 6, "near dedup": 5, "decontamination": 6}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, full, folder)
        if name in kept:
            assert got.columns == full.columns and got.count() == kept[name], name
            assert {r.own_id for r in got.collect()} == {9}
        else:
            assert {r.doc_id for r in got.collect()} == {1, 2, 3, 4, None}
        assert stage(spark, none, folder).count() == 0


def test_run_on_a_small_table(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
