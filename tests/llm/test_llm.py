"""The ten corpus operators: brute-force versions, round trips, held-out accuracy and edge cases."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import Row
from pyspark.sql import functions as F

from linkspark.llm import decontam, edits, exact, near, oracle, ordinal, pack, pii, queries, shard, tokens, toxic, warc
from linkspark.plans.staging import stage

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words(rnd, n, vocab=400):
    return " ".join(f"w{rnd.randrange(vocab)}" for _ in range(n))


def docs_of(spark, pairs, more=""):
    """Documents with columns that clash with names the operators use inside."""
    rows = [Row(doc_id=i, text=t, lang="en", source="s", n_chars=len(t or ""), rid=7, size=1, digest="x", ukey="y", bucket=3, salt=2, term="z", n=9) for i, t in pairs]
    return spark.createDataFrame(rows, DOCS + ", rid long, size long, digest string, ukey string, bucket int, salt int, term string, n long")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, repeated ids."""
    long = "mail a@b.cc " + "word " * 30_000 + "stupid end"
    return docs_of(spark, [(1, "Same Text here"), (2, "same text HERE"), (2, "same text HERE"), (3, None), (4, ""), (None, "same text here"), (None, None), (5, "Ünïcode Straße İ ß 日本 🙂 text"), (6, long), (7, long), (7, "other text altogether"), (8, "  \n\t ")])


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


# --- 1 sharding ------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1000, 4097])
def test_permutation_is_a_bijection(spark, n):
    got = [r[0] for r in spark.range(n).select(shard.permute(F.col("id"), n, 5)).collect()]
    assert sorted(got) == list(range(n))
    if n >= 100:
        assert got != sorted(got)


def test_shards_are_level_and_gapless(spark, odd, none):
    rows = shard.shard(odd, 3).collect()
    assert len(rows) == 12 and max(Counter(r.shard for r in rows).values()) - min(Counter(r.shard for r in rows).values()) <= 1
    for s in range(3):
        mine = sorted(r.slot for r in rows if r.shard == s)
        assert mine == list(range(len(mine)))
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id == 3} == {(1, 0)}
    assert {r.text_crc32 for r in rows if r.doc_id == 5} == {zlib.crc32("Ünïcode Straße İ ß 日本 🙂 text".encode())}
    assert shard.shard(none, 3).collect() == []
    again = shard.shard(odd.repartition(7), 3).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


# --- 2 near duplicates -------------------------------------------------------------


def jaccard(a, b):
    return len(a & b) / len(a | b)


def plain_shingles(text):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_samples_agree_as_often_as_weighted_jaccard():
    rnd = np.random.default_rng(1)
    h = np.sort(rnd.integers(0, 2**63, 400, dtype=np.uint64))
    agree, want = [], []
    for k in range(40):
        w1 = rnd.uniform(1, 3, 300).astype(np.float32)
        a, b = h[:300], h[60:360]
        w2 = np.concatenate([w1[60:], rnd.uniform(1, 3, 60).astype(np.float32)])
        want.append(near.similarity(a, w1, b, w2))
        agree.append((near.sample(a + np.uint64(k), w1) == near.sample(b + np.uint64(k), w2)).mean())
    assert abs(np.mean(agree) - np.mean(want)) < 0.03


def test_near_classes_match_brute_force(spark):
    rnd = random.Random(3)
    texts = []
    for _ in range(25):
        base = words(rnd, rnd.choice([30, 80, 200]), 5000).split()
        texts.append(" ".join(base))
        for _ in range(rnd.randrange(5)):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 2, 9])):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(9999)}"
            texts.append(" ".join(w))
    texts += [words(rnd, 60, 5000) for _ in range(20)]
    sh = [plain_shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    unsure = False
    for i in range(len(texts)):
        for j in range(i):
            s = jaccard(sh[i], sh[j])
            unsure |= 0.78 < s < 0.83 and root(i) != root(j)
            if s >= 0.8:
                parent[root(i)] = root(j)
    got = {r.doc_id: r for r in near.near_duplicates(docs_of(spark, list(enumerate(texts)))).collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for i in range(len(texts)):
        groups[got[i].class_id].add(i)
        want[root(i)].add(i)
    same = set(map(frozenset, groups.values())) & set(map(frozenset, want.values()))
    assert len(same) >= 0.95 * len(want) if unsure else set(map(frozenset, groups.values())) == set(map(frozenset, want.values()))
    assert all(sum(got[i].kept for i in g) == 1 and got[max(g)].kept for g in groups.values())
    assert all(got[i].class_size == len(g) for g in groups.values() for i in g)


def test_blocks_find_links_that_no_leader_shows(spark, monkeypatch):
    """A chain in one bucket: neighbours are alike, the leader is like few."""
    rnd = random.Random(9)
    w = words(rnd, 200, 9000).split()
    chain = []
    for i in range(30):
        chain.append(" ".join(w))
        for j in range(6):
            w[(i * 6 + j) % 200] = f"y{i}_{j}"
    monkeypatch.setattr(near, "BLOCK_LEFT", 4)
    monkeypatch.setattr(near, "BLOCK_RIGHT", 8)
    idf = np.ones(1 << near.SLOT_BITS, np.float32)
    vec = [near.shingles(near.word_hashes(t), idf) for t in chain]
    rows = [(bytes([i]), bytearray(h.tobytes()), bytearray(x.tobytes())) for i, (h, x) in enumerate(vec)]
    vectors = spark.createDataFrame([(bytearray(k), h, x) for k, h, x in rows], "ukey binary, h binary, w binary")
    members = spark.createDataFrame([(5, bytearray(k), i % 3 > 0) for i, (k, _, _) in enumerate(rows)], "bucket long, ukey binary, apart boolean")
    got = {tuple(sorted((bytes(r.u)[0], bytes(r.v)[0]))) for r in near._blocks(members, vectors).collect()}
    want = {(i, j) for j in range(30) for i in range(j) if near.similarity(*vec[i], *vec[j]) >= 0.8 and (i % 3 or j % 3)}
    assert got == want and want


def test_prefixes_of_linked_texts_meet():
    rnd = np.random.default_rng(4)
    met = apart = 0
    for _ in range(400):
        h = np.unique(rnd.integers(0, 1 << 63, 80).astype(np.uint64))
        a, b = (np.sort(rnd.choice(h, rnd.integers(68, len(h)), replace=False)) for _ in range(2))
        wa, wb = (rnd.uniform(1, 1.5, len(x)).astype(np.float32) for x in (a, b))
        common = rnd.integers(0, 3, 1 << near.PREFIX_BITS).astype(np.int32)
        shared = set(near.prefix(a, wa, common).tolist()) & set(near.prefix(b, wb, common).tolist())
        if near.similarity(a, wa, b, wb) >= near.SIMILARITY:
            met += 1
            assert shared
        apart += len(near.prefix(a, wa, common)) < len(a)
    assert met > 50 and apart == 400


def test_repeated_and_null_ids_bring_no_other_texts(spark):
    rnd = random.Random(31)
    base = [words(rnd, 60, 5000) for _ in range(1000)]
    texts = [t for b in base for t in (b, b + " more")] * 2
    docs = docs_of(spark, [(None if i < 2000 else 7, t) for i, t in enumerate(texts)])
    rows = docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("tkey"), "text")
    light = rows.select("doc_id", "tkey", F.col("tkey").alias("ukey"))
    assert near.candidate_texts(rows, light, light.select("ukey").distinct()).count() == 2000
    got = near.near_duplicates(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("class_size").alias("low"), F.max("class_size").alias("high"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()
    assert {(r.doc_id, r.n, r.low, r.high, r.kept) for r in got} == {(None, 2000, 4, 4, 0), (7, 2000, 4, 4, 1000)}


def test_near_edges(odd, none):
    rows = near.near_duplicates(odd).collect()
    assert len(rows) == 12
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[1][0].class_id == 2 and by[1][0].class_size == 4
    assert sum(r.kept for r in by[2]) == 1
    assert by[3][0].class_id == by[4][0].class_id == 4 and by[8][0].class_id == 8
    assert by[6][0].class_id == 7
    assert near.near_duplicates(none).collect() == []


# --- 3 token counts ----------------------------------------------------------------


def test_edited_counts_equal_full_encoding(spark, odd, none):
    vocab = queries.vocabulary("byte_bpe_50k.tiktoken")
    counter = edits.Counter.of(vocab)
    rnd = random.Random(5)
    bits = ["'", "'ll", "'s", " ", "  ", "\n", "  \n x", "a", "é", "12", "!!", "re", "'r", "Σ", "\x85", "ab cd", "日本"]
    for _ in range(300):
        x = "".join(rnd.choices(bits, k=rnd.randint(0, 600)))
        tree = edits.CountTree(x, counter)
        for _ in range(6):
            a = rnd.randint(0, len(x) + 1)
            b, new = a + rnd.choice([0, 1, 2, 50]), "".join(rnd.choices(bits, k=rnd.randint(0, 3)))
            tree.edit(a, b, new)
            a = min(a, len(x))
            x = x[:a] + new + x[max(a, min(b, len(x))) :]
            assert tree.text == x and tree.tokens == len(counter.encoding.encode_ordinary(x))
            assert tree.leaves()[0].tolist() == [len(p) for p in counter.slow.findall(x)]
    script = F.array(*(F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end"), F.lit(n).alias("new")) for a, b, n in ((0, 3, "new "), (10**9, 0, "!"))))
    text = {r.text for r in odd.collect()}
    got = edits.count_edited(odd.withColumn("edits", script), vocab).collect()
    want = Counter((len(counter.encoding.encode_ordinary(t or "")), len(counter.encoding.encode_ordinary("new " + (t or "")[3:] + "!"))) for t in [r.text for r in odd.collect()])
    assert Counter((r.tokens_before, r.tokens_after) for r in got) == want and text
    long = max(got, key=lambda r: r.text_chars)
    assert long.encoded_chars < 100
    assert edits.count_edited(none.withColumn("edits", script), vocab).collect() == []


def test_trees_are_stored_edited_and_stored_again(spark):
    """Every count after each round of edits on the stored trees equals a full encoding of the text."""
    vocab = queries.vocabulary("byte_bpe_50k.tiktoken")
    full = edits.Counter.of(vocab).encoding.encode_ordinary
    rnd = random.Random(17)
    text = {i: words(rnd, rnd.choice([0, 3, 60, 3000]), 900) + rnd.choice(["", " 日本 isn't", " " * 400, "x" * 700]) for i in range(40)}
    trees = stage(edits.build_trees(docs_of(spark, [*text.items(), (7, text[7]), (None, "no id")]), vocab), "test-trees")
    for _ in range(3):
        script = []
        for i in rnd.sample(sorted(text), 25):
            for seq in range(rnd.randint(1, 3)):
                a = rnd.randint(0, len(text[i]))
                b, new = min(a + rnd.choice([0, 1, 9, 400]), len(text[i])), rnd.choice(["", " new", "'ll ", "\n\n ", "é" * 300])
                text[i] = text[i][:a] + new + text[i][b:]
                script.append((i, seq, a, b, new))
        table = spark.createDataFrame([*script, (999, 0, 0, 1, "x"), (None, 0, 0, 1, "x")], "doc_id long, seq int, start long, end long, new string")
        changed = edits.with_edits(trees, table)
        counts = edits.apply_edits(changed, vocab).collect()
        assert Counter((r.doc_id, r.tokens_after, r.text_chars) for r in counts) == Counter((i, len(full(t)), len(t)) for i, t in [*text.items(), (7, text[7]), (None, "no id")])
        trees = stage(edits.edited_trees(changed, vocab), "test-trees")
    assert {r.doc_id: r.tokens for r in trees.collect()} == {i: len(full(t)) for i, t in [*text.items(), (None, "no id")]}

def test_stored_trees_take_further_edits(spark):
    vocab = queries.vocabulary("byte_bpe_50k.tiktoken")
    trees = edits.build_trees(docs_of(spark, [(1, "one two three"), (2, None)]), vocab)
    table = spark.createDataFrame([(1, 2, 0, 3, "ONE"), (1, 1, 3, 3, ","), (9, 1, 0, 0, "x")], "doc_id long, seq int, start long, end long, new string")
    once = edits.edited_trees(edits.with_edits(trees, table), vocab)
    twice = {r.doc_id: r for r in edits.edited_trees(edits.with_edits(once, table), vocab).collect()}
    assert twice[1].text == "ONE,, two three" and twice[1].tokens == len(edits.Counter.of(vocab).encoding.encode_ordinary("ONE,, two three"))
    assert twice[2].tokens == 0


# --- 4 exact dedup -------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 50_000])
def test_filter_has_no_false_negative(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
    built = exact.build_filter(keys)
    assert exact.probe_filter(keys, *built).all()
    other = np.random.default_rng(n + 1).integers(0, 2**64, 20_000, dtype=np.uint64)
    assert exact.probe_filter(other, *built).mean() < 0.01


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_groups(spark, odd, none, digest_bytes):
    rnd = random.Random(2)
    pairs = [(i, rnd.choice(["Aa", "aA", "b", "Ä", "ä", None, "", words(rnd, 5, 3)])) for i in range(300)]
    got = {r.doc_id: r for r in exact.dedup(docs_of(spark, pairs), digest_bytes=digest_bytes).collect()}
    low = {i: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for i, t in pairs}
    groups = defaultdict(list)
    for i, t in low.items():
        groups[t].append(i)
    for i, t in low.items():
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest())
    rows = exact.dedup(odd, digest_bytes=digest_bytes).collect()
    same = [r for r in rows if r.text_sha256 == hashlib.sha256(b"same text here").hexdigest()]
    assert len(rows) == 12 and len(same) == 4 and {r.keep_id for r in same} == {2} and sum(r.kept for r in same) == 1
    assert exact.dedup(none, digest_bytes=digest_bytes).collect() == []


# --- 5 WARC ----------------------------------------------------------------------------


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(3, "http://a/\r\nX: 1", "<p>ü</p>", "e"), (1, "u", "<p>ü</p>", "e"), (2, None, None, "e"), (4, "v", "", "e"), (None, "w", "<p>ü</p>", "e"), (5, "x", "y" * 3_000_000, "e"), (6, "x", "\r\n\r\nWARC/1.1\r\n\r\n", "e"), (6, "x", "\r\n\r\nWARC/1.1\r\n\r\n", "e")], "page_id long, url string, html string, digest string")
    rows = warc.archive_pages(pages).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == 8
    sha = base64.b32encode(hashlib.sha1("<p>ü</p>".encode()).digest()).decode()
    assert (got[1].record_type, got[1].refers_to, got[1].payload_digest, got[1].payload_bytes) == ("response", None, sha, 9)
    assert (got[3].record_type, got[3].refers_to, got[3].url) == ("revisit", 1, "http://a/  X: 1") and got[None].refers_to == 1
    assert got[2].record_type == "response" and got[4].refers_to == 2
    assert {r.record_type for r in rows if r.page_id == 6} == {"response"}
    small = {r.page_id: r.record_type for r in warc.archive_pages(pages, min_bytes=10).collect()}
    assert small[3] == "response"
    folder, index = warc.write_archives(pages)
    chosen = warc.read_records(folder, index.where("page_id in (5, 3)")).collect()
    assert {(r.page_id, len(r.payload or b"")) for r in chosen} == {(5, 3_000_000), (3, 0)}
    assert warc.archive_pages(pages.limit(0)).collect() == []


def test_archives_are_plain_warc(spark):
    """An independent reader finds every record, with its own id, by gzip member and by length."""
    import gzip
    from pathlib import Path

    long = "http://a/" + "x" * 100_000
    pages = spark.createDataFrame([(1, long, "<p>a</p>"), (1, long, "<p>a</p>"), (2, "http://b/", "<p>a</p>"), (3, None, "z" * 70_000)], "page_id long, url string, html string")
    folder, index = warc.write_archives(pages)
    found, ids = [], []
    for name in {r.file for r in index.collect()}:
        raw = gzip.decompress(Path(f"{folder.removeprefix('file://')}/{name}").read_bytes())
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            block, raw = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) + 4 :]
            ids.append(fields["WARC-Record-ID"])
            if fields["WARC-Type"] != "warcinfo":
                status, _, body = block.partition(b"\r\n\r\n")
                assert fields["Content-Type"] == "application/http; msgtype=response" and status.startswith(b"HTTP/1.1 200 OK\r\n")
                found.append((fields["WARC-Type"], fields["WARC-Target-URI"], len(body), fields.get("WARC-Refers-To-Target-URI")))
    assert sorted(found) == sorted([("response", long, 8, None), ("response", long, 8, None), ("revisit", "http://b/", 0, long), ("response", "", 70_000, None)])
    assert len(set(ids)) == len(ids)


def test_folders_by_hadoop_names():
    assert [warc.worker_uri(u) for u in ("s3a://b/c", "/tmp/x", "file:/tmp/x", "file:///tmp/x", "hdfs://n:9/x")] == ["s3://b/c", "file:///tmp/x", "file:///tmp/x", "file:///tmp/x", "hdfs://n:9/x"]
    with pytest.raises(ValueError, match="wasb"):
        warc.worker_uri("wasb://c/x")


def test_ranges_are_merged():
    assert warc.coalesce_ranges([0, 10, 30, 1000], [10, 10, 5, 7], gap=15, most=100) == [(0, 3, 35), (3, 4, 7)]
    assert warc.coalesce_ranges([0, 10], [10, 10], gap=15, most=15) == [(0, 1, 10), (1, 2, 10)]


# --- 6 toxicity --------------------------------------------------------------------------


def toxic_corpus(n=900):
    rnd = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        bad = rnd.random() < 0.2
        w = words(rnd, rnd.randrange(5, 60), 800).split()
        if bad:
            w[rnd.randrange(len(w))] = rnd.choice(["nasty", "vile", "rotten"])
        docs.append((i, " ".join(w)))
        if rnd.random() < 0.6:
            labels.append((i, int(bad)))
    return docs, labels


def test_nnpu_on_held_out_rows(spark, odd, none):
    docs, labels = toxic_corpus()
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxic.toxicity(docs_of(spark, docs), table).collect()}
    fold = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {i for i, r in got.items() if r.held_out} == fold
    truth = {i: any(x in t for x in ("nasty", "vile", "rotten")) for i, t in docs}
    held = [i for i in fold]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    # the labels of held-out rows change nothing
    wrong = spark.createDataFrame([(i, 1 - y if i in fold else y) for i, y in labels], "doc_id long, toxic int")
    assert {(r.doc_id, r.score) for r in toxic.toxicity(docs_of(spark, docs), wrong).collect()} == {(i, r.score) for i, r in got.items()}
    few = toxic.toxicity(odd, table.limit(0)).collect()
    assert len(few) == 12 and all(0 <= r.score < 0.5 for r in few)
    assert toxic.toxicity(none, table).collect() == []
    model = toxic.fit(docs_of(spark, docs), table)
    left = toxic.reject(docs_of(spark, docs), model)
    assert left.columns == docs_of(spark, docs).columns and {r.doc_id for r in left.collect()} == {i for i, r in got.items() if not r.predicted}


def test_nnpu_risk_and_direction():
    rnd = np.random.default_rng(3)
    seen = set()
    for prior in (0.05, 0.4, 0.9):
        for spread in (0.5, 3.0):
            is_p = rnd.random(40) < 0.4
            g = rnd.normal(0, spread, 40) + 2 * is_p
            ell = lambda z: 1 / (1 + math.exp(z))
            pos = prior * np.mean([ell(x) for x in g[is_p]])
            neg = np.mean([ell(-x) for x in g[~is_p]]) - prior * np.mean([ell(-x) for x in g[is_p]])
            risk, d = toxic.nnpu_risk(g, is_p, prior)
            assert abs(risk - (pos + max(0.0, neg))) < 1e-12
            seen.add(neg >= -toxic.BETA)

            def part(x):
                s = 1 / (1 + np.exp(-x))
                low = s[~is_p].mean() - prior * s[is_p].mean()
                return prior * (1 - s[is_p]).mean() + low if neg >= -toxic.BETA else -toxic.GAMMA * low

            for i in range(40):
                e = np.eye(40)[i] * 1e-6
                assert abs((part(g + e) - part(g - e)) / 2e-6 - d[i]) < 1e-6
    assert seen == {True, False}


def test_repeated_ids_keep_the_learning_sample_bounded(spark):
    docs = docs_of(spark, [(i % 5 + 1, f"text number {i}") for i in range(400)] + [(None, "no id")] * 50)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 6)], "doc_id long, quality int, toxic int")
    sample, _ = toxic.learning_sample(docs, labels, "toxic", "doc_id", "text", 3, 4)
    assert sample.count() <= 7
    assert len(toxic.toxicity(docs, labels).collect()) == 450
    model = ordinal.fit(docs, labels.select("doc_id", F.lit(1).alias("grade")), 3)
    assert len(ordinal.grade_rows(docs, model).collect()) == 450


def test_ordinal_gradients():
    rnd = np.random.default_rng(5)
    score, cuts, y = rnd.normal(0, 2, 30), np.array([-1.0, 0.2, 1.7]), rnd.integers(0, 4, 30)
    loss, d_score, d_cut = ordinal.ordinal_loss(score, cuts, y)
    above = lambda x, k: 1.0 if k < 0 else 0.0 if k > 2 else 1 / (1 + math.exp(cuts[k] - x))
    assert abs(loss + np.mean([math.log(above(x, k - 1) - above(x, k)) for x, k in zip(score, y, strict=True)])) < 1e-9
    for i in range(30):
        e = np.eye(30)[i] * 1e-6
        assert abs((ordinal.ordinal_loss(score + e, cuts, y)[0] - ordinal.ordinal_loss(score - e, cuts, y)[0]) / 2e-6 - d_score[i]) < 1e-6
    for k in range(3):
        e = np.eye(3)[k] * 1e-6
        assert abs((ordinal.ordinal_loss(score, cuts + e, y)[0] - ordinal.ordinal_loss(score, cuts - e, y)[0]) / 2e-6 - d_cut[k]) < 1e-6


def test_odd_grades_are_ignored(spark):
    docs = docs_of(spark, [(i, f"good words {i}" if i % 2 else "BAD!!! ###") for i in range(60)])
    odd_ones = [(i, g) for i in range(60) for g in (None, -1, 7)]
    plain = spark.createDataFrame([(i, 2 * (i % 2)) for i in range(60)], "doc_id long, grade int")
    more = plain.unionByName(spark.createDataFrame(odd_ones, "doc_id long, grade int"))
    a, b = (sorted((r.doc_id, r.expected_grade) for r in ordinal.grade_rows(docs, ordinal.fit(docs, x, 3)).collect()) for x in (plain, more))
    assert a == b


# --- 7 packing ---------------------------------------------------------------------------


def fewest_bins(items, capacity):
    """Exact by exhaustive search, for small cases."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room >= items[i]:
                rest = list(bins)
                rest.remove(room)
                go(i + 1, [*rest, room - items[i]])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_cases():
    rnd = random.Random(6)
    for _ in range(150):
        items = [rnd.randint(1, 30) for _ in range(rnd.randint(1, 10))]
        made = pack.bin_completion(Counter(items), 30)
        assert all(sum(p) <= 30 for p, _ in made)
        assert Counter(x for p, n in made for x in p for _ in range(n)) == Counter(items)
        assert sum(n for _, n in made) == fewest_bins(items, 30)
    hard = {6: 2, 5: 2, 4: 2, 3: 3, 2: 3}  # best fit needs a bin more than completion
    assert sum(n for _, n in pack.bin_completion({k * 10: v for k, v in hard.items()}, 110)) >= pack.lower_bound({k * 10: v for k, v in hard.items()}, 110)


def test_fillings_are_the_fullest_of_all():
    rnd = random.Random(13)
    for _ in range(200):
        counts = {x: rnd.randint(1, 3) for x in rnd.sample(range(1, 30), rnd.randint(1, 6))}
        room, asc = rnd.randint(1, 60), sorted(counts)
        every = []
        for ks in itertools.product(*(range(counts[x] + 1) for x in asc)):
            left = room - sum(k * x for k, x in zip(ks, asc, strict=True))
            free = [x for k, x in zip(ks, asc, strict=True) if k < counts[x]]
            used = [x for k, x in zip(ks, asc, strict=True) if k]
            if left >= 0 and not any(y <= left or any(x < y <= x + left for x in used) for y in free):
                every.append((left, tuple(sorted(x for k, x in zip(ks, asc, strict=True) for _ in range(k)))))
        got = [(room - sum(f), tuple(sorted(f))) for f in pack.fillings(asc, counts, room, 10**6)]
        assert sorted(got) == sorted(every) and [w for w, _ in got] == sorted(w for w, _ in every)
        assert [room - sum(f) for f in pack.fillings(asc, counts, room, 3)] == sorted(w for w, _ in every)[:3]
    wide = {x: 1 for x in range(101, 2000, 7)}  # the largest items first leave waste in all of the first fillings
    assert {sum(f) for f in pack.fillings(sorted(wide), wide, 3000, 24)} == {3000}


def test_packed_pieces_hold_all_tokens(spark, odd, none):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for cap in (64, 4096):
        rows = pack.pack(odd, path, cap).collect()
        by = defaultdict(list)
        for r in rows:
            by[r.sequence_id].append(r)
        for seq in by.values():
            at = 0
            for r in sorted(seq, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= cap
        want = Counter()
        for d in odd.collect():
            ids = [*tok.encode(d.text or "", add_special_tokens=False).ids, 1]
            for k in range(0, len(ids), cap):
                part = ids[k : k + cap]
                want[d.doc_id, k // cap, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        assert len(by) >= -(-sum(r.length for r in rows) // cap)
    assert pack.pack(none, path).collect() == []


def test_fast_ids_equal_the_tokenizer():
    bpe, rnd = tokens.WordBpe.of(queries.vocabulary("word_bpe_49k.json")), random.Random(1)
    alphabet = [chr(c) for c in range(0x180)] + list("–—‘’…€Σς́İ'stvelmdr  12") + ["<|endoftext|>", "'ll", "日本", "🙂"]
    for _ in range(5000):
        x = "".join(rnd.choices(alphabet, k=rnd.randint(0, 14)))
        assert bpe.ids(x) == bpe._encode(x)


# --- 8 decontamination ---------------------------------------------------------------------


def smith_waterman(a, b):
    """The textbook recurrence."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_equals_the_recurrence():
    rnd = random.Random(8)
    for _ in range(200):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randint(1, 25))] for _ in range(2))
        assert decontam.align(np.array(a), np.array(b))[0] == smith_waterman(a, b)


@pytest.mark.parametrize("block_words", [10**6, 40])
def test_contamination_against_all_pairs(spark, odd, none, block_words):
    rnd = random.Random(7)
    items = [(i, words(rnd, rnd.randint(8, 40), 3000)) for i in range(12)] + [(90, None), (91, ""), (92, "odd one out")]
    docs = []
    for i in range(80):
        body = words(rnd, 60, 3000).split()
        if i % 3 == 0:
            w = items[rnd.randrange(12)][1].split()
            for _ in range(rnd.choice([0, 0, 1, len(w) // 6])):
                w[rnd.randrange(len(w))] = "edited"
            body[30:30] = w
        docs.append((i, " ".join(body)))
    docs += [(100, None), (101, ""), (102, "this odd one out here"), (None, items[0][1]), (103, items[1][1]), (103, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(docs_of(spark, docs), bench, block_words=block_words).collect()
    want = []
    for i, t in docs:
        found = []
        for k, item in items:
            a, b = decontam.words_of(item), decontam.words_of(t)
            if a and b and (score := smith_waterman(a, b) / (2 * len(a))) >= 0.5:
                found.append((round(score, 6), -k))
        best = max(found, default=(None, None))
        want.append((i, bool(found), None if best[1] is None else -best[1], best[0], len(found)))
    assert Counter((r.doc_id, r.contaminated, r.best_item, r.best_score, r.n_items) for r in got) == Counter(want)
    assert decontam.contamination(none, bench).collect() == []


@pytest.mark.parametrize("edit", ["random", "replace3", "replace4", "insert3", "delete4"])
def test_edited_copies_are_found(edit):
    """Every planted copy whose alignment with its item reaches half the score is found, whatever the edits."""
    rnd = random.Random(edit)
    pool = [f"v{int(rnd.paretovariate(0.7))}" for _ in range(40_000)]
    items = [(k, " ".join(rnd.choices(pool, k=rnd.randint(15, 55)))) for k in range(60)]
    index = decontam.build_index(items)
    counts = np.bincount(index.words(" ".join(pool)), minlength=len(index.vocab) + 1)
    rare = decontam.rare_seeds(index, counts, int(counts.sum()))
    found = due = 0
    for _ in range(200):
        k, rate, out = rnd.randrange(60), rnd.choice([0.1, 0.2, 0.3, 0.4]), []
        for i, x in enumerate(items[k][1].split()):
            hit = rnd.random() < rate if edit == "random" else i % int(edit[-1]) == int(edit[-1]) - 1
            kind = rnd.choice(["replace", "insert", "delete"]) if edit == "random" else edit[:-1]
            out += [x] if not hit else {"replace": [rnd.choice(pool)], "insert": [x, rnd.choice(pool)], "delete": []}[kind]
        text = index.words(" ".join([*rnd.choices(pool, k=60), *out, *rnd.choices(pool, k=60)]))
        if decontam.align(index.items[k], text)[0] >= decontam.ALIGNED * 2 * len(index.items[k]):
            due += 1
            found += decontam.seeded(index, decontam.seed_hits(index, text)) and any(i == k and score >= decontam.ALIGNED for i, score, _, _ in decontam.passages(index, text, rare))
    assert due > 50 and found >= 0.98 * due


def test_contamination_without_items(spark, odd):
    bench = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert not any(r.contaminated for r in decontam.contamination(odd, bench.limit(0)).collect())


# --- 9 quality ---------------------------------------------------------------------------------


def test_ordinal_fit_orders_grades(spark, odd, none):
    rnd = random.Random(12)
    docs, ratings = [], []
    for i in range(700):
        g = rnd.randrange(3)
        w = [("fine" if rnd.random() < 0.3 * g else "poor!!" if rnd.random() < 0.3 * (2 - g) else f"w{rnd.randrange(300)}") for _ in range(40)]
        docs.append((i, " ".join(w)))
        ratings.append((i, g))
    table = spark.createDataFrame(ratings, "doc_id long, grade int")
    model = ordinal.fit(docs_of(spark, docs), table, 3)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in ordinal.grade_rows(docs_of(spark, docs), model).collect()}
    held = [(got[i].expected_grade, g) for i, g in ratings if got[i].held_out]
    means = [np.mean([e for e, g in held if g == k]) for k in range(3)]
    assert means[0] + 0.4 < means[1] < means[2] - 0.4
    assert all(abs(r.expected_grade - r.p_above_0 - r.p_above_1) < 1e-9 and r.p_above_0 >= r.p_above_1 for r in got.values())
    assert np.mean([abs(e - g) < 0.8 for e, g in held]) > 0.85
    flat = ordinal.fit(odd, table.limit(0), 3)
    assert len(ordinal.grade_rows(odd, flat).collect()) == 12
    assert ordinal.grade_rows(none, model).collect() == []


# --- 10 personal data ----------------------------------------------------------------------------

PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in PLAIN:
        for m in re.finditer(pattern, text):
            d = re.sub(r"[^0-9]", "", m.group())
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_equal_plain_patterns(spark, odd, none):
    rnd = random.Random(10)
    bits = ["@", ".", "a", "b-c", "_", "%", "1", "22", "255", "256", "0001", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1", "+", "(0)", " ", "-", "  ", "\n", "é", "🙂", "10.0.0.1", "x@y.zz", "5500000000000004", "١"]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 25))) for _ in range(3000)]
    texts += ["1 " * 20_000, "1" * 50_000, "a" * 50_000 + "@", "a.b@c.d_e@f.g@h.i", "+1" + "-" * 30_000, "1." * 20_000, "x@y.z " * 2000]
    got = {r.doc_id: r for r in pii.personal_data(docs_of(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t)
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("term")] == want, t[:200]
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(s.startswith(k) for s in want) for k, _ in PLAIN)
    assert len(pii.personal_data(odd).collect()) == 12
    assert pii.personal_data(none).collect() == []


def test_terms_that_disclose(spark):
    rnd = random.Random(11)
    docs = [(i, words(rnd, 30, 50)) for i in range(200)]
    docs += [(300 + i, f"{words(rnd, 12, 50)} write to Zorblatt at zb@mail.example {words(rnd, 12, 50)}\nelse ZORBLATT said") for i in range(4)]
    docs += [(400, "zorblatt without the address"), (401, "only once uniqueword q@mail.example")]
    rows = {r.doc_id: r for r in pii.personal_data(docs_of(spark, docs)).collect()}
    text = dict(docs)
    for i in range(300, 304):
        spans = [s.split(":") for s in rows[i].spans.split(",")]
        found = [text[i][int(a) : int(b)].lower() for k, a, b in spans if k == "term"]
        assert found.count("zorblatt") == 2 and "w1" not in found
    assert rows[400].n_term == rows[401].n_term == 0 and all(rows[i].spans == "" for i in range(200))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs_of(spark, docs)).collect()}
    assert "zb@mail" not in clean[300] and "[EMAIL]" in clean[300] and "orblatt" not in clean[300].lower()
    assert clean[5] == text[5] and len(clean) == len(docs)


def test_terms_far_from_their_entity_disclose(spark):
    rnd = random.Random(12)
    docs = [(i, words(rnd, 30, 50)) for i in range(200)]
    docs += [(300 + i, f"{words(rnd, 20, 50)}\nQuibblefax Ltd\nmail: qf@mail.example") for i in range(4)]  # on the line above
    docs += [(400 + i, f"Vandermolk {words(rnd, 80, 50)} vm@mail.example {words(rnd, 5, 50)}") for i in range(3)]  # over 100 characters away
    docs += [(410 + i, f"{'near Plonkett pl@mail.example' if i < 2 else 'pl@mail.example ' + words(rnd, 80, 50) + ' plonkett'} {words(rnd, 5, 50)}") for i in range(6)]  # near in few of its rows
    docs += [(500 + i, "twice Gadzook the same gz@mail.example") for i in range(2)]  # copies are one piece of evidence
    rows, text = {r.doc_id: r for r in pii.personal_data(docs_of(spark, docs)).collect()}, dict(docs)
    for first, n, name in ((300, 4, "quibblefax"), (400, 3, "vandermolk"), (410, 6, "plonkett")):
        for i in range(first, first + n):
            spans = [s.split(":") for s in rows[i].spans.split(",")]
            found = [text[i][int(a) : int(b)].lower() for k, a, b in spans if k == "term"]
            assert found.count(name) == 1 and "w1" not in found
    assert rows[500].n_term == 0 and all(rows[i].spans == "" for i in range(200))


def brute_terms(texts):
    """Term spans of every text by plain loops over all (concept, term) pairs."""
    word = regex.compile(r"[\p{L}\p{N}]+")
    letter = regex.compile(r"\p{L}")

    def terms_of(text):
        return {w for w in word.findall(text.lower()) if len(w) >= pii.TERM_LETTERS and letter.search(w)}

    def free(text):
        for kind in pii.KINDS:
            text = regex.sub(pii.PATTERNS[kind], " ", text)
        return text

    rows = []
    for text in texts:
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in brute_spans(text))]
        concepts = defaultdict(list)
        for k, a, b in spans:
            v = text[a:b].lower()
            digits = re.sub("[^0-9]", "", v)
            origin = {"email": v.rpartition("@")[2], "ip": ".".join(v.split(".")[:2]), "card": digits[:6], "phone": digits[:4]}[k]
            for c in ((0, f"{k}:{v}"), (1, f"{k}:~{origin}"), (2, k), (2, "any")):
                concepts[c].append(f"{k}:{v}")
        rows.append((text, concepts, terms_of(free(text.lower())) if concepts else set(), spans))
    n = len(rows)
    e_df, t_df, both, evidence, values = Counter(), Counter(), Counter(), defaultdict(set), defaultdict(set)
    for text, concepts, terms, _ in rows:
        t_df.update(terms_of(text))
        e_df.update(concepts.keys())
        for c, vs in concepts.items():
            for t in terms:
                both[c, t] += 1
                evidence[c, t].add(free(text.lower()))
                values[c, t].add(min(vs, key=lambda v: xxhash64_of(v)))
    for text, concepts, _, spans in rows:  # contexts that differ, in copies of one text
        for k, a, b in spans:
            before, after = text[max(0, a - 100) : a], text[b : b + 100]
            before = regex.sub(r"^[\p{L}\p{N}]+", "", before) if a > 100 else before
            after = regex.sub(r"[\p{L}\p{N}]+$", "", after) if len(after) == 100 else after
            near = free(before.rpartition("\n")[2] + " | " + after.partition("\n")[0])
            for t in terms_of(near):
                evidence[(0, f"{k}:{text[a:b].lower()}"), t].add("near:" + near)

    def surprise(b, t, e, n):
        return 2 * sum(o * math.log(o / d) for o, d in ((b, t * e / n), (t - b, t * (n - e) / n), (e - b, (n - t) * e / n), (n - t - e + b, (n - t) * (n - e) / n)) if o > 0)

    def differ(k):
        full = [x for x in evidence[k] if not x.startswith("near:")]
        return len(full) > 1 or len(evidence[k]) - len(full) > 1

    pairs = [k for k in both if e_df[k[0]] >= pii.SUPPORT and differ(k)]
    bar = 2 * math.log(max(1, sum(c[0] > 0 for c, _ in pairs))) + pii.MARGIN
    told = set()
    for c, t in pairs:
        b, e, d = both[c, t], e_df[c], t_df[t]
        if e == n or not d or math.log(n * b / (d * e)) < (pii.WIDE_DISCLOSURE if c[0] else pii.DISCLOSURE) * math.log(n / e):
            continue
        f = len(values[c, t])
        if c[0] == 0 or (surprise(b, b, e, n) >= bar and surprise(f, d - b + f, e - b + f, n - b + f) >= bar):
            told.add((c, t))
    out = []
    for text, concepts, _, spans in rows:
        mine = {t for c, t in told if c in concepts or c[0] == 2}
        found = [m.span() for m in word.finditer(text) if m.group().lower() in mine]
        out.append([(a, b) for a, b in found if not any(a < y and x < b for _, x, y in spans)])
    return out


def xxhash64_of(value):
    """Stands for any fixed order of values."""
    return hashlib.md5(value.encode()).digest()


def term_spans(row):
    return [tuple(map(int, s.split(":")[1:])) for s in row.spans.split(",") if s.startswith("term")]


def test_terms_equal_brute_force(spark):
    rnd = random.Random(13)
    texts = [words(rnd, 25, 60) for _ in range(300)]
    for i in range(60):  # a word of a class: with other values each time, and a few times alone
        texts.append(f"{words(rnd, 9, 60)} Kontakt p{i}@host{i}.example {words(rnd, 9, 60)}" if i % 20 else f"{words(rnd, 20, 60)} kontakt")
    texts += [f"caller {words(rnd, 9, 60)} +49 30 {1000000 + i} {words(rnd, 9, 60)} ref QX{i % 3}77 one.two@origin.example" for i in range(12)]
    texts += [f"Wexmoor ten copies 10.1.2.{i}" for i in range(10)] + ["Plimsoll stood by 10.9.9.9 in a text that was copied"] * 30
    got = {r.doc_id: r for r in pii.personal_data(docs_of(spark, list(enumerate(texts)))).collect()}
    want = brute_terms(texts)
    assert [term_spans(got[i]) for i in range(len(texts))] == want
    marked = {texts[i][a:b].lower() for i, spans in enumerate(want) for a, b in spans}
    assert "kontakt" in marked and "plimsoll" not in marked
    clean = {r.doc_id: r.text for r in pii.sanitise(docs_of(spark, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        assert (clean[i] == text) == (not want[i] and not brute_spans(text)) and "kontakt" not in clean[i].lower()


def test_terms_of_the_sample_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: term_spans(r) for r in pii.personal_data(docs).collect()}
    want = dict(zip(texts, brute_terms(list(texts.values())), strict=True))
    assert got == want and sum(map(len, want.values())) > 0


# --- all -----------------------------------------------------------------------------------------------


def test_oracle_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, SF)
        cols = sorted(got.columns)
        want = con.execute(f"select {', '.join(cols)} from ({sql})").fetchall()
        assert Counter(tuple(r) for r in want) == Counter(tuple(r[c] for c in cols) for r in got.collect()), name
    assert oracle.EXACT
