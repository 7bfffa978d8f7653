"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded and verified."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm.caches import WordCache, claim, small_batches, values
from linkspark.llm.tally import chunks_of, total
from linkspark.operators.components import connected_components
from linkspark.plans.staging import broadcast_if_small, stage

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
SAMPLES = BANDS * ROWS
#: Document frequencies are counted in 2**SLOT_BITS hashed word slots: a fixed
#: table at every corpus size. Words of one slot share its frequency.
SLOT_BITS = 18
#: A word's weight is 1 + RARITY times its smoothed, normalised idf, so the
#: rarest word weighs twice what a word of every text does, and a weighted
#: similarity of 0.8 means about what it means on plain shingles.
RARITY = 1.0
#: Rounds of leader comparison before what is left of a bucket is compared in blocks.
LEADER_ROUNDS = 2
BLOCK_LEFT, BLOCK_RIGHT = 128, 512
#: Counters of shingles in buckets that are larger than a block; common ones go last in the order of prefixes.
PREFIX_BITS = 20
#: Shingles that are sampled at once; bounds the arrays of a very long text.
SAMPLE_CHUNK = 2048

_WORD = re.compile(r"\w+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


_hashes = WordCache(xxhash.xxh3_64_intdigest, most=400_000)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-cased words of the whole text, in order."""
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def unit_key(words: np.ndarray, text: str | None) -> bytes:
    """Equal for texts with the same words; texts without words are told apart by their characters."""
    return xxhash.xxh3_128_digest(words.tobytes() if len(words) else b"text:" + (text or "").encode())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(29))


_PLACE = _mix((np.arange(1, SHINGLE_WORDS + 1, dtype=np.uint64)) * _M1) | np.uint64(1)


def shingles(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct five-word shingles (sorted hashes) and their weights; a shorter text is one shingle.

    The weight is ``(1 + ln tf)`` times the mean weight of the shingle's words by idf.
    """
    n, k = len(words), min(len(words), SHINGLE_WORDS)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.float32)
    rarity = idf[(words >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
    h, w = np.zeros(n - k + 1, np.uint64), np.zeros(n - k + 1, np.float32)
    for j in range(k):
        h += words[j : n - k + 1 + j] * _PLACE[j]
        w += rarity[j : n - k + 1 + j]
    h, first, tf = np.unique(_mix(h), return_index=True, return_counts=True)
    return h, (w[first] / np.float32(k)) * (1 + np.log(tf)).astype(np.float32)


def _gamma2() -> np.ndarray:
    """65,536 quantiles of Gamma(2, 1), by Newton's method on 1 - (1 + x) exp(-x)."""
    u = (np.arange(65536) + 0.5) / 65536
    x = np.sqrt(2 * u) + u
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / np.maximum(x * np.exp(-x), 1e-12), 1e-9)
    return x


_R = _gamma2().astype(np.float32)
_LN_C = np.log(_R)
_SEEDS = _mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * _M1)


def sample(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One consistent weighted sample per seed, as a hash of (shingle, t).

    Improved consistent weighted sampling: r and c from Gamma(2, 1), beta
    uniform, t = floor(ln w / r + beta), ln a = ln c - r (t - beta) - r; the
    shingle of least a is drawn. Two texts agree on a sample with probability
    equal to their weighted Jaccard similarity.
    """
    best, value = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64)
    every = np.arange(SAMPLES)
    for at in range(0, len(h), SAMPLE_CHUNK):
        part = h[at : at + SAMPLE_CHUNK]
        z = part[None, :] ^ _SEEDS[:, None]
        z *= _M1
        z ^= z >> np.uint64(32)
        z *= _M2
        field = z.view(np.uint16).reshape(SAMPLES, len(part), 4)  # the upper three are uniform draws
        r = _R[field[:, :, 3]]
        beta = field[:, :, 1].astype(np.float32)
        beta += np.float32(0.5)
        beta *= np.float32(1 / 65536)
        t = np.log(w[at : at + SAMPLE_CHUNK]) / r
        t += beta
        np.floor(t, out=t)
        a = _LN_C[field[:, :, 2]]
        beta -= t
        beta -= np.float32(1)
        beta *= r
        a += beta
        low = a.argmin(1)
        found = a[every, low]
        better = found < best
        best[better] = found[better]
        value[better] = _mix(part[low] * _M1 + t[every, low].astype(np.int64).view(np.uint64))[better]
    return value


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of ROWS samples."""
    rows = samples.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _M1
    for j in range(ROWS):
        key = _mix(key * _M2 + rows[:, j])
    return key


def similarity(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """Weighted Jaccard similarity of two shingle vectors."""
    _, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    shared = float(np.minimum(w1[i], w2[j]).sum(dtype=np.float64))
    total = float(w1.sum(dtype=np.float64) + w2.sum(dtype=np.float64)) - shared
    return shared / total if total > 0 else 0.0


# --- passes over the texts ---------------------------------------------------

UNITS = "doc_id long, rid long, tkey binary, ukey binary, task int, chunk int, counts binary"
_UNITS = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("tkey", pa.binary()), ("ukey", pa.binary()), ("task", pa.int32()), ("chunk", pa.int32()), ("counts", pa.binary())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit keys of all rows, then this task's slot counts in compressed chunks."""
    claim("near")
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    for batch in batches:
        keys = []
        for text in values(batch.column(3)):
            words = word_hashes(text)
            keys.append(unit_key(words, text))
            counts[np.unique(words >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] += 1
        nulls = [pa.nulls(len(keys), f.type) for f in list(_UNITS)[4:]]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(keys, pa.binary()), *nulls], schema=_UNITS)
    chunks = chunks_of(counts)
    nulls = [pa.nulls(len(chunks), f.type) for f in list(_UNITS)[:4]]
    yield pa.RecordBatch.from_arrays([*nulls, *(pa.array([c[i] for c in chunks], f.type) for i, f in enumerate(list(_UNITS)[4:]))], schema=_UNITS)


def word_weights(units: DataFrame, rows: int) -> np.ndarray:
    """Slot to weight: 1 + RARITY * ln((1 + N) / (1 + df)) / ln(1 + N), over all rows."""
    df, n = total(units.where("chunk is not null"), 1 << SLOT_BITS), max(rows, 1)
    return (1 + RARITY * np.log((1 + n) / (1 + np.minimum(df, n))) / np.log(1 + n)).astype(np.float32)


def _bands(batches: Iterator[pa.RecordBatch], idf) -> Iterator[pa.RecordBatch]:
    claim("near")
    for batch in batches:
        keys, buckets = [], []
        for text in values(batch.column(0)):
            words = word_hashes(text)
            if len(words):
                keys.append(unit_key(words, text))
                buckets.append(band_keys(sample(*shingles(words, idf.value))))
        flat = np.concatenate(buckets).view(np.int64) if buckets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([k for k in keys for _ in range(BANDS)], pa.binary()), pa.array(flat)], names=["ukey", "bucket"])


def _vectors(batches: Iterator[pa.RecordBatch], idf) -> Iterator[pa.RecordBatch]:
    claim("near")
    for batch in batches:
        out = []
        for text, want in zip(values(batch.column(0)), values(batch.column(1)), strict=True):
            words = word_hashes(text)
            if unit_key(words, text) == want:
                h, w = shingles(words, idf.value)
                out.append((want, h.tobytes(), w.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (zip(*out, strict=True) if out else [()] * 3)], names=["ukey", "h", "w"])


def _parse(h: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(h, np.uint64), np.frombuffer(w, np.float32)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, h1, w1, h2, w2 = batch.columns
        sims = [similarity(*_parse(x1.as_py(), y1.as_py()), *_parse(x2.as_py(), y2.as_py())) for x1, y1, x2, y2 in zip(h1, w1, h2, w2, strict=True)]
        yield pa.RecordBatch.from_arrays([a, b, pa.array(sims, pa.float64())], names=["leader", "ukey", "sim"])


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """All links between the left and the right rows of one block pair."""
    left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    out = []
    if len(left) and len(right):
        vecs = [_parse(h, w) for h, w in zip(right["h"], right["w"], strict=True)]
        lens = np.array([len(h) for h, _ in vecs])
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        flat_h, flat_w = np.concatenate([h for h, _ in vecs]), np.concatenate([w for _, w in vecs])
        vocab, code = np.unique(flat_h, return_inverse=True)
        sums, keys = np.add.reduceat(flat_w.astype(np.float64), starts), right["ukey"].to_numpy()
        for key, hb, wb in zip(left["ukey"], left["h"], left["w"], strict=True):
            h, w = _parse(hb, wb)
            dense = np.zeros(len(vocab), np.float32)
            at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
            hit = vocab[at] == h
            dense[at[hit]] = w[hit]
            shared = np.add.reduceat(np.minimum(dense[code], flat_w).astype(np.float64), starts)
            sim = shared / (sums + w.sum(dtype=np.float64) - shared)
            out += [(key, keys[i]) for i in np.flatnonzero(sim >= SIMILARITY) if keys[i] != key]
    return pd.DataFrame(out, columns=["u", "v"])


# --- the operator --------------------------------------------------------------


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, class_id, class_size, kept)`` for every row of ``docs``.

    Rows with the same words are one unit. Units that share a band bucket are
    compared with the bucket's leader, the unit that meets the most others;
    a pair is linked at a weighted Jaccard similarity of 0.8 or more over
    five-word TF-IDF shingles. Bucket members that the leader does not link,
    and those that could still be linked to one of them (the distance is a
    metric, so d(x, leader) >= d(y, leader) - 0.2), go on: to a new leader,
    then block against block, after buckets larger than a block were dealt
    anew by the rare shingles that linked texts must share. No pairs of one bucket are enumerated as rows
    and none is left out. Classes are the connected components of the links;
    the largest id of a class is its ``class_id`` and stays.

    Texts without words (empty, null, signs only) belong together only if
    their characters are equal; null counts as empty. Null ids lose against
    any other. Of rows that repeat the id that stays the first is ``kept``.
    Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "rid", F.unhex(F.md5(F.col("text").cast("binary"))).alias("tkey"), "text")
    with small_batches(spark):
        light, by_unit = _classes(rows)
    out = light.join(by_unit, "ukey")
    return out.select("doc_id", F.col("class_top.doc_id").alias("class_id"), "class_size", (F.col("rid") == -F.col("class_top.back")).alias("kept"))


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, rid, tkey, ukey)`` of all rows and ``(ukey, class_top, class_size)`` of all units; whatever runs in Python has run by then."""
    spark = rows.sparkSession
    counted = stage(rows.mapInArrow(_count, UNITS), "near-units")
    light = counted.where("chunk is null").select("doc_id", "rid", "tkey", "ukey")
    idf = spark.sparkContext.broadcast(word_weights(counted, light.count()))
    banded = stage(rows.select("text").mapInArrow(lambda b: _bands(b, idf), "ukey binary, bucket long").distinct(), "near-bands")
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stage(banded.join(sizes, "bucket"), "near-members").select("bucket", "ukey", "n")
    degree = members.groupBy("ukey").agg(F.sum("n").alias("degree"))
    scored = stage(members.select("bucket", "ukey").join(degree, "ukey"), "near-scored")
    texts = candidate_texts(rows, light, degree)
    vectors = stage(texts.mapInArrow(lambda b: _vectors(b, idf), "ukey binary, h binary, w binary").dropDuplicates(["ukey"]), "near-vectors")

    links = None
    for turn in range(LEADER_ROUNDS):
        first = scored.groupBy("bucket").agg(F.max(F.struct("degree", "ukey"))["ukey"].alias("leader"))
        led = scored.join(first, "bucket").where("ukey <> leader")
        pairs = led.select("leader", "ukey").distinct()
        met = pairs.join(vectors.withColumnsRenamed({"h": "h2", "w": "w2"}), "ukey").join(vectors.select(F.col("ukey").alias("leader"), F.col("h").alias("h1"), F.col("w").alias("w1")), "leader")
        sims = stage(met.select("leader", "ukey", "h1", "w1", "h2", "w2").mapInArrow(_verify, "leader binary, ukey binary, sim double"), "near-sims")
        now = sims.where(F.col("sim") >= SIMILARITY).select(F.col("leader").alias("u"), F.col("ukey").alias("v"))
        links = now if links is None else links.unionByName(now)
        far = led.join(sims, ["leader", "ukey"]).select("bucket", "ukey", "degree", (1 - F.col("sim")).alias("d"))
        far = stage(far.withColumn("apart", F.col("d") > 1 - SIMILARITY), "near-far")
        nearest = far.where("apart").groupBy("bucket").agg(F.min("d").alias("nearest"))
        open_ = far.join(nearest, "bucket").where(F.col("apart") | (F.col("d") >= F.col("nearest") - (1 - SIMILARITY) - 1e-6))
        scored = stage(open_.select("bucket", "ukey", "degree", "apart"), "near-open")
        if scored.isEmpty():
            break
        if turn == LEADER_ROUNDS - 1:
            links = links.unionByName(_blocks(scored, vectors))
        else:
            # what the leader linked may only be compared with what it did not link
            inner = scored.groupBy("bucket").agg(F.count("*").alias("n"))
            scored = stage(scored.join(inner.where("n > 1").select("bucket"), "bucket"), "near-open")
    links = stage(links.distinct(), "near-links")
    comps = connected_components(links).select(F.col("node").alias("ukey"), F.col("component").alias("comp"))
    best = F.max(F.struct("doc_id", (-F.col("rid")).alias("back")))
    per_unit = light.groupBy("ukey").agg(best.alias("top"), F.count("*").alias("n")).join(comps, "ukey", "left").withColumn("comp", F.coalesce("comp", "ukey"))
    per_unit = stage(per_unit, "near-classes")
    classes = per_unit.groupBy("comp").agg(F.max("top").alias("class_top"), F.sum("n").alias("class_size"))
    return light, per_unit.select("ukey", "comp").join(classes, "comp").select("ukey", "class_top", "class_size")


def candidate_texts(rows: DataFrame, light: DataFrame, degree: DataFrame) -> DataFrame:
    """``(text, want)``: a text for each candidate unit, by id and digest, so that repeated or null ids bring no other texts along."""
    units = light.groupBy("ukey").agg(F.max(F.struct("doc_id", "tkey")).alias("one"))
    wanted = stage(degree.select("ukey").join(units, "ukey").select("one.*", "ukey"), "near-wanted")
    side = broadcast_if_small(wanted.select(F.col("doc_id").alias("id"), F.col("tkey").alias("digest"), F.col("ukey").alias("want")), 64)
    return rows.join(side, (F.col("tkey") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("text", "want")


def _shingle_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << PREFIX_BITS, np.int64)
    for batch in batches:
        for h in batch.column(0):
            np.add.at(counts, (np.frombuffer(h.as_py(), np.uint64) >> np.uint64(64 - PREFIX_BITS)).astype(np.int64), 1)
    chunks = chunks_of(counts)
    yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in chunks], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["task", "chunk", "counts"])


def prefix(h: np.ndarray, w: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The least common shingles, until those that are left weigh less than SIMILARITY of the whole.

    What two texts share weighs at least SIMILARITY of either if their
    similarity does. If they shared nothing of their prefixes, the one whose
    prefix ends first in the common order would share only what is left of it,
    which weighs less. So linked texts meet at a shingle of both prefixes.
    """
    order = np.lexsort((h, common[(h >> np.uint64(64 - PREFIX_BITS)).astype(np.int64)]))
    left = w.sum(dtype=np.float64) - np.cumsum(w[order], dtype=np.float64)
    return h[order[: int(np.argmax(left < SIMILARITY * (1 - 1e-6) * w.sum(dtype=np.float64))) + 1]]


def _prefixes(batches: Iterator[pa.RecordBatch], common) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [prefix(*_parse(h, w), common.value).view(np.int64) for h, w in zip(*map(values, batch.columns[2:]), strict=True)]
        row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)), batch.column(0).take(row), batch.column(1).take(row)], names=["bucket", "ukey", "apart"])


def _narrowed(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """Buckets larger than a block, dealt anew by the shingles of their members' prefixes.

    Texts that share a long passage and little else fall into one band bucket
    but have their own rare shingles first, so few of them meet again. The
    order of shingles is by one table of hashed counts over these members;
    its size is fixed, and collisions change the effort, not the links.
    """
    units = stage(members.groupBy("ukey").agg(F.max("apart").alias("apart")).join(vectors, "ukey"), "near-large")
    counts = total(units.select("h").mapInArrow(_shingle_counts, "task int, chunk int, counts binary"), 1 << PREFIX_BITS)
    common = members.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 31) - 1).astype(np.int32))
    dealt = units.select("ukey", "apart", "h", "w").mapInArrow(lambda b: _prefixes(b, common), "bucket long, ukey binary, apart boolean")
    return stage(dealt, "near-prefixes")


def _blocks(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """Links of the unlinked members of each bucket with all its open members, block against block."""
    members = members.select("bucket", "ukey", "apart")
    large = members.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_RIGHT).select("bucket")
    large = stage(large, "near-large-buckets")
    if not large.isEmpty():
        large = broadcast_if_small(large, 16)
        members = members.join(large, "bucket", "left_anti").unionByName(_narrowed(members.join(large, "bucket", "left_semi"), vectors))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("ukey"), F.lit(1 << 30)))
    sizes = salted.groupBy("bucket").agg(F.sum(F.col("apart").cast("int")).alias("lefts"), F.count("*").alias("rights"))
    salted = salted.join(sizes.where("rights > 1"), "bucket")
    lefts, rights = F.ceil(F.col("lefts") / BLOCK_LEFT).cast("int"), F.ceil(F.col("rights") / BLOCK_RIGHT).cast("int")
    left = salted.where("apart").select("bucket", "ukey", F.lit(0).alias("side"), F.pmod("salt", lefts).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), rights - 1)).alias("j"))
    right = salted.select("bucket", "ukey", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), lefts - 1)).alias("i"), F.pmod("salt", rights).cast("int").alias("j"))
    return left.unionByName(right).join(vectors, "ukey").groupBy("bucket", "i", "j").applyInPandas(_block_links, "u binary, v binary")
