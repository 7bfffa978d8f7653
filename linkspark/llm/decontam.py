"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm.caches import values
from linkspark.llm.tally import chunks_of, total
from linkspark.plans.staging import stage

#: Seeds are the words at these offsets: four in a row, two and two around a
#: word that may differ, and three in a row, so that no regular edit that
#: leaves two words of three breaks them all.
SEEDS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 1, 2))
SEED_WORDS = 4
#: A seed is rare if words of its frequencies would meet by chance less than
#: once in 2**RARE_BITS places. An item without such seeds uses all of its own
#: runs of SEED_WORDS.
RARE_BITS = 26.0
#: Common seeds lead to an alignment where those of about one diagonal cover
#: this share of an item's words.
COVERED, DIAGONALS = 0.4, 32
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the item's own score from which a passage counts as a copy.
ALIGNED = 0.5
#: Words of one benchmark block, and so of the index a worker holds; larger
#: benchmarks are worked off block by block.
BLOCK_WORDS = 1_000_000
PAIR_BITS = 22

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased words of the whole text."""
    return _WORD.findall((text or "").lower())


@dataclass
class Index:
    """One block of test items: word numbers, item texts and seed grams, as fixed arrays."""

    vocab: dict[str, int]
    item_ids: list[int]
    items: list[np.ndarray]
    sizes: np.ndarray
    pairs: np.ndarray  # which hashed pairs of neighbours the items have; every seed has such a pair
    grams: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray, np.ndarray]]  # by offsets: sorted keys, item, place

    def words(self, text: str | None) -> np.ndarray:
        """Word numbers of a text; 0 for words of no item."""
        ws = words_of(text)
        get = self.vocab.get
        return np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))


_KEY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def gram_keys(ids: np.ndarray, offsets: tuple[int, ...], at: np.ndarray | None = None) -> np.ndarray:
    """64-bit keys of the words at ``offsets`` from the places ``at`` (every place by default)."""
    if at is None:
        at = np.arange(max(0, len(ids) - offsets[-1]))
    h = np.zeros(len(at), np.uint64)
    for j, o in enumerate(offsets):
        x = ids[at + o].astype(np.uint64) * _KEY[j]
        h = (h ^ x ^ (x >> np.uint64(31))) * _KEY[0]
    return h ^ (h >> np.uint64(29))


def _pair_slots(ids: np.ndarray) -> np.ndarray:
    return (((ids[:-1].astype(np.uint64) * _KEY[0]) ^ ids[1:].astype(np.uint64)) * _KEY[1]) >> np.uint64(64 - PAIR_BITS)


def _seeds_of(words: int) -> list[tuple[int, ...]]:
    """The offsets that an item of so many words uses; one shorter than a seed is a seed itself."""
    return [s for s in SEEDS if s[-1] < words] if words >= SEED_WORDS else [tuple(range(words))]


def build_index(items: list[tuple[int, str | None]]) -> Index:
    """Index items of at least one word."""
    vocab: dict[str, int] = {}
    ids, texts = [], []
    for item_id, text in items:
        ws = words_of(text)
        if ws:
            ids.append(item_id)
            texts.append(np.array([vocab.setdefault(w, len(vocab) + 1) for w in ws], np.int64))
    found: dict[tuple[int, ...], list[tuple[np.ndarray, int]]] = {}
    for i, t in enumerate(texts):
        for s in _seeds_of(len(t)):
            found.setdefault(s, []).append((gram_keys(t, s), i))
    grams = {}
    for s, of in found.items():
        keys = np.concatenate([k for k, _ in of])
        item = np.concatenate([np.full(len(k), i, np.int32) for k, i in of])
        place = np.concatenate([np.arange(len(k), dtype=np.int32) for k, _ in of])
        order = np.argsort(keys, kind="stable")
        grams[s] = keys[order], item[order], place[order]
    pairs = np.zeros(1 << PAIR_BITS, bool)
    for t in texts:
        pairs[_pair_slots(t)] = True
    return Index(vocab, ids, texts, np.array([len(t) for t in texts], np.int64), pairs, grams)


Hits = dict[tuple[int, ...], tuple[np.ndarray, np.ndarray]]


def seed_hits(index: Index, ids: np.ndarray) -> Hits:
    """By offsets: every (row of the index, place in the text) whose words agree."""
    out: Hits = {}
    near = np.flatnonzero(index.pairs[_pair_slots(ids)]) if len(ids) > 1 else np.zeros(0, np.int64)
    for s, (keys, _, _) in index.grams.items():
        first = next((i for i in range(len(s) - 1) if s[i + 1] == s[i] + 1), None)
        at = np.flatnonzero(ids) if first is None else near - s[first]
        at = at[(at >= 0) & (at < len(ids) - s[-1])]
        if len(at):
            at = at[np.logical_and.reduce([ids[at + o] > 0 for o in s])]
        if not len(at):
            continue
        runs = gram_keys(ids, s, at)
        low = np.searchsorted(keys, runs, "left")
        hit = keys[np.minimum(low, len(keys) - 1)] == runs
        if hit.any():
            low, at = low[hit], at[hit]
            k = np.searchsorted(keys, runs[hit], "right") - low
            out[s] = np.repeat(low, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k), np.repeat(at, k)
    return out


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman local score of two word sequences and the end of the aligned text."""
    n = len(text)
    prev, best, end = np.zeros(n + 1, np.int64), 0, 0
    drop = -GAP * np.arange(n + 1)
    for x in item:
        h = np.zeros(n + 1, np.int64)
        h[1:] = np.maximum(prev[:-1] + np.where(text == x, MATCH, MISMATCH), 0)
        np.maximum(h, prev + GAP, out=h)
        # gaps along the row: a running maximum, as a gap costs the same at each step
        h = np.maximum.accumulate(h + drop) - drop
        at = int(h.argmax())
        if h[at] > best:
            best, end = int(h[at]), at
        prev = h
    return best, end


def _covered(index: Index, item: np.ndarray, place: np.ndarray, at: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Which hits lie where seeds of neighbouring diagonals cover COVERED of their item's words."""
    found = np.zeros(len(item), bool)
    offsets = list(index.grams)
    for shift in (0, DIAGONALS):
        band = (at - place + index.sizes[item] + shift) // (2 * DIAGONALS)
        _, group = np.unique(np.stack([item, band]), axis=1, return_inverse=True)
        group = group.ravel()
        cells = [np.stack([group[kind == k], place[kind == k] + o]) for k, s in enumerate(offsets) for o in s]
        found |= np.bincount(np.unique(np.concatenate(cells, 1), axis=1)[0])[group] >= COVERED * index.sizes[item]
    return found


def passages(index: Index, ids: np.ndarray, rare: dict[tuple[int, ...], np.ndarray]) -> list[tuple[int, float, int, int]]:
    """``(item, score, first word, word after the last)`` of the best alignment with each seeded item.

    ``rare`` marks the rows of the index in use; others count where they
    cover much of an item. Around each seed the window leaves room for as
    many inserted words as the item has.
    """
    hits = seed_hits(index, ids)
    if not hits:
        return []
    all_ = [(*(index.grams[s][c][hits[s][0]].astype(np.int64) for c in (1, 2)), hits[s][1], np.full(len(hits[s][1]), k), rare[s][hits[s][0]]) for k, s in enumerate(index.grams) if s in hits]
    item, place, at, kind, keep = (np.concatenate(x) for x in zip(*all_, strict=True))
    if not keep.all():
        keep = keep | _covered(index, item, place, at, kind)
    item, place, at = item[keep], place[keep], at[keep]
    best: dict[int, tuple[float, int, int]] = {}
    for i in np.unique(item):
        text, mine = index.items[i], item == i
        m = len(text)
        starts = np.unique(np.maximum(at[mine] - place[mine] - m, 0))
        low = int(starts[0])
        high = low + 3 * m
        windows = []
        for s in starts[1:]:
            if s <= high:
                high = int(s) + 3 * m
            else:
                windows.append((low, high))
                low, high = int(s), int(s) + 3 * m
        windows.append((low, high))
        for low, high in windows:
            score, end = align(text, ids[low:high])
            share = score / (MATCH * m)
            if i not in best or share > best[i][0]:
                best[int(i)] = (share, low, low + end)
    return [(i, *b) for i, b in best.items()]


def rare_seeds(index: Index, counts: np.ndarray, words: int) -> dict[tuple[int, ...], np.ndarray]:
    """Which rows of the index are rare, by the corpus frequencies of their words.

    Frequencies of words, not of grams, decide, so that a passage does not
    become common by being copied. Items without a rare seed keep all their
    runs of SEED_WORDS, or the one seed that they are.
    """
    bits = -np.log2(np.maximum(counts, 1) / max(words, 1))
    flat = np.concatenate([bits[t] for t in index.items]) if index.items else np.zeros(0)
    starts = np.cumsum(index.sizes) - index.sizes
    out, some = {}, np.zeros(len(index.items), bool)
    for s, (_, item, place) in index.grams.items():
        out[s] = sum(flat[starts[item] + place + o] for o in s) >= RARE_BITS
        some[item[out[s]]] = True
    for s, (_, item, _) in index.grams.items():
        if s == SEEDS[0] or len(s) < len(SEEDS[2]):
            out[s] |= ~some[item]
        elif s == SEEDS[2]:
            out[s] |= ~some[item] & (index.sizes[item] < SEED_WORDS)
    return out


def seeded(index: Index, hits: Hits) -> bool:
    """Whether a text may hold an item: a seed of four words, or two of three of one item (or one of an item that has no two)."""
    if any(s != SEEDS[2] for s in hits):
        return True
    if not hits:
        return False
    rows, _ = hits[SEEDS[2]]
    item = index.grams[SEEDS[2]][1][np.unique(rows)]
    return bool((np.bincount(item) >= 2).any() or (index.sizes[item] < SEED_WORDS + 2).any())


SEEDED = "doc_id long, tkey binary, ids binary, task int, chunk int, counts binary"
_SEEDED = pa.schema([("doc_id", pa.int64()), ("tkey", pa.binary()), ("ids", pa.binary()), ("task", pa.int32()), ("chunk", pa.int32()), ("counts", pa.binary())])
FOUND = "doc_id long, tkey binary, best_score double, best_item long, first_word long, end_word long, n_items long"
_FOUND = pa.schema([("doc_id", pa.int64()), ("tkey", pa.binary()), ("best_score", pa.float64()), ("best_item", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("n_items", pa.int64())])


def _seeded(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    """All rows, with word numbers where a seed occurs, then word counts; counter 0 has all other words."""
    ix = index.value
    counts = np.zeros(len(ix.vocab) + 1, np.int64)
    for batch in batches:
        rows = []
        for doc_id, text in zip(values(batch.column(0)), values(batch.column(1)), strict=True):
            ids = ix.words(text)
            counts += np.bincount(ids, minlength=len(counts))
            kept = seeded(ix, seed_hits(ix, ids))
            rows.append((doc_id, xxhash.xxh3_128_digest((text or "").encode()), zlib.compress(ids.astype(np.int32).tobytes(), 1) if kept else None, None, None, None))
        rows = rows or []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SEEDED)], schema=_SEEDED)
    rows = [(None, None, None, *c) for c in chunks_of(counts)]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SEEDED)], schema=_SEEDED)


def _aligned(batches: Iterator[pa.RecordBatch], index, rare) -> Iterator[pa.RecordBatch]:
    ix = index.value
    for batch in batches:
        rows = []
        for doc_id, tkey, blob in zip(*map(values, batch.columns), strict=True):
            found = []
            if blob is not None:
                ids = np.frombuffer(zlib.decompress(blob), np.int32).astype(np.int64)
                found = [(score, ix.item_ids[i], low, end) for i, score, low, end in passages(ix, ids, rare.value) if score >= ALIGNED]
            best = max(found, key=lambda f: (f[0], -f[1] if f[1] is not None else 0), default=(None,) * 4)
            rows.append((doc_id, tkey, *best, len(found)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_FOUND)], schema=_FOUND)


def _one_block(docs: DataFrame, items: list[tuple[int, str | None]], id_col: str, text_col: str) -> DataFrame:
    index = build_index(items)
    shared = docs.sparkSession.sparkContext.broadcast(index)  # at most BLOCK_WORDS words
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seeded = stage(rows.mapInArrow(lambda b: _seeded(b, shared), SEEDED), "decontam-seeded")
    counts = total(seeded.where("chunk is not null"), len(index.vocab) + 1)
    rare = docs.sparkSession.sparkContext.broadcast(rare_seeds(index, counts, int(counts.sum())))  # a bit per seed of the block
    return seeded.where("chunk is null").select("doc_id", "tkey", "ids").mapInArrow(lambda b: _aligned(b, shared, rare), FOUND)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, contaminated, best_item, best_score, n_items, first_word, end_word)`` for every row of ``docs``.

    One pass reads the texts whole, counts the corpus frequencies of the test
    items' words and keeps the word numbers of rows in which any seed occurs;
    the alignment runs on those alone and without a shuffle. A row is
    contaminated if its best alignment reaches half of an item's own score;
    ``n_items`` counts such items, ties go to the smallest item id, and the
    words are places in the row's sequence of words.

    The items are counted first. Up to ``block_words`` words they are one
    index that every worker holds; beyond, they are split into blocks and
    each block is run over all rows. Null and empty texts and items without
    words match nothing; null ids and repeated rows are rows like others.
    Other columns are not read. Empty tables give no rows, or no findings.
    """
    text = F.col(item_text_col).cast("string")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), text.alias("text"))
    size = items.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_words))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = None
    for b in range(blocks):
        mine = sorted(((r["item_id"], r["text"]) for r in items.where(part == b).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        one = _one_block(docs, mine, id_col, text_col).withColumn("block", F.lit(b))
        found = one if found is None else found.unionByName(one)
    if blocks > 1:
        best = F.max(F.struct("best_score", (-F.col("best_item")).alias("back"), "first_word", "end_word")).alias("best")
        each = found.groupBy("doc_id", "tkey", "block").agg(best, F.max("n_items").alias("n_items"), F.count("*").alias("k"))
        each = each.groupBy("doc_id", "tkey").agg(F.max("best").alias("best"), F.sum("n_items").alias("n_items"), F.max("k").alias("k"))
        found = each.select("doc_id", "tkey", F.col("best.best_score").alias("best_score"), (-F.col("best.back")).alias("best_item"), F.col("best.first_word").alias("first_word"), F.col("best.end_word").alias("end_word"), "n_items", F.explode(F.sequence(F.lit(1).cast("long"), "k")).alias("copy"))
    return found.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "best_item", F.round("best_score", 6).alias("best_score"), "n_items", "first_word", "end_word")
