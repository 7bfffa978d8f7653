"""Token counts that follow edits: a segment tree of pre-tokens per document."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm.caches import WordCache, claim, values
from linkspark.plans.staging import stage

#: Leaves of one block; a block that outgrows MOST_LEAVES has the tree rebuilt.
LEAVES, MOST_LEAVES = 128, 1024
#: A pre-token depends on no character further than this behind its end: one
#: that ends white space, or two of a contraction that starts at its last.
LOOKAHEAD = 1

#: The public byte-level pre-token pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾"
#: The same over characters up to U+017F, for the faster engine.
_FAST = re.compile(PATTERN.replace(r" ?\p{L}+", f" ?[{_L}]+").replace(r" ?\p{N}+", f" ?[{_N}]+").replace(r"\p{L}\p{N}", _L + _N))
_PLAIN = re.compile("[\t\n\r\x20-~\xa1-ſ–—‘’“”…€]*")


class Counter:
    """Tokens of pre-tokens by a byte-level BPE rank file; each pre-token is encoded once per worker."""

    _open: dict[str, Counter] = {}

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = regex.compile(PATTERN)
        self.cache = WordCache(lambda piece: len(self.encoding.encode_ordinary(piece)))

    @classmethod
    def of(cls, path: str) -> Counter:
        """One instance per file and worker process."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def count(self, pieces: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        return list(map(self.cache.__getitem__, pieces))

    def leaves(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of each pre-token of a text."""
        pieces = self.pattern_for(text).findall(text)
        return np.fromiter(map(len, pieces), np.int64, len(pieces)), np.fromiter(map(self.cache.__getitem__, pieces), np.int64, len(pieces))

    def pattern_for(self, text: str):
        """The engine that can split ``text``."""
        return _FAST if _PLAIN.fullmatch(text) else self.slow


class CountTree:
    """Sums of characters and tokens over blocks of pre-tokens; node i has children 2i and 2i + 1."""

    def __init__(self, text: str, counter: Counter, leaves: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.text, self.counter = text, counter
        self.pattern = counter.pattern_for(text)
        self.encoded_chars = self.encoded_leaves = 0
        self._build(*(leaves or counter.leaves(text)))

    def _build(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        m = max(1, -(-len(chars) // LEAVES))
        self.size = 1 << (m - 1).bit_length()
        self.blocks = [(chars[i * LEAVES : (i + 1) * LEAVES].tolist(), tokens[i * LEAVES : (i + 1) * LEAVES].tolist()) for i in range(m)]
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        if len(chars):
            at = np.arange(0, len(chars), LEAVES)
            self.sums[self.size : self.size + m] = np.stack([np.add.reduceat(chars, at), np.add.reduceat(tokens, at)], 1)
        width = self.size
        while width > 1:
            width //= 2
            self.sums[width : 2 * width] = self.sums[2 * width : 4 * width : 2] + self.sums[2 * width + 1 : 4 * width : 2]

    @property
    def tokens(self) -> int:
        """Tokens of the whole text: the root's sum."""
        return int(self.sums[1, 1])

    @property
    def leaf_count(self) -> int:
        return sum(len(c) for c, _ in self.blocks)

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of all leaves, for storing."""
        return np.array([x for c, _ in self.blocks for x in c], np.int64), np.array([x for _, t in self.blocks for x in t], np.int64)

    def _find(self, place: int) -> tuple[int, int, int]:
        """Block, leaf in it and start of the leaf that holds character ``place`` (the end, if beyond all)."""
        node, start = 1, 0
        if place >= self.sums[1, 0]:
            b = max((i for i, (c, _) in enumerate(self.blocks) if c), default=0)
            return b, len(self.blocks[b][0]), int(self.sums[1, 0])
        while node < self.size:
            node *= 2
            if place - start >= self.sums[node, 0]:
                start += int(self.sums[node, 0])
                node += 1
        b = node - self.size
        for i, n in enumerate(self.blocks[b][0]):
            if place < start + n:
                return b, i, start
            start += n
        raise AssertionError("sums and leaves differ")

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters [start, end) by ``new`` and encode again only what that can change."""
        n = len(self.text)
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        b, i, at = self._find(max(start - 1 - LOOKAHEAD, 0))
        if self.pattern is _FAST and not _PLAIN.fullmatch(new):
            self.pattern = self.counter.slow
        # walk the old leaves along until a new boundary meets an old one behind the edit
        first, old_at, pieces, pos = (b, i), at, [], at
        cb, ci = b, i
        met = False
        while True:
            while old_at + shift < pos or old_at < end:
                while cb < len(self.blocks) and ci >= len(self.blocks[cb][0]):
                    cb, ci = cb + 1, 0
                if cb >= len(self.blocks):
                    break
                old_at += self.blocks[cb][0][ci]
                ci += 1
            met = pos >= start + len(new) and old_at + shift == pos and old_at >= end
            if met or pos >= len(text):
                break
            m = self.pattern.match(text, pos)
            pieces.append(m.group())
            pos = m.end()
        if not met:
            cb, ci = len(self.blocks) - 1, len(self.blocks[-1][0])
        counts = self.counter.count(pieces)
        self.encoded_chars += sum(map(len, pieces))
        self.encoded_leaves += len(pieces)
        self.text = text
        lens = [len(p) for p in pieces]
        fb, fi = first
        head, tail = self.blocks[fb], self.blocks[cb]
        merged = head[0][:fi] + lens + tail[0][ci:], head[1][:fi] + counts + tail[1][ci:]
        for k in range(fb, cb + 1):
            self.blocks[k] = ([], []) if k > fb else merged
        if len(merged[0]) > MOST_LEAVES:
            self._build(*self.leaves())
            return
        for k in range(fb, cb + 1):
            node = self.size + k
            self.sums[node] = sum(self.blocks[k][0]), sum(self.blocks[k][1])
        low, high = (self.size + fb) // 2, (self.size + cb) // 2
        while low >= 1:
            self.sums[low : high + 1] = self.sums[2 * low : 2 * high + 2 : 2] + self.sums[2 * low + 1 : 2 * high + 2 : 2]
            low, high = low // 2, high // 2


# --- the distributed part ------------------------------------------------------

TREES = "doc_id long, text string, tokens long, n_leaves long, leaf_chars binary, leaf_tokens binary, edits array<struct<start:long,end:long,new:string>>"
COUNTS = "doc_id long, tokens_before long, tokens_after long, leaves long, encoded_leaves long, encoded_chars long, text_chars long"
EDITS = "array<struct<start:long,end:long,new:string>>"


def _pack(a: np.ndarray) -> bytes:
    """A byte per leaf, 255 and four bytes behind all for one that needs more; the table's codec does the rest."""
    return np.minimum(a, 255).astype(np.uint8).tobytes() + a[a >= 255].astype("<i4").tobytes()


def _unpack(b: bytes, leaves: int) -> np.ndarray:
    out = np.frombuffer(b, np.uint8, leaves).astype(np.int64)
    out[out == 255] = np.frombuffer(b, "<i4", offset=leaves)
    return out


def _trees(batches: Iterator[pa.RecordBatch], vocab: str) -> Iterator[pa.RecordBatch]:
    claim("edits")
    counter = Counter.of(vocab)
    for batch in batches:
        rows = []
        for text in values(batch.column(1)):
            chars, tokens = counter.leaves(text)
            rows.append((int(tokens.sum()), len(chars), _pack(chars), _pack(tokens)))
        new = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new, batch.column(2)], names=["doc_id", "text", "tokens", "n_leaves", "leaf_chars", "leaf_tokens", "edits"])


def build_trees(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """A stored segment tree per document; ``edits_col`` rides along."""
    edits = F.col(edits_col) if edits_col else F.lit(None)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), edits.cast(EDITS).alias("edits"))
    return rows.mapInArrow(lambda b: _trees(b, vocab), TREES)


def _edited(tree: CountTree, edits: list[dict] | None) -> CountTree:
    for e in edits or []:
        tree.edit(e["start"] or 0, e["end"] or 0, e["new"] or "")
    return tree


def _counts(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(7)], names=[c.split()[0] for c in COUNTS.split(", ")])


def _apply(batches: Iterator[pa.RecordBatch], vocab: str, keep: bool) -> Iterator[pa.RecordBatch]:
    """One stored tree at a time: its sums from its leaves, then the edits; only what these touch is encoded."""
    claim("edits")
    counter = Counter.of(vocab)
    for batch in batches:
        rows = []
        for doc_id, text, before, n, chars, tokens, edits in zip(*map(values, batch.columns), strict=True):
            tree = _edited(CountTree(text, counter, (_unpack(chars, n), _unpack(tokens, n))), edits)
            rows.append((doc_id, tree.text, tree.tokens, tree.leaf_count, *map(_pack, tree.leaves()), None) if keep else (doc_id, before, tree.tokens, tree.leaf_count, tree.encoded_leaves, tree.encoded_chars, len(tree.text)))
        if keep:
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), batch.column(6).type]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["doc_id", "text", "tokens", "n_leaves", "leaf_chars", "leaf_tokens", "edits"])
        else:
            yield _counts(rows)


def apply_edits(trees: DataFrame, vocab: str) -> DataFrame:
    """Counts before and after each row's edits, which are applied in their order."""
    return trees.mapInArrow(lambda b: _apply(b, vocab, False), COUNTS)


def edited_trees(trees: DataFrame, vocab: str) -> DataFrame:
    """The stored trees after each row's edits, for the next batch of edits."""
    return trees.mapInArrow(lambda b: _apply(b, vocab, True), TREES)


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Attach a table ``(doc_id, seq, start, end, new)``; edits of one document are applied by ``seq``.

    Each tree with that id gets them, so rows that repeat an id all change
    alike; edits of null or unknown ids are ignored. A document's edits come
    together in one row, as its text does.
    """
    lists = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "new"))).alias("e"))
    lists = lists.select("doc_id", F.transform("e", lambda x: F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"), x["new"].cast("string").alias("new"))).alias("edits"))
    return trees.drop("edits").join(lists, "doc_id", "left").select("doc_id", "text", "tokens", "n_leaves", "leaf_chars", "leaf_tokens", "edits")


def count_edited(docs: DataFrame, vocab: str, edits_col: str = "edits", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of every document before and after its edits.

    The trees of all documents are built and stored; the edits then work on
    the stored trees alone and encode nothing but what they touch. Two narrow
    passes, no shuffle. Columns: doc_id, tokens_before, tokens_after, leaves,
    encoded_leaves and encoded_chars (what the edits made the tree encode
    again), text_chars.

    Null and empty texts have no tokens; null edits change nothing; places
    beyond the text are moved to its end. Null ids and repeated rows are rows
    like others; very long texts are one tree each. Other columns are not
    read. An empty table gives no rows.
    """
    return apply_edits(stage(build_trees(docs, vocab, id_col, text_col, edits_col), "edits-trees"), vocab)
