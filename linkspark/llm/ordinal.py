"""Quality: ordinal cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm.caches import WordCache, claim, values
from linkspark.llm.toxic import held_out
from linkspark.plans.staging import stage

#: Bounded learning sample of rated documents.
RATED = 12_000
#: One shared weight per hashed feature.
DIMS_BITS = 16
EPOCHS, BATCH, RATE, L2 = 60, 512, 0.05, 1e-5

_RUNS = ((re.compile(r"[^\W\d_]*[a-zà-öø-ÿ][^\W\d_]*"), "w"), (re.compile(r"[^\W\d_]+"), "W"), (re.compile(r"\d+"), "9"))


def _slot(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) >> (64 - DIMS_BITS)


def shape_of(token: str) -> str:
    """A token with words, upper-case words and numbers reduced to one sign each."""
    for pattern, sign in _RUNS:
        token = pattern.sub(sign, token)
    return token


def slots_of(token: str) -> tuple[int, int, int]:
    """A token's hashed features: the word itself, its shape, and its length class."""
    return _slot(f"t:{token.lower()}"), _slot(f"s:{shape_of(token)}"), _slot(f"l:{min(len(token), 20)}")


_slots = WordCache(slots_of, most=60_000)


def _marks(tokens: list[str], text: str) -> list[int]:
    """Features of the whole text: size, repeated neighbours, repeated words, repeated lines."""
    n = len(tokens)
    if not n:
        return [_slot("d:empty")]
    lines = [x for x in text.split("\n") if x]
    near = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / n
    shares = {"near": near, "words": len(set(tokens)) / n, "lines": len(set(lines)) / max(1, len(lines)), "per_line": min(1.0, n / max(1, len(lines)) / 50)}
    return [_slot(f"d:size:{min(int(np.log2(n + 1)), 14)}"), *(_slot(f"d:{k}:{int(10 * v)}") for k, v in shares.items())]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a whole text: token features by share, text features at full weight."""
    tokens = (text or "").split()
    marks = np.array(_marks(tokens, text or ""), np.int64)
    if not tokens:
        return marks, np.ones(len(marks), np.float32)
    flat = np.array([_slots[t] for t in tokens], np.int64).ravel()
    slots, counts = np.unique(flat, return_counts=True)
    return np.concatenate([slots, marks]), np.concatenate([counts / len(tokens), np.ones(len(marks))]).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """Shared weights and ordered thresholds: P(grade > k) = sigmoid(w x - thresholds[k])."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, of linear scores ``x``."""
        return 1 / (1 + np.exp(-np.clip(x[:, None] - self.thresholds[None, :], -40, 40)))


def ordinal_loss(score: np.ndarray, cuts: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of grades ``y``, and its gradients by score and by threshold."""
    every = np.arange(len(score))
    tail = np.concatenate([np.ones((len(score), 1)), 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -40, 40))), np.zeros((len(score), 1))], 1)
    hi, lo = tail[every, y], tail[every, y + 1]
    p = np.maximum(hi - lo, 1e-9)
    d_hi, d_lo = hi * (1 - hi), lo * (1 - lo)
    d_cut = np.zeros(len(cuts) + 2)
    np.add.at(d_cut, y, d_hi / p / len(score))
    np.add.at(d_cut, y + 1, -d_lo / p / len(score))
    return float(-np.log(p).mean()), -(d_hi - d_lo) / p / len(score), d_cut[1 : len(cuts) + 1]


def ordinal_fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, dims: int = 1 << DIMS_BITS, seed: int = 11) -> Model:
    """Maximum likelihood by Adam: P(grade = k) = P(grade > k - 1) - P(grade > k).

    Thresholds are a first value plus positive steps (exponentials), so they
    stay in order. With no rows, all grades are equally likely.
    """
    k = levels - 1
    if not len(rows):
        share = 1 - np.arange(1, levels) / levels
        return Model(np.zeros(dims), np.log((1 - share) / share))
    counts = np.bincount(grades, minlength=levels)
    above = np.clip(counts[::-1].cumsum()[::-1][1:] / len(grades), 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log((1 - above) / above) + 1e-3 * np.arange(k))
    lens = np.array([len(i) for i, _ in rows])
    flat, vals = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lens)])
    theta = np.concatenate([np.zeros(dims), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v, step, rnd = np.zeros_like(theta), np.zeros_like(theta), 0, np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for at in np.array_split(rnd.permutation(len(rows)), max(1, len(rows) // BATCH)):
            n = lens[at]
            owner = np.repeat(np.arange(len(at)), n)
            pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[at], n)
            cols, x = flat[pos], vals[pos]
            score = np.bincount(owner, theta[cols] * x, len(at))
            cuts = theta[dims] + np.concatenate([[0], np.cumsum(np.exp(theta[dims + 1 :]))])
            _, d_score, d_cut = ordinal_loss(score, cuts, grades[at])
            grad = np.concatenate([np.bincount(cols, d_score[owner] * x, dims) + L2 * theta[:dims], [d_cut.sum()], d_cut[::-1].cumsum()[::-1][1:] * np.exp(theta[dims + 1 :])])
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(theta[:dims], theta[dims] + np.concatenate([[0], np.cumsum(np.exp(theta[dims + 1 :]))]))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("ordinal")
    for batch in batches:
        found = [features(t) for t in values(batch.column(0))]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], names=["grade", "slots", "vals"])


def fit(docs: DataFrame, ratings: DataFrame, levels: int, grade_col: str = "grade", id_col: str = "doc_id", text_col: str = "text", rated: int = RATED) -> Model:
    """Learn from at most ``rated`` ratings outside the held-out fold, those of the smallest id hashes.

    Of an id that repeats in ``docs`` one text counts, that of the least hash;
    of one that repeats in ``ratings`` the lowest grade. Null grades and
    grades outside 0 to ``levels`` - 1 are ignored.
    """
    known = ratings.select(F.col(id_col).cast("long").alias("id"), F.col(grade_col).cast("int").alias("grade"))
    known = known.where(F.col("id").isNotNull() & F.col("grade").between(0, levels - 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.min("grade").alias("grade"))
    known = stage(known.orderBy(F.xxhash64("id"), "id").limit(rated), "ordinal-ratings")  # bounded by the parameter
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    one = text.join(F.broadcast(known), "id").groupBy("id", "grade").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    rows = one.select("text", "grade").mapInArrow(_featured, "grade int, slots binary, vals binary").collect()
    rows.sort(key=lambda r: (r["grade"], r["slots"], r["vals"]))
    pairs = [(np.frombuffer(r["slots"], np.int32).astype(np.int64), np.frombuffer(r["vals"], np.float32)) for r in rows]
    return ordinal_fit(pairs, np.array([r["grade"] for r in rows], np.int64), levels)


def _grade(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    claim("ordinal-grade")
    model = shared.value
    w = model.weights

    sums = WordCache(lambda token: float(sum(w[s] for s in slots_of(token))), shared=False)
    for batch in batches:
        scores = np.zeros(batch.num_rows)
        for i, text in enumerate(values(batch.column(2))):
            tokens = (text or "").split()
            scores[i] = sum(map(sums.__getitem__, tokens)) / max(1, len(tokens)) + w[_marks(tokens, text or "")].sum()
        tails = model.tails(scores)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tails.sum(1)), *(pa.array(tails[:, k]) for k in range(tails.shape[1]))], names=["doc_id", "held_out", "expected_grade", *(f"p_above_{k}" for k in range(tails.shape[1]))])


def grade_rows(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", floor: int = 1, least: float = 0.5) -> DataFrame:
    """``(doc_id, held_out, expected_grade, p_above_0 .., keep)`` for every row; ``keep`` if P(grade >= floor) reaches ``least``.

    Null and empty texts are graded by their emptiness. Null ids count as held
    out. Repeated rows are rows like others. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS weights, whatever the corpus
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    tails = ", ".join(f"p_above_{k} double" for k in range(len(model.thresholds)))
    graded = rows.mapInArrow(lambda b: _grade(b, shared), f"doc_id long, held_out boolean, expected_grade double, {tails}")
    return graded.withColumn("keep", F.col(f"p_above_{floor - 1}") >= least)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades of labelled documents by their use for training: 0 to be left out (bad quality), 1 of use where a
    filter follows (good, but toxic), 2 of use anywhere."""
    quality, toxic = F.col("quality"), F.coalesce(F.col("toxic"), F.lit(0))
    return labels.where(quality.isNotNull()).select("doc_id", F.when(quality == 0, 0).when(toxic == 1, 1).otherwise(2).alias("grade"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels outside the held-out fold and grade every row of ``docs``; see ``grade_rows``."""
    return grade_rows(docs, fit(docs, ratings_of(labels), 3))
