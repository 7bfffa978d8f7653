"""Toxicity: a linear classifier learnt by non-negative positive-unlabelled risk minimisation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.llm.caches import WordCache, claim, values
from linkspark.plans.staging import stage

#: Bounded learning sample: confirmed toxic documents and unlabelled ones.
POSITIVES, UNLABELLED = 8000, 24000
#: Hashed features: words and their prefixes of 4, 5 and 7 characters, by presence.
FEATURE_BITS = 26
PREFIXES = (4, 5, 7)
#: Features kept for the linear model, the positives that one must occur in,
#: and the log-likelihood ratio against chance that it must exceed.
FEATURES, SUPPORT, EVIDENCE = 4096, 4, 25.0
EPOCHS, BATCH, RATE, L1 = 60, 2048, 0.05, 1e-3
#: nnPU: below -BETA the negative risk counts as overfitted and is pushed back by GAMMA.
BETA, GAMMA = 0.0, 1.0

_WORD = re.compile(r"\w+")


def features_of(word: str) -> tuple[int, ...]:
    """Hashed features of one lower-cased word."""
    shift = 64 - FEATURE_BITS
    return (xxhash.xxh3_64_intdigest(word) >> shift, *(xxhash.xxh3_64_intdigest(f"^{n}:{word[:n]}") >> shift for n in PREFIXES if len(word) >= n))


_features = WordCache(features_of, most=60_000)


def document_features(text: str | None) -> set[int]:
    """The distinct features of a whole text."""
    return {f for w in set(_WORD.findall((text or "").lower())) for f in _features[w]}


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


# --- learning ---------------------------------------------------------------


def nnpu_risk(g: np.ndarray, is_p: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of scores ``g`` and the direction, by score, to step against.

    With sigmoid loss l(g) = 1 / (1 + exp(g)): prior * E_P[l(g)] +
    max(0, E_U[l(-g)] - prior * E_P[l(-g)]). While the second part is at
    least -BETA the direction is the gradient of the whole; below, GAMMA
    times the negative gradient of that part.
    """
    s = 1 / (1 + np.exp(-np.clip(g, -40, 40)))  # l(-g); l(g) = 1 - s
    negative = s[~is_p].mean() - prior * s[is_p].mean()
    slope, p, u = s * (1 - s), is_p.sum(), (~is_p).sum()
    d_neg = np.where(is_p, -prior * slope / p, slope / u)
    d = np.where(is_p, -prior * slope / p, 0) + d_neg if negative >= -BETA else -GAMMA * d_neg
    return float(prior * (1 - s[is_p]).mean() + max(0.0, negative)), d


def nnpu_fit(rows: list[np.ndarray], positive: np.ndarray, dims: int, prior: float, seed: int = 7) -> tuple[np.ndarray, float, list[float]]:
    """Weights, bias and risk per epoch from presence features (lists of indices) of P and U.

    Minimises ``nnpu_risk`` by Adam over mini-batches that hold P and U in
    proportion. Features were screened as signs of P, so weights stay at zero
    or above, and a proximal L1 step keeps chance features at zero.
    """
    rnd = np.random.default_rng(seed)
    lens = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows).astype(np.int64) if len(rows) and lens.sum() else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(lens)])
    p_at, u_at = np.flatnonzero(positive), np.flatnonzero(~positive)
    theta, m, v = (np.zeros(dims + 1) for _ in range(3))
    theta[dims] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)) if len(p_at) else -4.0
    risks: list[float] = []
    if not len(p_at) or not len(u_at):
        return theta[:dims], float(theta[dims]), risks
    steps, step = max(1, -(-len(rows) // BATCH)), 0
    for epoch in range(EPOCHS):
        ps, us, total = np.array_split(rnd.permutation(p_at), steps), np.array_split(rnd.permutation(u_at), steps), 0.0
        for p, u in zip(ps, us, strict=True):
            if not len(p) or not len(u):
                continue
            at = np.concatenate([p, u])
            n = lens[at]
            owner = np.repeat(np.arange(len(at)), n)
            cols = flat[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[at], n)]
            g = np.bincount(owner, theta[cols], len(at)) + theta[dims]
            risk, d = nnpu_risk(g, np.arange(len(at)) < len(p), prior)
            total += risk
            grad = np.append(np.bincount(cols, d[owner], dims), d.sum())
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            theta[:dims] = np.maximum(theta[:dims] - RATE * L1, 0)
        risks.append(total / steps)
    return theta[:dims], float(theta[dims]), risks


@dataclass(frozen=True)
class Model:
    """A sparse linear model over hashed features."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self):
        """Scores of whole texts; each word's active features are looked up once per worker."""
        known = dict(zip(self.ids.tolist(), self.weights.tolist(), strict=True))

        active = WordCache(lambda word: tuple(x for x in features_of(word) if x in known), shared=False)

        def score(text: str | None) -> float:
            on = {f for w in set(_WORD.findall((text or "").lower())) if (fs := active[w]) for f in fs}
            return float(1 / (1 + np.exp(-np.clip(self.bias + sum(known[f] for f in on), -30, 30))))

        return score


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many positive and unlabelled texts each feature occurs."""
    claim("toxic")
    seen: dict[int, list[int]] = {}
    for batch in batches:
        for text, p, u in zip(*map(values, batch.columns), strict=True):
            for f in document_features(text):
                n = seen.setdefault(f, [0, 0])
                n[0] += p
                n[1] += u
        if len(seen) > 100_000:
            yield _counts(seen)
            seen = {}
    yield _counts(seen)


def _counts(seen: dict[int, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array([c[0] for c in seen.values()], pa.int64()), pa.array([c[1] for c in seen.values()], pa.int64())], names=["f", "p", "u"])


def _active(batches: Iterator[pa.RecordBatch], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    index = {f: i for i, f in enumerate(ids.tolist())}
    for batch in batches:
        found = [sorted(index[f] for f in document_features(t) if f in index) for t in values(batch.column(0))]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.list_(pa.int32()))], names=["p", "u", "active"])


def learning_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, positives: int, unlabelled: int) -> tuple[DataFrame, float]:
    """Texts of at most ``positives`` confirmed and ``unlabelled`` rows outside the held-out fold, and the class prior.

    Ids with the smallest hashes are taken, each with one text (that of the
    least hash, if it repeats), and equal texts count once. The
    unlabelled rows are drawn from all rows, confirmed ones included, so that
    they follow the mixture that the risk estimator assumes. The prior
    is the share of positives among the labelled rows outside the fold.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("y")).where(F.col("y").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    count, toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("y") == 1).cast("int")), F.lit(0))).first()
    p_ids = known.where("y = 1").orderBy(F.xxhash64("id"), "id").limit(positives).select("id", F.lit(1).alias("p"), F.lit(0).alias("u"))
    others = docs.select(F.col(id_col).cast("long").alias("id")).where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    u_ids = others.orderBy(F.xxhash64("id", F.lit("u")), "id").limit(unlabelled).select("id", F.lit(0).alias("p"), F.lit(1).alias("u"))
    ids = p_ids.unionByName(u_ids).groupBy("id").agg(F.max("p").alias("p"), F.max("u").alias("u"))
    ids = stage(ids, "toxic-sample-ids")  # bounded by the two parameters
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    one = text.join(F.broadcast(ids), "id").groupBy("id").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"), F.max("p").alias("p"), F.max("u").alias("u"))
    sample = one.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("p").alias("p"), F.max("u").alias("u"))
    return stage(sample.select("text", "p", "u"), "toxic-sample"), (toxic / count if count else 0.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Learn from a bounded sample: screen features by counts on the executors, then fit what is left in numpy."""
    sample, prior = learning_sample(docs, labels, label, id_col, text_col, positives, unlabelled)
    n_p, n_u = (sample.where(c).count() for c in ("p = 1", "u = 1"))
    counts = sample.mapInArrow(_sample_features, "f long, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.col("p") >= SUPPORT)
    share = F.lit(n_p / max(1, n_p + n_u))
    p, u, both = F.col("p"), F.col("u"), F.col("p") + F.col("u")
    ratio = 2 * (p * F.log(p / (both * share)) + u * F.log(F.greatest(u, F.lit(0.5)) / (both * (1 - share))))
    # a fixed number of features, the most telling first
    top = counts.withColumn("ratio", ratio).where((p > 2 * both * share) & (F.col("ratio") >= EVIDENCE)).orderBy(F.col("ratio").desc(), "f").limit(FEATURES).collect()
    ids = np.sort(np.array([r["f"] for r in top], np.int64))
    rows = sample.mapInArrow(lambda b: _active(b, ids), "p int, u int, active array<int>").collect()
    active = {k: sorted(r["active"] for r in rows if r[k]) for k in ("p", "u")}
    both = [np.array(r, np.int64) for r in active["p"] + active["u"]]
    weights, bias, _ = nnpu_fit(both, np.arange(len(both)) < len(active["p"]), len(ids), prior)
    on = weights != 0
    return Model(ids[on], weights[on], bias)


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    claim("toxic-score")
    score = model.scorer()
    for batch in batches:
        scores = pa.array([score(t) for t in values(batch.column(batch.num_columns - 1))], pa.float64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[*batch.schema.names[:-1], "score"])


def score_rows(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row, from the whole text alone; one narrow pass."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(lambda b: _score(b, model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _kept(batches: Iterator[pa.RecordBatch], model: Model, at: int) -> Iterator[pa.RecordBatch]:
    claim("toxic-score")
    score = model.scorer()
    for batch in batches:
        yield batch.filter(pa.array([score(t) < 0.5 for t in values(batch.column(at))], pa.bool_()))


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``model`` does not predict to be toxic; no join and no shuffle."""
    at = docs.columns.index(text_col)
    return docs.mapInArrow(lambda b: _kept(b, model, at), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the labels outside the held-out fold and score every row of ``docs``.

    Null and empty texts get the score of a text without features. Null ids
    count as held out. Without any positive label every score is low. Labels
    of ids that are not in ``docs`` are ignored, and of repeated labels the
    largest counts. Other columns are not read. An empty table gives no rows.
    """
    return score_rows(docs, fit(docs, labels, "toxic", id_col, text_col), id_col, text_col)
