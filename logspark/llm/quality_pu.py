"""Quality classifier from positive and unlabelled texts.

Trusted positives are labelled rows of good quality; the unlabelled set is web text of any kind.
With the class prior ``pi``, the risk over unlabelled text is ``pi`` times the risk over positives plus
that over negatives, so the risk of calling unseen negatives positive can be written without
negatives. That difference must not fall below zero; where a mini-batch makes it negative, the step
goes the other way (non-negative unbiased risk). The model is a small network over measures of a
text: character classes, repetition, words and lines.

The prior is estimated as the smallest ratio, over score thresholds, of the share of unlabelled
texts above it to the share of positives above it: texts of a region without negatives show it.

The model is fitted on at most ``max_positives`` and ``max_unlabelled`` rows, chosen by a hash of the
id before any text is read, and every row is then scored in one map over the texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, rows_of

MAX_POSITIVES = 8_000
MAX_UNLABELLED = 24_000
THRESHOLD = 0.7
HIDDEN = 16
EPOCHS = 40
STEPS = 1200  # at least, however few rows there are
BATCH = 512
RATE = 0.01
BETA, GAMMA = 0.0, 1.0  # of the correction: from what risk on, and how strongly

# Groups of ASCII characters whose shares are measures of their own.
GROUPS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r",
          b"\n", b".", b",", b"!?", b"*#%$&", b"|<>{}[]()\\/", b"-_=+~^`\"':;@")
FEATURES = len(GROUPS) + 13


def measures(text: str | None) -> list[float]:
    """What the model sees of a text; all zeros but one for a null or empty text."""
    raw = (text or "").encode()
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    out = [float(counts[np.frombuffer(g, np.uint8)].sum()) / n for g in GROUPS]
    out.append(float(counts[128:].sum()) / n)
    words = raw.split()
    k = max(1, len(words))
    seen = Counter(words)
    lines = [line for line in raw.split(b"\n") if line]
    distinct = len(seen) / k
    out += [
        len(words) == 0,
        np.log1p(len(raw)) / 10,
        np.log1p(len(words)) / 10,
        (n - counts[32] - counts[10]) / k / 20,
        distinct,
        np.log(max(1, len(seen))) / np.log(k + 1),
        sum(map(eq, words, words[1:])) / k,
        max(seen.values(), default=0) / k,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(len(words) / max(1, len(lines))) / 5,
        sum(w.isupper() for w in seen) / max(1, len(seen)),
        sum(not w.isalpha() and w.isascii() for w in seen) / max(1, len(seen)),
    ]
    return [float(x) for x in out]


@dataclass
class Model:
    """A network with one hidden layer over standardised measures."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    @staticmethod
    def fresh(mean: np.ndarray, scale: np.ndarray, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        n = len(mean)
        return Model(mean, scale, [rng.normal(0, n ** -0.5, (n, HIDDEN)), np.zeros(HIDDEN),
                                   rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)], 0.5)

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def margin(self, z: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(z @ a + b) @ c + d[0]

    def gradient(self, z: np.ndarray, outer: np.ndarray) -> list[np.ndarray]:
        """The gradient of a sum over rows whose margins weigh ``outer``."""
        a, b, c, _ = self.weights
        hidden = np.tanh(z @ a + b)
        inner = outer[:, None] * c * (1 - hidden ** 2)
        return [z.T @ inner, inner.sum(0), hidden.T @ outer, outer.sum(keepdims=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.inputs(x)), -30, 30)))


def _loss(margin: np.ndarray) -> np.ndarray:
    """Logistic loss of calling a margin positive."""
    return np.logaddexp(0, -margin)


def _slope(margin: np.ndarray) -> np.ndarray:
    return -1 / (1 + np.exp(np.clip(margin, -30, 30)))


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7,
        epochs: int = EPOCHS) -> Model:
    """Minimise the non-negative risk by Adam over mini-batches of both sets."""
    rng = np.random.default_rng(seed)
    scale = unlabelled.std(0)
    model = Model.fresh(unlabelled.mean(0), np.where(scale > 1e-9, scale, 1.0), seed)
    model.prior = prior
    p, u = model.inputs(positives), model.inputs(unlabelled)
    first = [np.zeros_like(w) for w in model.weights]
    second = [np.zeros_like(w) for w in model.weights]
    step = 0
    for _ in range(max(epochs, -(-STEPS // -(-len(u) // BATCH)))):
        order = rng.permutation(len(u))
        for start in range(0, len(u), BATCH):
            zu = u[order[start:start + BATCH]]
            zp = p[rng.integers(0, len(p), min(len(p), BATCH))]
            gp, gu = model.margin(zp), model.margin(zu)
            negative = _loss(-gu).mean() - prior * _loss(-gp).mean()
            on_negative = [a - prior * b for a, b in zip(
                model.gradient(zu, -_slope(-gu) / len(zu)), model.gradient(zp, -_slope(-gp) / len(zp)))]
            if negative >= -BETA:
                on_positive = model.gradient(zp, prior * _slope(gp) / len(zp))
                grads = [a + b for a, b in zip(on_positive, on_negative)]
            else:
                grads = [-GAMMA * g for g in on_negative]
            step += 1
            for i, g in enumerate(grads):
                g = g + 1e-4 * model.weights[i]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g ** 2
                model.weights[i] = model.weights[i] - RATE * (first[i] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    return model


def estimate_prior(positives: np.ndarray, unlabelled: np.ndarray) -> float:
    """The smallest ratio of upper shares of scores, with room for chance at few positives."""
    cuts = np.quantile(positives, np.linspace(0, 0.9, 91))
    above_p = np.array([(positives >= c).mean() for c in cuts])
    above_u = np.array([(unlabelled >= c).mean() for c in cuts])
    room = np.sqrt(1 / (4 * len(positives))) + np.sqrt(1 / (4 * len(unlabelled)))
    best = np.argmin((above_u + room) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.98))


def train(positives: np.ndarray, unlabelled: np.ndarray) -> Model:
    """Fit with an even prior, estimate the prior from rows not fitted on, and fit again."""
    if len(positives) < 10 or len(unlabelled) < 10:
        return fit(positives, unlabelled, 0.5)
    first = fit(positives[::2], unlabelled[::2], 0.5, epochs=EPOCHS // 2)
    prior = estimate_prior(first.score(positives[1::2]), first.score(unlabelled[1::2]))
    return fit(positives, unlabelled, prior)


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, ids: DataFrame, n: int) -> np.ndarray:
    """The measures of at most ``n`` rows' texts, the rows chosen by a hash of ``ids``."""
    chosen = ids.select("doc_id", F.xxhash64("doc_id", F.lit(11)).alias("h")).dropDuplicates()
    chosen = chosen.orderBy("h", "doc_id").limit(n).select("doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            yield pa.RecordBatch.from_arrays([
                pa.array([doc for doc, _ in rows], pa.int64()),
                pa.array([measures(text) for _, text in rows], pa.list_(pa.float64())),
            ], names=["doc_id", "x"])

    # at most n ids, so the broadcast is bounded by the parameter
    own = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", "text")
    rows = own.mapInArrow(work, "doc_id long, x array<double>").orderBy("doc_id", "x").limit(n)
    return np.array([r[1] for r in rows.collect()], float).reshape(-1, FEATURES)


def learn(docs: DataFrame, labels: DataFrame, max_positives: int = MAX_POSITIVES,
          max_unlabelled: int = MAX_UNLABELLED) -> Model | None:
    """The model of these texts and labels; None where there is no positive to learn from.

    Only labels of rows outside :func:`held_out` are read, and of them only the positives; an id
    labelled both ways is no positive, and null ids have no label.
    """
    docs = documents(docs).where(~held_out())
    good = (labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                          F.col("quality").cast("int").alias("quality"))
            .where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
            .groupBy("doc_id").agg(F.min("quality").alias("quality"))
            .where("quality = 1").select("doc_id"))
    ids = docs.select("doc_id")
    positives = sample(docs, ids.join(good, "doc_id", "left_semi"), max_positives)
    unlabelled = sample(docs, ids, max_unlabelled)
    return train(positives, unlabelled) if len(positives) and len(unlabelled) else None


def _score(model: Model | None, texts: list[str | None]) -> np.ndarray:
    if model is None:
        return np.ones(len(texts))
    return model.score(np.array([measures(t) for t in texts], float).reshape(-1, FEATURES))


def scores(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """Each row's score, and whether it is taken for good.

    Null ids are not held out. Null and empty texts are scored like others, very long ones whole.
    Repeated rows are scored alike; extra columns are ignored. Without any positive nothing can be
    learnt: the score is 1.0 and all rows are kept.
    """
    model = learn(docs, labels, **bounds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            score = _score(model, [text for _, text in rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc for doc, _ in rows], pa.int64()), pa.array(score, pa.float64())],
                names=["doc_id", "score"])

    scored = documents(docs).mapInArrow(work, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is taken for good."""
    model = learn(docs, labels, **bounds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for rows in rows_of([batch.select(["text"])]):  # few texts at a time as Python objects
                score = _score(model, [text for text, in rows])
                yield batch.slice(at, len(rows)).filter(pa.array(score >= THRESHOLD))
                at += len(rows)

    return docs.mapInArrow(work, docs.schema)
