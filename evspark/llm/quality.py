"""Quality classification by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives and unlabelled text train a small network: with class prior p, the risk is p times the positives'
loss as positive plus the larger of 0 and (the unlabelled loss as negative less p times the positives' loss as
negative). The prior is estimated first, by a classifier of positives against unlabelled text whose mean output on the
unlabelled is divided by that on the positives. Labels of 0 train nothing; those of the learning folds only place the
score of 0.7 between the classes.

Features cover the whole text: frequencies of bytes, of pairs of character classes, and of repeated words and lines.
Training takes a bounded sample of rows (``sample_docs`` in expectation).

Edge cases: null texts count as empty and are scored too; rows of ``labels`` with null ids or labels are ignored; with
no positive the score is 0.5 throughout; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Emitter, arrow_schema, bound_batches, crc_mod, text_rows

SAMPLE_DOCS = 8000
THRESHOLD = 0.7
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 4, 2


def _byte_classes() -> np.ndarray:
    """Class of each byte: lower, upper, digit, space, line end, sentence mark, other mark, beyond ASCII."""
    classes = np.full(256, 6, np.uint8)
    for c in range(256):
        if 97 <= c <= 122:
            classes[c] = 0
        elif 65 <= c <= 90:
            classes[c] = 1
        elif 48 <= c <= 57:
            classes[c] = 2
        elif c in b" \t":
            classes[c] = 3
        elif c in b"\r\n":
            classes[c] = 4
        elif c in b".,;:?'\"-()":
            classes[c] = 5
        elif c >= 128:
            classes[c] = 7
    return classes


CLASSES = _byte_classes()


def features(text: str | None) -> np.ndarray:
    """Features of a whole text."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    n = max(1, len(data))
    frequencies = np.sqrt(np.bincount(data, minlength=256) / n)
    kinds = CLASSES[data]
    pairs = np.bincount(kinds[:-1] * 8 + kinds[1:], minlength=64) / n if len(data) > 1 else np.zeros(64)
    words = (text or "").split()
    lines = (text or "").split("\n")
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    shape = [
        np.log1p(len(data)),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        len(data) / n_words / 10,
        len(words) / n_lines / 50,
        len(set(words)) / n_words,
        len(set(lines)) / n_lines,
        max(map(len, words), default=0) / 30,
        len(set(words)) / np.sqrt(n_words) / 5,
    ]
    return np.concatenate([frequencies, np.sqrt(pairs), shape]).astype(np.float32)


N_FEATURES = len(features(""))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    prior: float
    cut: float = 0.0
    scale: float = 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.tanh(z @ self.hidden + self.hidden_bias) @ self.out + self.out_bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid((self.raw(x) - self.cut) * self.scale + np.log(THRESHOLD / (1 - THRESHOLD)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 300) -> float:
    """Share of positives among the unlabelled, by the scaled output of a positive-against-unlabelled classifier."""
    x = np.vstack([positive, unlabelled])
    s = np.r_[np.ones(len(positive)), np.zeros(len(unlabelled))]
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        gap = sigmoid(x @ w + b) - s
        w -= 0.1 * (x.T @ gap / len(x) + 1e-3 * w)
        b -= 0.1 * gap.mean()
    return float(np.clip(sigmoid(unlabelled @ w + b).mean() / sigmoid(positive @ w + b).mean(), 0.05, 0.95))


def fit(positive: np.ndarray, unlabelled: np.ndarray, width: int = 16, steps: int = 1500, batch: int = 256, rate: float = 0.005, seed: int = 11) -> QualityModel:
    """Minimises the non-negative risk with the sigmoid loss."""
    rng = np.random.default_rng(seed)
    pooled = np.vstack([positive, unlabelled])
    mean, spread = pooled.mean(0), pooled.std(0) + 1e-3
    p, u = (np.clip((part - mean) / spread, -6, 6) for part in (positive, unlabelled))
    prior = estimate_prior(p, u)
    d = p.shape[1]
    params = [rng.normal(0, 1 / np.sqrt(d), (d, width)), np.zeros(width), rng.normal(0, 0.3, width), np.zeros(1)]
    first, second = [np.zeros_like(v) for v in params], [np.zeros_like(v) for v in params]
    for step in range(1, steps + 1):
        xp, xu = p[rng.integers(len(p), size=batch)], u[rng.integers(len(u), size=batch)]
        hp, hu = np.tanh(xp @ params[0] + params[1]), np.tanh(xu @ params[0] + params[1])
        fp, fu = hp @ params[2] + params[3], hu @ params[2] + params[3]
        sp, su = sigmoid(fp), sigmoid(fu)  # loss as negative; the loss as positive is one less it
        negative = su.mean() - prior * sp.mean()
        dp, du = sp * (1 - sp) / batch, su * (1 - su) / batch
        if negative >= 0:
            gp, gu = -prior * dp - prior * dp, du
        else:  # step back from the negative part alone
            gp, gu = prior * dp, -du
        grads = []
        h, g, x = np.vstack([hp, hu]), np.r_[gp, gu], np.vstack([xp, xu])
        inner = g[:, None] * params[2] * (1 - h * h)
        grads = [x.T @ inner + 1e-4 * params[0], inner.sum(0), h.T @ g + 1e-4 * params[2], np.array([g.sum()])]
        for k, grad in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad * grad
            params[k] = params[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return QualityModel(mean, spread, params[0], params[1], params[2], float(params[3][0]), prior)


def place_threshold(model: QualityModel, positive: np.ndarray, negative: np.ndarray) -> QualityModel:
    """Moves the score of 0.7 to the cut with the best mean of the two classes' recalls on learning rows."""
    good = np.sort(model.raw(positive))
    if not len(negative):
        model.cut = float(np.quantile(good, 0.02)) if len(good) else 0.0
        return model
    bad = np.sort(model.raw(negative))
    edges = np.unique(np.r_[good, bad])
    cuts = (edges[1:] + edges[:-1]) / 2 if len(edges) > 1 else edges
    recall = 1 - np.searchsorted(good, cuts) / len(good) + np.searchsorted(bad, cuts) / len(bad)
    best = cuts[recall >= recall.max() - 1e-12]
    model.cut = float(best[len(best) // 2])
    model.scale = float(4 / max(1e-3, np.median(good) - np.median(bad)))
    return model


def learnable(id_col: str = "doc_id") -> Column:
    return crc_mod(id_col, HELD_OUT_MODULUS) != HELD_OUT_REMAINDER


def fit_quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> QualityModel | None:
    """Fits on a hash sample of the documents as unlabelled text, and one of the labels; only labels of learning folds are looked at.

    At most about ``sample_docs`` documents and as many labelled ones are taken. Of several labels of one id the least counts.
    """

    def picked(share: float, what: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(what), F.col(id_col).cast("long")), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))

    known = labels.filter(learnable(id_col) & F.col("quality").isNotNull() & F.col(id_col).isNotNull())
    known = known.filter(picked(sample_docs / max(1, known.count()), "labels")).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id")).limit(2 * sample_docs)
    rows = docs.withColumn("_sampled", picked(sample_docs / max(1, docs.count()), "quality")).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), "_sampled")
    rows = rows.join(F.broadcast(known), "doc_id", "left").filter("_sampled or quality is not null")  # the labels are bounded by the sample
    sample = rows.select("doc_id", "text", "quality", "_sampled")
    ddl = f"doc_id long, x array<float>, quality {dict(known.dtypes)['quality']}, sampled boolean"
    schema = arrow_schema(ddl)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(schema)
        for batch in batches:
            for i, (doc, text) in enumerate(text_rows(batch)):
                out.add(doc, pa.array(features(text)), batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
        yield from out.rest()

    rows = bound_batches(sample).mapInArrow(kernel, ddl).limit(4 * sample_docs).toArrow()
    if not rows.num_rows:
        return None
    order = np.lexsort((rows["doc_id"].to_numpy(zero_copy_only=False),))
    x = np.stack([np.asarray(v, np.float32) for v in rows["x"].to_numpy(zero_copy_only=False)])[order]
    y = rows["quality"].to_pandas().to_numpy(dtype=float, na_value=np.nan)[order]
    unlabelled = x[rows["sampled"].to_numpy(zero_copy_only=False).astype(bool)[order]]
    positive = x[y == 1]
    if not len(positive):
        return None
    return place_threshold(fit(positive, unlabelled if len(unlabelled) else x), positive, x[y == 0])


def score_quality(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    ddl = "doc_id long, score double"
    schema = arrow_schema(ddl)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = Emitter(schema)
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                x = np.stack([features(text) for _, text in text_rows(part)])
                scores = model.score(x) if model is not None else np.full(len(x), 0.5)
                for i, score in enumerate(scores):
                    out.add(part.column(0)[i].as_py(), float(score))
            yield from out.rest()

    return bound_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(kernel, ddl)
