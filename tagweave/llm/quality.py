"""Quality scores by positive-unlabelled learning.

Only trusted positives and unlabelled web text are learned from. A few small networks on
statistics of the whole text minimise the non-negative unbiased risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``: what the unlabelled text
contributes as negatives is corrected by the positives it must contain. The class
prior is estimated first: a plain positives-against-unlabelled model orders the texts,
and the prior is the smallest ratio of the shares of unlabelled and positive texts
above a cut, since above a good cut nearly all unlabelled texts are positive.

Both samples are bounded (parameters); scoring covers every whole text.

Defined results: null and empty texts are scored as empty text; without positives or
unlabelled text every score is 0.5; a document with labels 0 and 1 is no positive;
labels of null or without an id are passed over; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import seeded_sample

#: Documents learned from, at most.
POSITIVES, UNLABELLED = 4000, 8000
HIDDEN, STEPS, NETWORKS, RATE, MARGIN, SEED = 12, 250, 3, 0.02, 0.03, 20240601
_WORD = re.compile(r"[^\W\d_]+")
_PIECE = 1 << 16


def features(text: str | None) -> np.ndarray:
    """Statistics of a whole text; fixed length, finite for any text."""
    text = text or ""
    tokens, lines = text.split(), text.split("\n")
    n, n_tokens, n_lines = max(1, len(text)), max(1, len(tokens)), max(1, len(lines))
    words = _WORD.findall(text)
    n_words = max(1, len(words))
    letters = sum(map(len, words))
    upper = len(re.findall(r"[A-ZÀ-Þ]", text))
    spaces = n - len(re.sub(r"\s", "", text)) if text else 0
    digits = len(re.findall(r"\d", text))
    counts = Counter(tokens)
    again = sum(1 for a, b in zip(tokens, tokens[1:]) if a == b)
    pairs = len(set(zip(tokens, tokens[1:], tokens[2:])))
    stops = sum(text.count(c) for c in ".!?")
    commas = text.count(",") + text.count(";") + text.count(":")
    raw = text.encode("utf-8", "surrogatepass")
    packed = sum(len(zlib.compress(raw[i : i + _PIECE], 1)) for i in range(0, len(raw), _PIECE))
    kept_lines = len(set(lines))
    plain = sum(1 for t in tokens if t.isalpha())
    ended = sum(1 for t in tokens if t[-1] in ".,;:!?" and t[:-1].isalpha())
    mean_word = letters / n_words
    return np.array([
        np.log1p(len(text)), np.log1p(len(tokens)), letters / n, upper / max(1, letters), spaces / n, digits / n,
        (n - letters - spaces - digits) / n, stops / n_tokens, commas / n_tokens, mean_word, len(text) / n_tokens,
        len(counts) / n_tokens, max(counts.values(), default=0) / n_tokens, again / n_tokens, pairs / max(1, len(tokens) - 2),
        packed / max(1, len(raw)), np.log1p(len(lines)), kept_lines / n_lines, np.log1p(n / n_lines), plain / n_tokens,
        (plain + ended) / n_tokens, text.count("|") / n_tokens, text.count("!") / n_tokens, float(not tokens),
    ])


N_FEATURES = 24


class PuModel:
    """Standardised features and the mean of a few networks with one hidden layer."""

    def __init__(self, mean, scale, weights=None, prior: float = 0.5):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def prepare(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        x = self.prepare(x)
        return np.mean([_sigmoid(_forward(w, x)[1]) for w in self.weights], axis=0)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _forward(w, x):
    hidden = np.tanh(x @ w[0] + w[1])
    return hidden, hidden @ w[2] + x @ w[3] + w[4]


def _train(x_p, x_u, prior, steps=STEPS, seed=SEED):
    """Minimise the non-negative risk (``prior`` given) or, with None, tell positives
    from unlabelled, by full-batch Adam."""
    rng = np.random.default_rng(seed)
    d = x_p.shape[1]
    w = [rng.standard_normal((d, HIDDEN)) / np.sqrt(d), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(d), np.zeros(())]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    x = np.vstack([x_p, x_u])
    n_p, n_u = len(x_p), len(x_u)
    for step in range(1, steps + 1):
        hidden, z = _forward(w, x)
        s = _sigmoid(z)
        g = np.zeros(len(x))  # derivative of the risk by z, with the logistic loss
        if prior is None:
            g[:n_p], g[n_p:] = (s[:n_p] - 1) / n_p, s[n_p:] / n_u
        else:
            loss = -np.log(np.maximum(1 - s, 1e-12))
            negative = loss[n_p:].mean() - prior * loss[:n_p].mean()
            if negative >= 0:
                g[:n_p] = prior * ((s[:n_p] - 1) - s[:n_p]) / n_p
                g[n_p:] = s[n_p:] / n_u
            else:  # step back out of the region where the corrected risk is below zero
                g[:n_p] = prior * s[:n_p] / n_p
                g[n_p:] = -s[n_p:] / n_u
        back = np.outer(g, w[2]) * (1 - hidden**2)
        grads = [x.T @ back, back.sum(0), hidden.T @ g, x.T @ g, g.sum()]
        for i in range(5):
            grad = grads[i] + (1e-4 * w[i] if i in (0, 2, 3) else 0)
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad**2
            w[i] = w[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return w


def estimate_prior(s_p: np.ndarray, s_u: np.ndarray) -> float:
    """Share of positives among the unlabelled: the smallest ratio of the shares above
    a cut, over cuts that leave 50 to 99.5 of 100 positives above. That ratio is an upper
    bound, and too high a prior excuses true negatives while a low one does little
    harm, so MARGIN is taken off."""
    cuts = np.quantile(s_p, np.r_[0.005, np.linspace(0.01, 0.5, 50)])
    ratios = [(s_u >= c).mean() / max((s_p >= c).mean(), 1e-9) for c in cuts]
    return float(np.clip(min(ratios) - MARGIN, 0.05, 0.95))


def fit(x_p: np.ndarray, x_u: np.ndarray) -> PuModel:
    """The model for features of trusted positives and of unlabelled texts."""
    if not len(x_p) or not len(x_u):
        return PuModel(np.zeros(N_FEATURES), np.ones(N_FEATURES))
    model = PuModel(x_u.mean(0), x_u.std(0) + 1e-6)
    p, u = model.prepare(x_p), model.prepare(x_u)
    # Each half is ordered by a model that has not seen it, or the unlabelled copies of the
    # positives would not look like positives.
    s_p, s_u = np.zeros(len(p)), np.zeros(len(u))
    shuffle_p, shuffle_u = (np.random.default_rng(SEED).permutation(len(z)) for z in (p, u))
    for half in (0, 1):
        seen_p, seen_u, other_p, other_u = shuffle_p[half::2], shuffle_u[half::2], shuffle_p[1 - half :: 2], shuffle_u[1 - half :: 2]
        if len(seen_p) and len(seen_u):
            first = _train(p[seen_p], u[seen_u], None)
            s_p[other_p], s_u[other_u] = _forward(first, p[other_p])[1], _forward(first, u[other_u])[1]
    model.prior = estimate_prior(s_p, s_u)
    model.weights = [_train(p, u, model.prior, seed=SEED + i) for i in range(NETWORKS)]
    return model


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield pd.DataFrame({"x": [features(t).tolist() for t in rows["text"]]})


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, N_FEATURES)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.score(x), pa.float64())], ["doc_id", "score"])


def _learned(texts: DataFrame) -> np.ndarray:
    rows = texts.select("text").mapInPandas(_features, "x array<double>").collect()
    return np.array([r[0] for r in rows]).reshape(-1, N_FEATURES)


def learn(positives: DataFrame, unlabelled: DataFrame) -> PuModel:
    """Fit on the texts of two bounded samples."""
    x_p, x_u = _learned(positives), _learned(unlabelled)
    # Rows arrive in any order; sorted, they give the same sums on every run.
    return fit(x_p[np.lexsort(x_p.T)], x_u[np.lexsort(x_u.T)])


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, fold, n_positives: int = POSITIVES, n_unlabelled: int = UNLABELLED) -> DataFrame:
    """Learn positives from ``labels(doc_id, quality)`` and unlabelled text from ``docs``
    where ``fold`` (a function of the id column) is true; score all ``docs``:
    ``(doc_id, score)``."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    may = rows.where(F.col("doc_id").isNotNull() & fold(F.col("doc_id")))
    trusted = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality")
               .where(fold(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1"))
    # Ids first, so that only the sample's texts travel.
    trusted = seeded_sample(trusted.select("doc_id"), F.xxhash64(F.lit(SEED), "doc_id"), n_positives)
    some = seeded_sample(may.select("doc_id"), F.xxhash64(F.lit(SEED + 1), "doc_id"), n_unlabelled)
    texts = [may.join(F.broadcast(ids), "doc_id", "left_semi") for ids in (trusted, some)]
    model = spark.sparkContext.broadcast(learn(*texts))
    return rows.mapInArrow(lambda b: _score(b, model), "doc_id bigint, score double")
