"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed n-grams (3 to 6 characters) of the lower-cased letters with word ends,
present or not. Each is scaled by its log-count ratio: how much likelier a toxic training text
has it than another one. A logistic regression learns a weight for each of the ``features``
n-grams whose ratios tell most; the score of a text is the logistic function of the sum over
those it has.

Fitting uses at most ``sample`` labelled rows, chosen by a hash of their id. Scoring reads whole
texts and nothing else.

Rules: a null text is empty; empty texts score what the bias alone gives. Without training rows,
or with one label only, the score is that label's share
(0 without any). Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import small_batches
from tickframe.llm.ngrams import hashed, lower_letters

BITS, SIZES = 18, range(3, 7)
SAMPLE, FEATURES, SMOOTH = 20_000, 4000, 1.0
RIDGE, STEPS = 1.0, 200


def features(text: str | None) -> np.ndarray:
    """Hashes of the n-grams that hold two letters or more, with repeats."""
    cp = lower_letters(text or "")
    letter = np.cumsum(np.concatenate(([0], cp > 0)))
    found = [h[letter[n: n + len(h)] - letter[: len(h)] >= 2] for n, h in zip(SIZES, hashed(cp, SIZES, BITS))]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


@dataclass
class ToxicityModel:
    weights: np.ndarray  # by hash, ratio times learned weight, 0 for n-grams that are not used
    bias: float

    def score(self, text: str | None) -> float:
        f = features(text)
        used = np.unique(f[self.weights[f] != 0])
        return float(1 / (1 + np.exp(-(self.weights[used].sum(dtype=np.float64) + self.bias))))


def _counted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For label 0 and 1: in how many texts each hash occurs, and how many texts there are."""
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mark = np.zeros((2, size + 1), np.int64), np.zeros(size, bool)
        for b in small_batches(batches, "text"):
            for t, label in zip(b.column(0), b.column(1).to_pylist()):
                f = features(t.as_py())
                mark[f] = True
                n[label, :size] += mark
                mark[f] = False
                n[label, size] += 1
        some = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[0, some]), pa.array(n[1, some])],
                                         names=["hash", "clean", "toxic"])

    found = (
        rows.mapInArrow(count, "hash long, clean long, toxic long").groupBy("hash")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    )
    n = np.zeros((2, size + 1), np.int64)
    n[:, found["hash"].to_numpy(np.int64)] = found[["clean", "toxic"]].to_numpy(np.int64).T
    return n[:, :size], n[:, size]


def _present(rows: DataFrame, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels of the texts, and row and feature number of every used n-gram they have."""
    size = 1 << BITS

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(size, -1, np.int32)
        place[used] = np.arange(len(used))
        for b in small_batches(batches, "text"):
            found = []
            for t in b.column(0):
                p = place[features(t.as_py())]
                found.append(np.unique(p[p >= 0]).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.binary())], names=["label", "has"])

    got = rows.mapInArrow(pick, "label int, has binary").orderBy("has", "label").collect()
    has = [np.frombuffer(r["has"], "<i4") for r in got]
    return (np.array([r["label"] for r in got], float), np.repeat(np.arange(len(has)), [len(h) for h in has]),
            np.concatenate(has) if has else np.zeros(0, np.int32))


def _logistic(y: np.ndarray, row: np.ndarray, feature: np.ndarray, value: np.ndarray, ridge: float,
              steps: int) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on a sparse matrix, by accelerated gradient steps."""
    n, k = len(y), len(value)
    x = value[feature]
    # The largest eigenvalue of X'X / 4 bounds the curvature; a few power steps find it.
    v = np.ones(k)
    for _ in range(12):
        v = np.bincount(feature, x * np.bincount(row, x * v[feature], n)[row], k)
        length = max(np.linalg.norm(v), 1e-9)
        v /= length
    step = 1 / (1.1 * length / 4 + n / 4 + ridge)
    w, bias = np.zeros(k), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    at, at_bias, t = w, bias, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(np.bincount(row, x * at[feature], n) + at_bias))) - y
        new = at - step * (np.bincount(feature, x * error[row], k) + ridge * at)
        new_bias = at_bias - step * error.sum()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum = (t - 1) / t_next
        at, at_bias, t = new + momentum * (new - w), new_bias + momentum * (new_bias - bias), t_next
        w, bias = new, new_bias
    return w, float(bias)


def fit(rows: DataFrame, features: int = FEATURES, smooth: float = SMOOTH, ridge: float = RIDGE,
        steps: int = STEPS) -> ToxicityModel:
    """Learns from ``text, label`` rows (a stored, bounded sample)."""
    counts, texts = _counted(rows)
    if not texts.all():
        share = texts[1] / max(1, texts.sum())
        return ToxicityModel(np.zeros(1 << BITS, np.float32), 50.0 * (2 * share - 1) if texts.any() else -50.0)
    rate = (counts + smooth) / (texts[:, None] + 2 * smooth)
    ratio = np.log(rate[1] / rate[0])
    # How much an n-gram tells about the label: the likelihood ratio statistic of its counts.
    both = (counts.sum(axis=0) + 2 * smooth) / (texts.sum() + 4 * smooth)
    tells = sum(texts[c] * (rate[c] * np.log(rate[c] / both) + (1 - rate[c]) * np.log((1 - rate[c]) / (1 - both))) for c in (0, 1))
    used = np.sort(np.argsort(-tells, kind="stable")[:features])
    y, row, feature = _present(rows, used)
    w, bias = _logistic(y, row, feature, ratio[used], ridge, steps)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w * ratio[used]
    return ToxicityModel(weights, bias)


def score_column(model: ToxicityModel, text: Column) -> Column:
    """Score (0 to 1) of each text."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return score(text)
