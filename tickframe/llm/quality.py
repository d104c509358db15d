"""Quality classifier learned from trusted positives and unlabelled web text.

Positive-unlabelled learning: with the class prior p, the risk of a classifier is
p * (loss of positives as positive) + (loss of the unlabelled as negative - p * loss of
positives as negative). The second term estimates the risk on the unseen negatives and is kept
from going below zero (non-negative risk): where a step would fit it below, the step goes back.

A text is described by measures of its form (lengths, repeats, kinds of characters, how well it
compresses) and by hashed n-grams of its shape: letters count as one of two signs, digits as
one, everything else as itself. So the classifier does not depend on the language's words.

Fitting uses at most ``sample`` trusted positives and as many unlabelled rows, chosen by hash.
The prior is estimated from the positives and the unlabelled rows (``estimated_prior``); a caller who knows
better passes it. Labels 0 are not used.

Rules: a null text is empty; empty texts are scored like others. Without positives or
unlabelled rows every score is the prior (0.5). Where every document has a label, all texts count as
unlabelled. Of an id with several rows one text is drawn. Repeated rows are scored each.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import small_batches
from tickframe.llm.labels import rows_of_ids
from tickframe.llm.ngrams import code_points, hashed

SAMPLE = 6000
BITS, SIZES = 9, range(1, 4)
STEPS, RATE, RIDGE = 400, 0.05, 1e-3
_MARKS = [ord(c) for c in "|!%&#$*<>={}[]()_/\\+~^@"]


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """What each code point counts as; the last entry is for those from U+3000 on."""
    return np.array([97 if c.islower() else 65 if c.isupper() else 48 if c.isdigit() else 32 if c.isspace()
                     else 97 if c.isalpha() else ord(c) for c in map(chr, range(0x3000))] + [97], np.uint32)


def _shape(text: str) -> np.ndarray:
    return _kinds()[np.minimum(code_points(text), 0x3000)]


def features(text: str | None) -> np.ndarray:
    """Measures of form, then the square roots of the shares of shape n-grams."""
    text = text or ""
    n = max(1, len(text))
    words = text.split()
    w = max(1, len(words))
    count = Counter(words)
    lines = text.split("\n")
    shape = _shape(text)
    raw = text.encode()
    marked = sum(c for x, c in count.items() if not x[-1].isalnum())
    stopped = sum(c for x, c in count.items() if x[-1] in ".,;:!?")
    kinds = np.bincount(shape, minlength=128)
    forms = [
        np.log1p(len(text)), np.log1p(len(words)), len(text) / w / 10, len(count) / w,
        max(count.values(), default=0) / w, sum(map(eq, words, words[1:])) / w,
        marked / w, (marked - stopped) / w,
        np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        *(kinds[[65, 97, 48, 32]] / n), (kinds[46] + kinds[44]) / n, kinds[_MARKS].sum() / n, min(2.0, len(zlib.compress(raw, 1)) / max(1, len(raw))),
    ]
    grams = np.zeros(1 << BITS)
    for h in hashed(shape, SIZES, BITS):
        grams += np.bincount(h, minlength=1 << BITS) / max(1, len(h))
    return np.concatenate([forms, np.sqrt(grams)]).astype(np.float32)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, text: str | None) -> float:
        z = np.clip((features(text) - self.mean) / self.scale, -8, 8)
        return float(1 / (1 + np.exp(-np.clip(z @ self.weights + self.bias, -50, 50))))


def _descend(positive: np.ndarray, unlabelled: np.ndarray, prior: float, gradients, steps: int, rate: float, ridge: float) -> QualityModel:
    """A linear classifier by gradient steps; ``gradients`` gives the risk's by each row's value, from all values."""
    k = len(features(""))
    mean, scale = unlabelled.mean(axis=0), np.maximum(unlabelled.std(axis=0), 1e-4)
    p, u = (np.clip((x - mean) / scale, -8, 8).astype(np.float32) for x in (positive, unlabelled))
    w, b = np.zeros(k, np.float32), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        on_p, on_u = gradients(p @ w + b, u @ w + b)
        grad = np.append(on_u @ u + on_p @ p + ridge * w, on_u.sum() + on_p.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:k].astype(np.float32), b - float(step[k])
    return QualityModel(mean, scale, w, b, prior)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_arrays(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE,
               ridge: float = RIDGE) -> QualityModel:
    """Minimises the non-negative risk of a linear classifier under logistic loss."""
    prior = float(np.clip(prior, 0.02, 0.98))
    k = len(features(""))
    if not len(positive) or not len(unlabelled):
        return QualityModel(np.zeros(k), np.ones(k), np.zeros(k), float(np.log(prior / (1 - prior))), prior)

    def gradients(gp: np.ndarray, gu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sp, su = _sigmoid(gp), _sigmoid(gu)
        negative_risk = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        as_negative = -prior * sp / len(gp), su / len(gu)
        if negative_risk >= 0:
            return as_negative[0] + prior * (sp - 1) / len(gp), as_negative[1]
        return -as_negative[0], -as_negative[1]

    return _descend(positive, unlabelled, prior, gradients, steps, rate, ridge)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = STEPS, rate: float = RATE,
                    ridge: float = RIDGE) -> float:
    """Share of positives among the unlabelled rows, from positives and unlabelled rows alone.

    A classifier is trained to tell the two apart. Whatever its threshold, the share of unlabelled rows above it is at least
    the prior times the share of positives above it, and equals that where it keeps all negatives out. So the
    prior is the least ratio of the two shares, over thresholds that at least half the positives
    reach. Each half of the rows is judged by the classifier of the other half.
    """
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5

    def gradients(gp: np.ndarray, gu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (_sigmoid(gp) - 1) / len(gp), _sigmoid(gu) / len(gu)

    ratios = []
    for k in range(2):
        own = _descend(positive[k::2], unlabelled[k::2], 0.5, gradients, steps, rate, ridge)
        z = [np.sort(np.clip((x[1 - k:: 2] - own.mean) / own.scale, -8, 8) @ own.weights + own.bias) for x in (positive, unlabelled)]
        at = z[0][: max(1, len(z[0]) // 2)]
        above = [1 - np.searchsorted(x, at) / len(x) for x in z]
        ratios.append(float((above[1] / above[0]).min()))
    return float(np.clip(np.mean(ratios), 0.02, 0.98))


def _arrays(rows: DataFrame) -> np.ndarray:
    """Features of a bounded, stored sample's texts."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([features(t.as_py()).tobytes() for t in b.column(0)], pa.binary())],
                                             names=["x"])

    got = rows.select("text").mapInArrow(describe, "x binary").orderBy("x").collect()
    return np.stack([np.frombuffer(r["x"], np.float32) for r in got]) if got else np.zeros((0, len(features(""))), np.float32)


def unlabelled_sample(docs: DataFrame, labels: DataFrame, most: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``text`` of at most ``most`` documents without any label, the first by a hash of the id; stored.

    Where every document has a label, all count as unlabelled: their texts are drawn, their labels not read.
    """
    ids = docs.select(F.col(doc_id).alias("id")).filter("id IS NOT NULL")
    without = ids.join(labels.select(F.col(doc_id).alias("id")), "id", "left_anti")
    for some in (without, ids):
        found = rows_of_ids(docs, some.distinct().orderBy(F.xxhash64("id"), "id").limit(most), doc_id, text)
        if not found.isEmpty():
            break
    return found


def fit(labelled: DataFrame, unlabelled: DataFrame, prior: float | None = None, **options) -> QualityModel:
    """Learns from ``text, label`` rows, of which only the positives' texts are used, and ``text`` rows."""
    positive, other = _arrays(labelled.filter("label = 1")), _arrays(unlabelled)
    return fit_arrays(positive, other, estimated_prior(positive, other) if prior is None else prior, **options)


def score_column(model: QualityModel, text: Column) -> Column:
    """Score (0 to 1) of each text."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return score(text)
