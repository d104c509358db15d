"""Calibrated linear support vector machines, one against the rest, for all classes in the same passes.

For each class and each of ``folds`` folds a linear machine (squared hinge loss, ridge, balanced weights) is
fitted on the other folds and a logistic curve on the scores of the fold left out. All of them are
fitted at once: one pass over the rows gives the gradients of every class and fold, summed up by blocks of terms
before they reach the driver, which holds the coefficients (terms x classes x folds). A probability is the mean
over the folds of the curves' values, each fold's made to sum to one.

Rows are sparse: ``idx`` (array of term numbers), ``val`` (their weights), ``label`` (class number), ``balance`` (weight
where the row's class is asked for) and ``fold``. They are read many times, so ``packed`` rows of one fold lie together
as one value, ready to be multiplied.

Many rows are fitted in two parts: a few of them first, which gives a start, then all. Only the risk of all
rows and its gradient decide where the fit ends, as they do without a start; fewer passes over all rows are needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that are multiplied at once, and terms whose gradients travel together.
ROWS, TERMS = 512, 512
STEPS, MEMORY, ENOUGH = 40, 8, 1e-3
#: Bytes of all tasks' sums that the driver adds up by itself; more are added up by blocks in tasks first.
FEW = 32 << 20
#: The curves are fitted on scores rounded to 1/256 between -4 and 4.
BINS, SPAN = 2048, 4.0


@dataclass
class Machines:
    weights: np.ndarray  # (terms + 1) x (folds * classes); the last row is the constant
    slope: np.ndarray  # folds x classes
    shift: np.ndarray
    folds: int

    @property
    def classes(self) -> int:
        return self.slope.shape[1]

    def probabilities(self, x: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Of dense rows over the given terms (the constant's one included)."""
        z = (x @ self.weights[terms]).reshape(len(x), self.folds, self.classes)
        p = 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -50, 50)))
        total = p.sum(axis=2, keepdims=True)
        return np.where(total > 0, p / np.maximum(total, 1e-300), 1 / self.classes).mean(axis=1)


def dense(idx: np.ndarray, val: np.ndarray, starts: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse rows (``starts`` has one entry more than rows) over the terms they have, and those terms with the constant."""
    rows = len(starts) - 1
    terms, place = np.unique(idx[starts[0]: starts[-1]], return_inverse=True)
    x = np.zeros((rows, len(terms) + 1), np.float32)
    x[np.repeat(np.arange(rows), np.diff(starts)), place] = val[starts[0]: starts[-1]]
    x[:, -1] = 1
    return x, np.append(terms, n_terms)


def packed(idx: np.ndarray, val: np.ndarray, starts: np.ndarray, label: np.ndarray, balance: np.ndarray, fold: np.ndarray) -> Iterator[bytes]:
    """Rows of one fold each, at most ``ROWS`` of them, as bytes; rows of no fold are learnt from in every one."""
    lengths = np.diff(starts)
    for f in np.unique(fold):
        mine = np.flatnonzero(fold == f)
        for at in range(0, len(mine), ROWS):
            own = mine[at: at + ROWS]
            n = lengths[own]
            ends = np.cumsum(n)
            cells = np.repeat(starts[own] - ends + n, n) + np.arange(n.sum())
            terms, place = np.unique(idx[cells], return_inverse=True)
            yield b"".join(x.tobytes() for x in (
                np.array([f, len(own), len(terms), len(cells)], np.int64), balance[own].astype(np.float64), label[own].astype(np.int32),
                n.astype(np.int32), terms.astype(np.int32), place.astype(np.int32), val[cells].astype(np.float32)))


def _slabs(batches: Iterator[pa.RecordBatch], n_terms: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Dense rows, their terms, labels, balances and fold of each packed block."""
    for b in batches:
        for block in _blocks(b):
            fold, rows, n, cells = np.frombuffer(block, np.int64, 4).tolist()
            balance, at, parts = np.frombuffer(block, np.float64, rows, 32), 32 + 8 * rows, []
            for size, kind in ((rows, np.int32), (rows, np.int32), (n, np.int32), (cells, np.int32), (cells, np.float32)):
                parts.append(np.frombuffer(block, kind, size, at))
                at += 4 * size
            label, lengths, terms, place, val = parts
            x = np.zeros((rows, n + 1), np.float32)
            x[np.repeat(np.arange(rows), lengths), place] = val
            x[:, -1] = 1
            yield x, np.append(terms, n_terms), label, balance, fold


def _blocks(b: pa.RecordBatch) -> Iterator[bytes]:
    if "block" in b.schema.names:
        yield from (x.as_buffer() for x in b.column("block"))
        return
    lists, label, balance, fold = b.column("idx"), *(b.column(c).to_numpy() for c in ("label", "balance", "fold"))
    starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    yield from packed(lists.flatten().to_numpy(), b.column("val").flatten().to_numpy(), starts, label, balance, fold)


def _summed(rows: DataFrame, mapper, size: int, tasks: int) -> np.ndarray:
    """Sum over the tasks of the arrays that ``mapper`` makes of their rows, by blocks that are summed up apart."""
    block = TERMS * 64 if tasks * size * 8 > FEW else size

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = mapper(batches)
        for n in range(0, size, block):
            part = own[n: n + block]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([n // block], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["block", "part"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column("part"):
                part = np.frombuffer(x.as_buffer(), np.float64)
                total = part.copy() if total is None else total + part
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["block", "part"])

    schema = "block long, part binary"
    out = np.zeros(size)
    parts = rows.mapInArrow(emit, schema)
    for r in (parts if block == size else parts.groupBy("block").applyInArrow(add, schema)).collect():
        part = np.frombuffer(r["part"], np.float64)
        out[r["block"] * block: r["block"] * block + len(part)] += part
    return out


def _risk(rows: DataFrame, w: np.ndarray, n_terms: int, classes: int, folds: int, n: int, tasks: int) -> tuple[float, np.ndarray]:
    """Sum of all machines' risks, and its gradient."""
    held = rows.sparkSession.sparkContext.broadcast(w.astype(np.float32))

    def gradient(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        weights, out = held.value.reshape(n_terms + 1, folds, classes), np.zeros((n_terms + 1) * folds * classes + 1)
        grad = out[:-1].reshape(n_terms + 1, folds, classes)
        for x, terms, label, balance, fold in _slabs(batches, n_terms):
            at = (terms[:, None], np.flatnonzero(np.arange(folds) != fold))  # the machines that learn from this fold
            # Nearly all machines ask for another class: all are taken so, and each row's own class is put right.
            z = (x @ weights[at].reshape(len(terms), -1)).reshape(len(x), -1, classes).astype(np.float64)
            row = np.arange(len(x))
            own = np.maximum(0, 1 - z[row, :, label])
            short = np.maximum(0, 1 + z, out=z)
            short[row, :, label] = 0
            out[-1] += float(np.vdot(short, short) + (balance[:, None] * own * own).sum())
            short *= 2
            short[row, :, label] = -2 * balance[:, None] * own
            grad[at] += (x.T.astype(np.float64) @ short.reshape(len(x), -1)).reshape(len(terms), -1, classes)
        return out

    total = _summed(rows, gradient, w.size + 1, tasks) / n
    held.unpersist()
    ridge = 1.0 / n  # as with a penalty of one for each row's loss
    return total[-1] + 0.5 * ridge * float((w * w).sum()), total[:-1].reshape(w.shape) + ridge * w


Pairs = list[tuple[np.ndarray, np.ndarray, float]]


def _minimised(risk, w: np.ndarray, steps: int, pairs: Pairs | None = None) -> tuple[np.ndarray, Pairs]:
    """Quasi-Newton steps with limited memory, until the gradient is a small part of what it is at zero.

    ``w`` and ``pairs`` may come from an earlier fit; they make a start and nothing else.
    """
    value, grad = risk(w)
    first = max(float(np.abs(grad if not w.any() else risk(np.zeros_like(w))[1]).max()), 1e-12)
    pairs = pairs or []
    for _ in range(steps):
        if np.abs(grad).max() < ENOUGH * first:
            break
        way, alphas = -grad, []
        for s, y, rho in reversed(pairs):
            alphas.append(rho * float((s * way).sum()))
            way = way - alphas[-1] * y
        if pairs:
            s, y, rho = pairs[-1]
            way = way / (rho * float((y * y).sum()))
        for (s, y, rho), a in zip(pairs, reversed(alphas)):
            way = way + (a - rho * float((y * way).sum())) * s
        slope, size = float((grad * way).sum()), 1.0 if pairs else min(1.0, 1.0 / first)
        for _ in range(20):
            new_value, new_grad = risk(w + size * way)
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = size * way, new_grad - grad
        if (sy := float((s * y).sum())) > 1e-14:
            pairs = [*pairs, (s, y, 1 / sy)][-MEMORY:]
        w, value, grad = w + s, new_value, new_grad
    return w, pairs


def _curves(rows: DataFrame, w: np.ndarray, n_terms: int, classes: int, folds: int, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Slope and shift of the logistic curve of each fold and class, from the scores of the fold left out."""
    held = rows.sparkSession.sparkContext.broadcast(w.astype(np.float32))

    def histogram(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        weights, out = held.value.reshape(n_terms + 1, folds, classes), np.zeros(folds * classes * 2 * BINS)
        for x, terms, label, _, fold in _slabs(batches, n_terms):
            z = x @ weights[terms, fold]
            bins = np.clip(np.round((z + SPAN) * BINS / (2 * SPAN)), 0, BINS - 1).astype(np.int64)
            own = np.arange(classes) == label[:, None]
            np.add.at(out, (((fold * classes + np.arange(classes)) * 2 + own) * BINS + bins).ravel(), 1)
        return out

    counts = _summed(rows, histogram, folds * classes * 2 * BINS, tasks).reshape(folds * classes, 2, BINS)
    held.unpersist()
    z = np.arange(BINS) * 2 * SPAN / BINS - SPAN
    curves = np.array([_curve(z, no, yes) for no, yes in counts])
    return curves[:, 0].reshape(folds, classes), curves[:, 1].reshape(folds, classes)


def _curve(z: np.ndarray, no: np.ndarray, yes: np.ndarray) -> tuple[float, float]:
    """The logistic curve with the least loss; labels are drawn in by one row of the other kind, so it is finite."""
    n0, n1 = no.sum(), yes.sum()
    n, target = no + yes, no / (n0 + 2) + yes * (n1 + 1) / (n1 + 2)
    loss = lambda a, b: float((n * np.logaddexp(0, a * z + b) - target * (a * z + b)).sum())
    a, b = 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        e, c = n * p - target, n * p * (1 - p) + 1e-12
        curve = np.array([[(c * z * z).sum(), (c * z).sum()], [(c * z).sum(), c.sum()]]) + 1e-9 * np.eye(2)
        da, db = np.linalg.solve(curve, [(e * z).sum(), e.sum()])
        size, now = 1.0, loss(a, b)
        while size > 1e-6 and loss(a - size * da, b - size * db) > now + 1e-12:
            size /= 2
        a, b = a - size * da, b - size * db
        if abs(da) + abs(db) < 1e-7:
            break
    return float(a), float(b)


def fit(rows: DataFrame, n_terms: int, classes: int, n: int, folds: int = 3, steps: int = STEPS,
        early: DataFrame | None = None, n_early: int = 0) -> Machines:
    """``rows`` are stored and read once for each step; ``n`` is their number.

    ``early`` are ``n_early`` of the same rows, drawn by chance, that give a start; the fit takes up to ``steps`` from there.
    """
    w, pairs = np.zeros((n_terms + 1, folds * classes)), None
    for part, size in ((early, n_early), (rows, n)):
        if part is None or not size:
            continue
        part = part.select("block") if "block" in part.columns else part.select("idx", "val", "label", "balance", "fold")
        tasks = part.rdd.getNumPartitions()
        w, pairs = _minimised(lambda w: _risk(part, w, n_terms, classes, folds, size, tasks), w, steps, pairs)  # noqa: B023
    slope, shift = _curves(part, w, n_terms, classes, folds, tasks)
    return Machines(w, slope, shift, folds)
