"""Secrets in texts: fixed patterns, and a small character network that finds more.

Three patterns are always reported: ``assign`` (a name such as token or password given a value),
``access`` (cloud access keys) and ``hex`` (long hexadecimal runs). Beside them every candidate, a
run of characters that keys are made of which is not a plain word, is scored with its surroundings by a
convolutional network over characters and reported as ``found`` if its probability reaches the threshold of
its shape and no pattern holds any of it.

The network, in numpy: each character of the text before, of the candidate and of the text after is a sign
of its own (one hot); filters of five characters; ReLU; the largest value of each filter before, inside and
after the candidate and its mean inside; one linear layer. It is trained on labelled findings
(``labelled_findings``). A part of them, kept back, calibrates the output (a logistic curve) and gives the
threshold of each shape: among those that find at least ``recall`` of the secrets, the one with the fewest
false alarms.

Rules: a null text is empty and holds nothing. Whole texts are read and whole candidates scored, however
long. Places count code points from 0, the end is exclusive. Rows are handled one by one; null ids and
repeated rows give a row each; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.llm.common import small_batches
from tickframe.llm.labelled_findings import findings

# Fixed values of the contract: kinds in their order, patterns, least lengths.
KINDS = ["assign", "access", "hex"]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# A longest run is found or not; a shorter one could hold no match that the longest does not.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6

FOUND = "found"
_CANDIDATE = re.compile(r"[A-Za-z0-9][A-Za-z0-9+/_.-]{10,}[A-Za-z0-9]={0,2}")
_NO_WORD = re.compile(r"[0-9]|[a-z][A-Z]")

BEFORE, AFTER, WIDTH, FILTERS = 24, 8, 5, 24
LABELLED, KEPT_BACK, RECALL = 6000, 0.25, 0.98
EPOCHS, BATCH, RATE, RIDGE = 8, 128, 0.01, 1e-4
SHAPES = ["hex", "digits", "plain", "marked"]

#: Signs: 0 nothing, printable ASCII, blank, other letters, other characters; once for each of the three regions.
SIGNS = 99


def _signs() -> np.ndarray:
    out = np.full(0x3000, 98, np.int32)
    out[:128] = [96 if chr(i).isspace() else i - 32 + 1 if 32 < i < 127 else 98 for i in range(128)]
    out[128:] = [97 if chr(i).isalpha() else 96 if chr(i).isspace() else 98 for i in range(128, 0x3000)]
    return out


_SIGN = _signs()


def patterns_in(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the fixed patterns, by start, then kind."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    out += [(kind, *m.span()) for kind, p in (("access", _ACCESS), ("hex", _HEX)) for m in p.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates_in(text: str) -> list[tuple[int, int]]:
    """Runs of key characters that hold a digit or a capital inside a word."""
    return [m.span() for m in _CANDIDATE.finditer(text) if _NO_WORD.search(m[0])]


def shape_of(value: str) -> str:
    if value.isdigit():
        return "digits"
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return "hex"
    return "plain" if value.isalnum() else "marked"


@dataclass
class _Cells:
    """The signs of many candidates with their surroundings, one after the other, and where their regions start."""

    ids: np.ndarray
    starts: np.ndarray  # of region r of candidate i: starts[3 * i + r]


def _cells(spans: list[tuple[str, int, int]]) -> _Cells:
    """``spans`` are ``(text, start, end)``; every region gets one sign for nothing in front, so none is empty."""
    parts, sizes = [], []
    for text, start, end in spans:
        for region, piece in enumerate((text[max(0, start - BEFORE): start], text[start: end], text[end: end + AFTER])):
            cp = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")
            row = np.empty(len(cp) + 1, np.int32)
            row[0] = region * SIGNS
            row[1:] = _SIGN[np.minimum(cp, 0x2FFF)] + region * SIGNS
            parts.append(row)
            sizes.append(len(row))
    starts = np.cumsum([0, *sizes[:-1]]) if sizes else np.zeros(0, np.int64)
    return _Cells(np.concatenate(parts) if parts else np.zeros(0, np.int32), starts.astype(np.int64))


@dataclass
class SecretModel:
    tables: np.ndarray  # WIDTH x (3 * SIGNS) x FILTERS
    offset: np.ndarray
    weights: np.ndarray  # 4 * FILTERS
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def hidden(self, c: _Cells) -> np.ndarray:
        """Filter values at each character."""
        half = WIDTH // 2
        padded = np.concatenate([np.zeros(half, np.int32), c.ids, np.zeros(half, np.int32)])
        h = np.repeat(self.offset[None], len(c.ids), 0)
        for k in range(WIDTH):
            h += self.tables[k, padded[k: k + len(c.ids)]]
        return np.maximum(h, 0, out=h)

    def pooled(self, c: _Cells, h: np.ndarray) -> np.ndarray:
        largest = np.maximum.reduceat(h, c.starts).reshape(-1, 3 * FILTERS)
        sums = np.add.reduceat(h, c.starts)[1::3]
        lengths = np.diff(np.append(c.starts, len(c.ids)))[1::3]
        return np.concatenate([largest, sums / lengths[:, None]], axis=1)

    def logits(self, spans: list[tuple[str, int, int]]) -> np.ndarray:
        if not spans:
            return np.zeros(0)
        c = _cells(spans)
        return self.pooled(c, self.hidden(c)) @ self.weights + self.bias

    def probabilities(self, spans: list[tuple[str, int, int]]) -> np.ndarray:
        """Calibrated; bounded pieces of work, whatever the number and length of the candidates."""
        out, part, size = [], [], 0
        for s in spans:
            part.append(s)
            size += s[2] - s[1] + BEFORE + AFTER
            if size > 100_000:
                out.append(self.logits(part))
                part, size = [], 0
        out.append(self.logits(part))
        z = np.concatenate(out) * self.slope + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def scan(self, texts: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
        """``(kind, start, end, probability)`` of each text's findings, by start, then kind."""
        fixed = [patterns_in(t or "") for t in texts]
        loose = [candidates_in(t or "") for t in texts]
        spans = [(t, a, b) for t, of_text in zip(texts, fixed) for _, a, b in of_text]
        spans += [(t, a, b) for t, of_text in zip(texts, loose) for a, b in of_text]
        p = iter(self.probabilities(spans).tolist())
        out = [[(*s, next(p)) for s in of_text] for of_text in fixed]
        for text, of_text, known in zip(texts, loose, out):
            held, at = sorted((a, b) for _, a, b, _ in known), 0
            for a, b in of_text:
                score = next(p)
                # Candidates do not overlap and come in order, so ends before this start can be left behind.
                while at < len(held) and held[at][1] <= a:
                    at += 1
                if score >= self.thresholds[shape_of(text[a:b])] and not (at < len(held) and held[at][0] < b):
                    known.append((FOUND, a, b, score))
            known.sort(key=lambda s: (s[1], [*KINDS, FOUND].index(s[0])))
        return out


def _step(model: SecretModel, c: _Cells, y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean logistic loss for tables, offset, weights and bias."""
    h = model.hidden(c)
    x = model.pooled(c, h)
    error = (1 / (1 + np.exp(-np.clip(x @ model.weights + model.bias, -50, 50))) - y) / len(y)
    lengths = np.diff(np.append(c.starts, len(c.ids)))
    region = np.repeat(np.arange(len(c.starts)), lengths)
    on_pool = error[:, None] * model.weights
    largest = x[:, : 3 * FILTERS].reshape(-1, FILTERS)
    # Where a filter is largest in its region (ties share it), plus its share of the mean inside.
    top = h == largest[region]
    shared = on_pool[:, : 3 * FILTERS].reshape(-1, FILTERS) / np.add.reduceat(top, c.starts, dtype=np.int64)
    g = np.where(top, shared[region], 0)
    inside = region % 3 == 1
    g[inside] += (on_pool[:, 3 * FILTERS:] / lengths[1::3, None])[region[inside] // 3]
    g[h <= 0] = 0
    on_tables = np.zeros_like(model.tables)
    half = WIDTH // 2
    padded = np.concatenate([np.zeros(half, np.int32), c.ids, np.zeros(half, np.int32)])
    for k in range(WIDTH):
        ids = padded[k: k + len(c.ids)]
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.diff(ids[order], prepend=-1))
        on_tables[k, ids[order][first]] = np.add.reduceat(g[order], first)
    return [on_tables, g.sum(0), error @ x, np.array([error.sum()])]


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve with the smallest loss, by Newton steps; slightly smoothed labels."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        e, w = p - target, p * (1 - p) + 1e-9
        grad = np.array([e @ z, e.sum()])
        curve = np.array([[w @ (z * z), w @ z], [w @ z, w.sum()]]) + 1e-6 * np.eye(2)
        a, b = np.array([a, b]) - np.linalg.solve(curve, grad)
    return float(a), float(b)


def _threshold(p: np.ndarray, y: np.ndarray, recall: float) -> float:
    """Among thresholds that find ``recall`` of the secrets, the middle of those with the fewest false alarms."""
    if not y.any():
        return math.inf
    ranked = np.sort(p[y == 1])
    most = ranked[int(np.floor((1 - recall) * len(ranked)))]  # a larger one would lose too many
    other = np.sort(p[y == 0])
    below = other[other < most]
    return float((most + below[-1]) / 2) if len(below) else float(most / 2)


def fit(labelled: list[tuple[str, str, str, int]] | None = None, recall: float = RECALL, epochs: int = EPOCHS, seed: int = 1) -> SecretModel:
    """Trains, calibrates and sets the thresholds on labelled findings ``(before, value, after, label)``."""
    rows = findings(LABELLED) if labelled is None else labelled
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    spans = [(b + v + a, len(b), len(b) + len(v)) for b, v, a, _ in (rows[i] for i in order)]
    y = np.array([rows[i][3] for i in order], float)
    n = len(rows) - int(KEPT_BACK * len(rows))
    model = SecretModel(rng.normal(0, 0.15, (WIDTH, 3 * SIGNS, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
                        rng.normal(0, 0.15, 4 * FILTERS), 0.0)
    params = [model.tables, model.offset, model.weights, np.zeros(1)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t = 0
    for _ in range(epochs):
        turn = rng.permutation(n)
        for at in range(0, n, BATCH):
            some = turn[at: at + BATCH]
            model.bias = float(params[3][0])
            grads = _step(model, _cells([spans[i] for i in some]), y[some])
            t += 1
            for p, g, mm, vv in zip(params, grads, m, v):
                g = g + RIDGE * p
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                p -= (RATE * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)).astype(p.dtype)
    model.bias = float(params[3][0])
    kept, of_kept = spans[n:], y[n:]
    model.slope, model.shift = _calibrated(model.logits(kept), of_kept)
    p, shapes = model.probabilities(kept), np.array([shape_of(t[a:b]) for t, a, b in kept])
    model.thresholds = {s: _threshold(p[shapes == s], of_kept[shapes == s], recall) for s in SHAPES}
    return model


def scan_documents(docs: DataFrame, model: SecretModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``findings`` (kind, start, end, score; by start, then kind) for each row."""
    rows = docs.select(F.col(doc_id).alias(doc_id), F.col(text).alias("_text" if doc_id != "_text" else "_text_"))
    finding = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                            T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([rows.schema[0], T.StructField("findings", T.ArrayType(finding))])
    name = rows.columns[1]
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, name):
            found = [[dict(zip(("kind", "start", "end", "score"), s)) for s in of_text] for of_text in model.scan(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, arrow)], names=schema.names)

    return rows.mapInArrow(scan, schema)
