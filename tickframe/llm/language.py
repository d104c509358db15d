"""Language identification by the nearest of several centroids per language.

A text is the normalised TF-IDF vector of its hashed letter n-grams (1 to 3 letters, with
word ends). Document frequencies count all training rows. The vectors of all of a language's different
training texts are clustered by direction, in passes over the stored vectors whose sums alone reach the
driver; a text gets the language of the centroid with the largest cosine. Texts far from every
centroid are rejected: the least cosine that counts is learned from all of these texts,
by the number of letters, as short texts lie farther from any centroid.

Rules: a null text or one without a letter is ``und`` with score 0 and rejected. Training
rows need a text with a letter and a language. Without training rows every text is ``und``.
Language, source and id are not looked at when a text is scored. Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm.common import few_files, small_batches, stored
from tickframe.llm.ngrams import hashed, lower_letters

BITS, SIZES = 12, range(1, 4)
CLUSTERS, ROUNDS = 3, 8
#: Vectors that are multiplied at once.
ROWS = 512
#: Cosines are counted in so many steps of one, and within the step that holds a quantile in as many again.
STEPS = 1024
#: Vectors in a file at most, about.
PER_FILE = 5000
#: Texts are counted by so many leading bits of their hash.
PART_BITS = 10
#: Of the cosine that all but a hundredth of the training texts of a length reach.
REJECT = 0.4
UNKNOWN = "und"
#: Java's letters, and what Java does not know yet and Python may.
MAY_HAVE_LETTER = r"[\p{L}\p{Cn}]"


def counts(text: str | None) -> np.ndarray | None:
    """N-grams with at least one letter, by hash; None without letters."""
    cp = lower_letters(text or "")
    if not cp.any():
        return None
    out = np.zeros(1 << BITS, np.int64)
    for n, h in enumerate(hashed(cp, SIZES, BITS), SIZES.start):
        full = np.zeros(len(h), bool)
        for k in range(n):
            full |= cp[k: k + len(h)] > 0
        out += np.bincount(h[full], minlength=1 << BITS)
    return out


def vector(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (np.log1p(tf) * idf).astype(np.float32)
    return v / max(np.linalg.norm(v), 1e-9)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # a row each, of length 1
    of: np.ndarray  # the centroids' languages
    floor: np.ndarray  # least cosine by length_class

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine (0 to 1), whether it is near enough."""
        tf = counts(text)
        if tf is None or not len(self.of):
            return UNKNOWN, 0.0, False
        cos = self.centroids @ vector(tf, self.idf)
        best = int(np.argmax(cos))
        return (self.languages[self.of[best]], float(np.clip(cos[best], 0, 1)),
                bool(cos[best] >= self.floor[length_class(tf)]))


def length_class(tf: np.ndarray) -> int:
    return min(15, int(tf.sum()).bit_length() // 2)


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-9)


def cluster(vectors: np.ndarray, clusters: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from the vector nearest the mean and those farthest from the chosen ones.

    Of vectors held in memory; ``fit`` takes the same steps over stored ones.
    """
    chosen = [int(np.argmax(vectors @ unit(vectors.mean(axis=0))))]
    while len(chosen) < min(clusters, len(vectors)):
        chosen.append(int(np.argmin((vectors @ vectors[chosen].T).max(axis=1))))
    centres = vectors[chosen]
    for _ in range(rounds):
        of = np.argmax(vectors @ centres.T, axis=1)
        centres = unit(np.stack([vectors[of == k].mean(axis=0) if (of == k).any() else centres[k]
                                 for k in range(len(centres))]))
    return centres


def _document_frequency(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts each hash occurs, and the number of texts with a letter."""
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size + 1, np.int64)
        for b in small_batches(batches, "text"):
            for t in b.column(0):
                tf = counts(t.as_py())
                if tf is not None:
                    df[:size] += tf > 0
                    df[size] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(df)], names=["hash", "n"])

    found = rows.select("text").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n")).collect()
    df = np.zeros(size + 1, np.int64)
    for h, n in found:
        df[h] = n
    return df[:size], int(df[size])


def packed(tf: np.ndarray) -> tuple[bytes, bytes]:
    """A bit for each hash that occurs, and how often they do: a byte each, or eight where one is not enough."""
    some = tf[tf > 0]
    return np.packbits(tf > 0).tobytes(), some.astype("u1" if some.max() < 256 else "<i8").tobytes()


def unpacked(bits: list[bytes], tf: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes occur in each row, and how often, row after row."""
    mask = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1).view(bool)
    wide = np.array([len(x) for x in tf]) > mask.sum(axis=1)
    if not wide.any():
        return mask, np.frombuffer(b"".join(tf), np.uint8)
    return mask, np.concatenate([np.frombuffer(x, "<i8" if w else "u1").astype(np.int64) for x, w in zip(tf, wide)])


def _vectors(rows: DataFrame, languages: list[str], n: int) -> DataFrame:
    """(own, bits, tf): for each language's different texts its number, which hashes occur (a bit each), how often."""
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()  # copies leave a task once
        for b in small_batches(batches, "text"):
            keys = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
            new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
            own = [(i, *packed(tf)) for i in new if (tf := counts(b.column(0)[i].as_py())) is not None]
            yield pa.RecordBatch.from_arrays([
                pa.array([number[keys[i][0]] for i, *_ in own], pa.int32()), pa.array([keys[i][1] for i, *_ in own], pa.int64()),
                pa.array([x for _, x, _ in own], pa.binary()), pa.array([x for *_, x in own], pa.binary())], names=["own", "h", "bits", "tf"])

    found = rows.select("text", "lang", "h").mapInArrow(count, "own int, h long, bits binary, tf binary")
    return stored(few_files(found.dropDuplicates(["own", "h"]).drop("h"), n, PER_FILE), "vectors")


def _slabs(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, their languages' numbers, vectors, and the vectors' lengths."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            b = batch.slice(at, ROWS)
            mask, tf = unpacked(b.column("bits").to_pylist(), b.column("tf").to_pylist())
            x = np.zeros((b.num_rows, len(idf)), np.float32)
            x[mask] = np.log1p(tf.astype(np.float32))
            x *= idf.astype(np.float32)
            yield b, b.column("own").to_numpy(), x, np.maximum(np.linalg.norm(x, axis=1), 1e-9)


def _sums(rows: DataFrame, idf: np.ndarray, groups: int, of) -> np.ndarray:
    """For each group, as ``of(own, x, length)`` tells a row's, the sum of its vectors and their number."""
    size = len(idf)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((groups, size + 1))
        for _, own, x, length in _slabs(batches, idf):
            member = (np.arange(groups)[:, None] == of(own, x, length)).astype(np.float32)
            out[:, :size] += (member / length.astype(np.float32)) @ x
            out[:, size] += member.sum(axis=1)
        some = np.flatnonzero(out[:, size])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([out[k].tobytes() for k in some], pa.binary())], names=["k", "part"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(x.as_buffer(), np.float64) for b in batches for x in b.column("part"))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["k", "part"])

    out = np.zeros((groups, size + 1))
    for r in rows.mapInArrow(emit, "k int, part binary").groupBy("k").applyInArrow(add, "k int, part binary").collect():
        out[r["k"]] = np.frombuffer(r["part"], np.float64)
    return out


def _first(rows: DataFrame, idf: np.ndarray, score) -> dict[int, np.ndarray]:
    """Each language's vector with the largest ``score(own, x, length)``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, bytes, bytes]] = {}
        for b, own, x, length in _slabs(batches, idf):
            s = score(own, x, length)
            for k in np.unique(own).tolist():
                i = int(np.argmax(np.where(own == k, s, -np.inf)))
                if k not in best or s[i] > best[k][0]:
                    best[k] = float(s[i]), b.column("bits")[i].as_py(), b.column("tf")[i].as_py()
        yield pa.RecordBatch.from_arrays([
            pa.array(list(best), pa.int32()), pa.array([v[0] for v in best.values()], pa.float64()),
            pa.array([v[1] for v in best.values()], pa.binary()), pa.array([v[2] for v in best.values()], pa.binary())],
            names=["own", "score", "bits", "tf"])

    found = rows.mapInArrow(emit, "own int, score double, bits binary, tf binary").groupBy("own").agg(
        F.max(F.struct("score", "bits", "tf")).alias("best")).collect()
    out = {}
    for r in found:
        tf = np.zeros(len(idf), np.int64)
        mask, some = unpacked([bytes(r["best"]["bits"])], [bytes(r["best"]["tf"])])
        tf[mask[0]] = some
        out[r["own"]] = vector(tf, idf)
    return out


def _clustered(rows: DataFrame, idf: np.ndarray, languages: int, clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids, and their languages' numbers: ``cluster`` for all languages in the same passes."""
    sums = _sums(rows, idf, languages, lambda own, x, length: own)
    means, many = unit(sums[:, :-1]).astype(np.float32), sums[:, -1].astype(np.int64)
    chosen: list[list[np.ndarray]] = [[] for _ in range(languages)]
    for step in range(min(clusters, int(many.max(initial=0)))):
        centres = np.concatenate([np.stack(c) for c in chosen if c]) if step else means
        of = np.repeat(np.arange(languages), [len(c) for c in chosen]) if step else np.arange(languages)

        def far(own, x, length, centres=centres, of=of, sign=-1 if step else 1):
            cos = np.where(of == own[:, None], x @ centres.T, -np.inf).max(axis=1)
            return sign * cos / length

        for k, v in _first(rows, idf, far).items():
            if step < many[k]:
                chosen[k].append(v)
    of = np.repeat(np.arange(languages), [len(c) for c in chosen])
    if not len(of):
        return np.zeros((0, len(idf)), np.float32), of
    centres = np.concatenate([np.stack(c) for c in chosen if c])
    for _ in range(ROUNDS):
        def nearest(own, x, length, centres=centres):
            return np.argmax(np.where(of == own[:, None], x @ centres.T, -np.inf), axis=1)

        sums = _sums(rows, idf, len(of), nearest)
        centres = np.where(sums[:, -1:] > 0, unit(sums[:, :-1]), centres).astype(np.float32)
    return centres, of


def _floor(rows: DataFrame, idf: np.ndarray, centroids: np.ndarray, of: np.ndarray, reject: float) -> np.ndarray:
    """Least cosine by length_class: ``reject`` of what all but a hundredth of the texts reach, to a millionth."""

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, own, x, length in _slabs(batches, idf):
            near = np.where(of == own[:, None], x @ centroids.T, -np.inf).max(axis=1) / length
            mask, tf = unpacked(b.column("bits").to_pylist(), b.column("tf").to_pylist())
            letters = np.bincount(np.nonzero(mask)[0], tf, b.num_rows).astype(np.int64)
            kind = [min(15, int(n).bit_length() // 2) for n in letters]
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(near.astype(np.float64))], names=["kind", "near"])

    near = stored(rows.mapInArrow(cosines, "kind int, near double"), "cosines")
    step = F.floor(F.col("near") * STEPS).cast("int")
    coarse = near.groupBy("kind", step.alias("step")).count().collect()
    wanted = {}  # two neighbours in the order of each length's cosines, and the share of the second
    for c in {r["kind"] for r in coarse}:
        cells = sorted((r["step"], r["count"]) for r in coarse if r["kind"] == c)
        before = np.cumsum([0, *(n for _, n in cells)])
        if before[-1] >= 20:
            at = 0.01 * (before[-1] - 1)
            low = int(at)
            cell = lambda k: int(np.searchsorted(before, k, side="right")) - 1
            wanted[c] = [(cells[cell(k)][0], k - int(before[cell(k)])) for k in (low, min(low + 1, int(before[-1]) - 1))], at - low
    floor = np.zeros(16)
    if wanted:
        held = reduce(or_, [(F.col("kind") == c) & step.isin([s for s, _ in two]) for c, (two, _) in wanted.items()])
        fine = F.floor((F.col("near") * STEPS - step) * STEPS).cast("int")
        found = near.filter(held).groupBy("kind", step.alias("step"), fine.alias("fine")).count().collect()
        for c, (two, share) in wanted.items():
            value = []
            for s, k in two:
                cells = sorted((r["fine"], r["count"]) for r in found if r["kind"] == c and r["step"] == s)
                place = int(np.searchsorted(np.cumsum([n for _, n in cells]), k, side="right"))
                value.append((s + cells[place][0] / STEPS) / STEPS)
            floor[c] = reject * (value[0] + share * (value[1] - value[0]))
    for c in range(14, -1, -1):  # a shorter text is never asked for more than a longer one
        floor[c] = min(floor[c], floor[c + 1]) if floor[c + 1] else floor[c]
    for c in range(1, 16):  # lengths that were not seen take the next shorter ones' floor
        floor[c] = floor[c] or floor[c - 1]
    return floor


def fit(train: DataFrame, text: str = "text", lang: str = "lang", sample: int | None = None, clusters: int = CLUSTERS,
        reject: float = REJECT) -> LanguageModel:
    """Learns from all rows of ``train`` that have a text and a language; copies count once.

    A caller may bound the texts that are clustered by ``sample``: of each language the same number
    of different texts, the first by a hash. Of more than ``sample`` languages the ``sample`` commonest are learned then.
    """
    rows = train.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    kinds = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    found = (kinds if sample is None else kinds.limit(sample)).collect()
    languages = sorted(r["lang"] for r in found)
    df, n = _document_frequency(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    if not languages or not n:
        return LanguageModel([], idf, np.zeros((0, 1 << BITS), np.float32), np.zeros(0, np.int64), np.zeros(16))
    taken = rows.filter(F.col("text").rlike(MAY_HAVE_LETTER)).withColumn("h", F.xxhash64("text"))
    if sample is not None:
        taken = _drawn(taken.filter(F.col("lang").isin(languages)), sample // len(languages))
    vectors = _vectors(taken, languages, n)
    centroids, of = _clustered(vectors, idf, len(languages), clusters)
    return LanguageModel(languages, idf, centroids, of, _floor(vectors, idf, centroids, of, reject) if len(of) else np.zeros(16))


def _drawn(hashed_rows: DataFrame, each: int) -> DataFrame:
    """The rows of each language's first ``each`` different texts by hash.

    Texts are counted by ranges of their hash; only the lowest ranges that hold enough are ranked, so that a
    common language sends little more than its share to one task.
    """
    texts = stored(hashed_rows.select("lang", "h").distinct().withColumn("part", F.shiftright("h", 64 - PART_BITS)), "languages")
    below = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lowest = (texts.groupBy("lang", "part").count().withColumn("before", F.coalesce(F.sum("count").over(below), F.lit(0)))
              .filter(F.col("before") < each).select("lang", "part"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = texts.join(F.broadcast(lowest), ["lang", "part"], "left_semi").withColumn("rank", rank).filter(F.col("rank") <= each)
    return hashed_rows.join(F.broadcast(chosen.select("lang", "h")), ["lang", "h"], "left_semi")


def language_column(model: LanguageModel, text: Column) -> Column:
    """``struct<lang, score, accepted>`` for each text."""

    @F.arrow_udf("lang string, score double, accepted boolean")
    def predict(texts: pa.Array) -> pa.Array:
        found = [model.predict(t.as_py()) for t in texts]
        lang, score, ok = zip(*found) if found else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())],
            names=["lang", "score", "accepted"])

    return predict(text)


def known_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The documents, all columns, that are near enough to one of the model's languages."""
    return docs.filter(language_column(model, F.col(text))["accepted"])
