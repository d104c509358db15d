"""Stretches of a text that repeat with a period, found word by word.

Online sparse diagonal DP: a cell (i, d) says for how many words up to word i the words have
been the same as those d places before. Only cells on diagonals (lags) that match now are held.
For each word its earlier occurrences add one to the lengths of their lags; a lag that is not
matched again ends, and if it was long enough its run is emitted at once.

Two things keep the cells few, both without losing a run:

* The lags are gone through by octaves. A run at lag d is at least two periods long, and never shorter than ``least``, so at
  least g words in a row match, where g is the octave's least lag (``least / 2`` for the first). A
  word's earlier occurrence counts only where the g words from there on agree too, and only within the octave.
  Texts in which no such group of words occurs twice have no runs, and are left after one look.
* Where a group lies inside a stretch of a period q of at most g / 2, found before, all its occurrences in
  that stretch are multiples of q away. These lags start and end where lag q does, so q is their smallest
  period; only occurrences before the stretch count.

So a group that counts several times lies in another stretch of the same period: the time grows
with the length of the text times its logarithm, and beyond that with the pairs of equal stretches only.

Runs of one stretch with several periods have the same start and end, of which the smallest period is kept.

Rules: a null text is an empty one and has no words and no runs. Words are separated by the
ASCII white space characters. Rows are handled one by one: repeated rows and null ids give a row
each; other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.llm.common import BLANKS, small_batches, texts_as_bytes

LEAST = 12
Run = tuple[int, int, int]


def _repeats(ids: np.ndarray, size: int) -> bool:
    """Whether a group of ``size`` words occurs (by its hash) more than once."""
    n = len(ids) - size + 1
    if n < 2:
        return False
    h = np.zeros(n, np.uint64)
    words = ids.astype(np.uint64)
    for k in range(size):
        h = (h ^ words[k: k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def _joined(a: np.ndarray, b: np.ndarray, offset: int) -> np.ndarray:
    """Numbers of the groups made of a group of ``a`` and one of ``b`` that starts ``offset`` words later."""
    n = min(len(a), len(b) - offset)
    if n <= 0:
        return a[:0]
    return np.unique(a[:n] * (int(b.max()) + 1) + b[offset: offset + n], return_inverse=True)[1].astype(np.int64)


def _groups(ids: np.ndarray, size: int) -> np.ndarray:
    """For each place the number of the group of ``size`` words that starts there."""
    if size == 1:
        return ids
    half = _groups(ids, size // 2)
    both = _joined(half, half, size // 2)
    return _joined(both, ids, size - 1) if size % 2 else both


def runs_of(words: list, least: int = LEAST) -> list[Run]:
    """``(start, length, period)`` of every run, by start, then period."""
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    size = max(1, (least + 1) // 2)
    if not _repeats(ids, size):
        return []
    word, found = ids.tolist(), {}
    groups, low = _groups(ids, size), 1
    while len(groups) > 1 and low <= len(ids) // 2:
        high = 2 * size - 1
        _octave(word, groups, size, low, high, least, found)
        groups, size, low = _joined(groups, groups, size), 2 * size, high + 1
    return sorted((start, length, period) for (start, length), period in found.items())


def _octave(word: list[int], groups: np.ndarray, size: int, low: int, high: int, least: int, found: dict[tuple[int, int], int]) -> None:
    """Adds the runs with a period of ``low`` to ``high`` to ``found``: start, length -> smallest period."""
    n = len(groups)
    place = np.arange(n)
    # The start of the stretch with a small period that a group lies in; its own occurrences there do not count.
    stretch = place.copy()
    for (start, length), period in found.items():
        if 2 * period <= size <= length:
            stretch[start: start + length - size + 1] = start
    at = np.sort(groups * n + place)
    first = np.searchsorted(at, groups * n + np.maximum(place - high, 0))
    last = np.searchsorted(at, groups * n + np.minimum(place - low, stretch - 1), side="right")
    last[np.minimum(place - low, stretch - 1) < 0] = 0
    some = np.flatnonzero(last > first)
    if not len(some):
        return
    earlier = at % n

    def end(lag: int, matched: int, upto: int) -> None:
        """The groups that start before place ``upto`` were the last that matched."""
        same = matched + size - 1
        start, stop = upto - matched - lag, upto + size - 1
        if same < lag or same + lag < least:
            return
        # A part of a stretch whose smaller period stood for this lag is no run of its own.
        if (start and word[start - 1] == word[start - 1 + lag]) or (stop < len(word) and word[stop] == word[stop - lag]):
            return
        found[start, stop - start] = min(lag, found.get((start, stop - start), lag))

    active: dict[int, int] = {}  # lag -> groups in a row that matched
    before = -1
    for i, a, b in zip(some.tolist(), first[some].tolist(), last[some].tolist()):
        if i != before + 1:
            for lag, matched in active.items():
                end(lag, matched, before + 1)
            active = {}
        before = i
        now = {i - j: active.get(i - j, 0) + 1 for j in earlier[a:b].tolist()}
        for lag, matched in active.items():
            if lag not in now:
                end(lag, matched, i)
        active = now
    for lag, matched in active.items():
        end(lag, matched, before + 1)


def without_repeats(words: list, runs: list[Run]) -> list:
    """The words that no run holds after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period: start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()] if runs else words


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (structs of start, length and period) and ``collapsed`` for each row.

    ``collapsed`` is the text's words without those that only repeat, joined by one space.
    """
    rows = docs.select(F.col(doc_id).alias(doc_id), F.col(text).alias("_text" if doc_id != "_text" else "_text_"))
    run = T.StructType([T.StructField(x, T.LongType(), False) for x in ("start", "length", "period")])
    schema = T.StructType([rows.schema[0], T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(run, False)), T.StructField("collapsed", T.StringType())])
    name = rows.columns[1]
    run_type = pa.list_(pa.struct([pa.field(x, pa.int64(), False) for x in ("start", "length", "period")]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, name):
            n, runs, kept = [], [], []
            for t in texts_as_bytes(b, name):
                words = t.split()
                of_text = runs_of(words, least)
                n.append(len(words))
                runs.append([{"start": s, "length": m, "period": q} for s, m, q in of_text])
                kept.append(b" ".join(without_repeats(words, of_text)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(runs, run_type),
                                              pa.array(kept, pa.binary()).cast(pa.string())], names=schema.names)

    return rows.mapInArrow(find, schema)


def with_planted_periods(text: Column, h: Column) -> Column:
    """The contract's test: where ``h`` is divisible by 10, words from a place on repeat with a period."""
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        whole = F.floor((n - a) / p).cast("int") + 1
        repeated = F.concat(F.slice(words, 1, a), F.flatten(F.array_repeat(F.slice(words, a + 1, p), whole)))
        return F.when(n > 0, F.array_join(F.slice(repeated, 1, n), " "))

    words = F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")
    # An array of one, so that the words are split once and not at every place that names them.
    return F.when(h % 10 == 0, F.element_at(F.transform(F.array(words), planted), 1)).otherwise(text)
