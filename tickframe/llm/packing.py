"""Packing documents into windows of a fixed number of tokens, best fit decreasing.

A document's ids (with the end id) are cut into full windows and a rest. Only the pieces'
lengths and places move: they are dealt to shards of about ``per_shard`` pieces, and each
shard packs its own, longest first, into the open window with the least room that still
holds the piece. A segment tree over the remaining capacities finds that window.

Rules: a null text is empty and is one piece with the end id. Repeated rows are packed
each. Shards are dealt by hash, so neither a long document nor a repeated id fills one.
Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.llm.common import small_batches, stored
from tickframe.llm.encode import END, TOKENIZER, encoder

WINDOW, PER_SHARD = 4096, 8192
#: Words that a worker remembers: it keeps them as long as it lives, and in a pipeline later work needs the memory.
REMEMBERED = 200_000


class OpenWindows:
    """Windows by remaining capacity; a segment tree counts those below each node."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        if capacity:
            self.at[capacity].append(window)
            self._add(capacity, 1)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Takes out the window with the smallest capacity of ``size`` or more."""
        node, count = self.leaves + size, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not count[node]:
                    node += 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.at[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; pieces must come longest first."""
    open_windows, n = OpenWindows(window), 0
    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        capacity, w = open_windows.tightest(size) or (window, n)
        n += w == n
        number[i], offset[i] = w, window - capacity
        open_windows.put(capacity - size, w)
    return number, offset


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end: int = END,
           window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, nth[, ids]``: full windows and the rest of each row.

    ``nth`` numbers a task's pieces; ``ids`` are little-endian unsigned 32-bit integers.
    """
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = ["start", "length", "ids_crc32", "doc_tokens", "nth"]
    schema = T.StructType([whole.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in names),
                           *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail, nth = encoder(tokenizer, REMEMBERED), end.to_bytes(4, "little"), 0
        for b in small_batches(batches, "text"):
            rows, out, held = [], [], []
            for row, found in enumerate(enc.all_ids(b.column(1))):
                found += tail
                n = len(found) // 4
                for start in range(0, n, window):
                    piece = found[4 * start: 4 * (start + window)]
                    rows.append(row)
                    out.append((start, len(piece) // 4, zlib.crc32(piece), n, nth))
                    nth += 1
                    if with_ids:
                        held.append(piece)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in zip(*out)),
                 *([pa.array(held, pa.binary())] if with_ids else [])], names=schema.names)

    return whole.mapInArrow(cut, schema)


def pack(cut: DataFrame, window: int = WINDOW, per_shard: int = PER_SHARD) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored pieces (all columns but ``ids`` are kept)."""
    shards = max(1, -(-cut.count() // per_shard))
    narrow = cut.drop("ids").withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "nth"), F.lit(shards)))
    schema = T.StructType([*narrow.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])

    def packed(rows: pa.Table) -> pa.Table:
        length = rows.column("length").to_numpy()
        order = np.lexsort((rows.column("nth").to_numpy(), rows.column("start").to_numpy(), -length))
        rows = rows.take(pa.array(order))
        number, offset = best_fit_decreasing(length[order], window)
        shard = rows.column("shard")[0].as_py()
        return rows.append_column("sequence_id", pa.array((shard << 32) + number)).append_column("offset", pa.array(offset))

    return narrow.groupBy("shard").applyInArrow(packed, schema).drop("shard")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER,
                   end: int = END, window: int = WINDOW, per_shard: int = PER_SHARD) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` for each piece."""
    cut = stored(pieces(docs, doc_id, text, tokenizer, end, window), "pieces")
    return pack(cut, window, per_shard).drop("nth")


def sequences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER,
              end: int = END, window: int = WINDOW, per_shard: int = PER_SHARD) -> DataFrame:
    """The windows themselves: ``sequence_id, n_tokens, ids`` (unpadded, little-endian unsigned 32-bit)."""
    cut = stored(pieces(docs, doc_id, text, tokenizer, end, window, with_ids=True)
                 .withColumn("piece", F.monotonically_increasing_id()), "pieces")
    placed = pack(cut, window, per_shard).select("piece", "sequence_id", "offset", "length")
    parts = cut.select("piece", "ids").join(placed, "piece").groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return parts.select("sequence_id", "n_tokens", joined.alias("ids"))
