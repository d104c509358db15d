"""Benchmark decontamination as a prefix-filtered set join.

An item's windows (``window`` consecutive words; a shorter item is one window) are sets of
shingles that a document must contain whole. Shingles are ordered by rarity, counted over
all documents. As containment must be complete, the necessary prefix of a window is its one
rarest shingle: only documents that hold it are candidates. The shingle's place in the
window and the window's length bound where the window can lie, and the words there are
compared with the windows exactly.

The benchmark is the stated query set: it is held in memory by blocks of about
``block_words`` words, each of them run against all documents, so no part of it is cut off. Rows that
repeat are held once, and a long item is dealt to blocks in parts that share a window less one word.

Rules: A-Z count as a-z; words are runs of anything but ASCII other than letters and digits.
A null text has no words and is never hit. An item without an id hits words but is not
listed; items that share an id count once. Repeated documents get a row each. Other columns
are not read. An empty benchmark hits nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.llm.common import DOCUMENTS, few_files, free_name, small_batches, stored, texts_as_bytes

WINDOW, SHINGLE, BLOCK_WORDS = 10, 2, 200_000
#: What each byte of UTF-8 becomes: a-z for letters, itself for digits and beyond ASCII, else a space.
_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def windows_of(words: list[bytes], window: int) -> Iterator[tuple[bytes, ...]]:
    size = min(window, len(words))
    return (tuple(words[i: i + size]) for i in range(len(words) - size + 1)) if words else iter(())


def shingles_of(words, size: int) -> list[tuple[bytes, ...]]:
    """All shingles in order; fewer words than a shingle are one shingle."""
    if len(words) <= size:
        return [tuple(words)] if words else []
    return list(zip(*(words[i:] for i in range(size))))


class Windows:
    """The windows of a block of items, by the shingle that a document must hold."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int, shingle: int):
        self.shingle, self.items = shingle, {}
        for item, text in items:
            for w in windows_of(words_of(text), window):
                self.items.setdefault(w, set()).update([] if item is None else [item])
        self.short = sorted({len(w) for w in self.items if len(w) < shingle})
        self.prefix: dict[tuple[bytes, ...], set[tuple[int, int]]] = {}

    def vocabulary(self) -> set[tuple[bytes, ...]]:
        return {s for w in self.items for s in shingles_of(w, self.shingle)}

    def order(self, frequency: dict[tuple[bytes, ...], int]) -> None:
        """Keeps each window's rarest shingle, with its place and the window's length."""
        for w in self.items:
            own = shingles_of(w, self.shingle)
            at = min(range(len(own)), key=lambda i: (frequency.get(own[i], 0), own[i], i))
            self.prefix.setdefault(own[at], set()).add((at, len(w)))

    def all_shingles(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        if len(words) >= self.shingle:
            yield from enumerate(zip(*(words[i:] for i in range(self.shingle))))
        for size in self.short:
            yield from enumerate(zip(*(words[i:] for i in range(size))))

    def count(self, words: list[bytes], known: set[tuple[bytes, ...]], into: Counter) -> None:
        into.update({s for _, s in self.all_shingles(words) if s in known})

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Places (start, end) of the windows in a document, in order and merged, and their items."""
        n, prefix, places, items = len(words), self.prefix, set(), set()
        for i, s in [x for x in self.all_shingles(words) if x[1] in prefix]:
            for at, size in prefix[s]:
                start = i - at
                if start >= 0 and start + size <= n and (start, start + size) not in places:
                    found = self.items.get(tuple(words[start: start + size]))
                    if found is not None:
                        places.add((start, start + size))
                        items |= found
        merged: list[list[int]] = []
        for start, end in sorted(places):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(end, merged[-1][1])
            else:
                merged.append([start, end])
        return [(s, e) for s, e in merged], items


def _parts(items: DataFrame, window: int, most: int) -> DataFrame:
    """``item, text, n_words`` with texts of at most ``most + window - 1`` words that hold all windows between them.

    Long items are cut into parts that overlap by a window less one word; rows that repeat count once.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            item, text, n = [], [], []
            for i, t in zip(b.column(0).to_pylist(), texts_as_bytes(b, "text")):
                words = words_of(t)
                for at in range(0, max(1, len(words) - window + 1), most):
                    part = words[at: at + most + window - 1]
                    item.append(i)
                    text.append(b" ".join(part))
                    n.append(len(part))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(text, pa.binary()).cast(pa.string()),
                                              pa.array(n, pa.int64())], names=["item", "text", "n_words"])

    return items.distinct().mapInArrow(cut, "item string, text string, n_words long").distinct()


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Parts of items by blocks of about ``block_words`` words, dealt by hash; one at a time on the driver."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = _parts(items, window, max(window, block_words // 16)).filter("n_words > 0")
    parts = stored(few_files(parts, benchmark.count(), DOCUMENTS), "benchmark")
    size = parts.agg(F.sum("n_words")).first()[0] or 0
    blocks = max(1, -(-size // block_words))
    for n in range(blocks):
        own = parts if blocks == 1 else parts.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == n)
        yield [(r["item"], r["text"].encode()) for r in own.collect()]


def _counted(docs: DataFrame, text: str, block: Windows) -> dict[tuple[bytes, ...], int]:
    """In how many documents each of the block's shingles occurs."""
    vocabulary = sorted(block.vocabulary())
    held = docs.sparkSession.sparkContext.broadcast((block, {s: i for i, s in enumerate(vocabulary)}))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = held.value
        counts: Counter = Counter()
        for b in small_batches(batches, text):
            for t in texts_as_bytes(b, text):
                own.count(words_of(t), number, counts)
        yield pa.RecordBatch.from_arrays([pa.array([number[s] for s in counts], pa.int32()),
                                          pa.array(counts.values(), pa.int64())], names=["shingle", "n"])

    rows = docs.select(text).mapInArrow(count, "shingle int, n long").groupBy("shingle").agg(F.sum("n")).collect()
    held.unpersist()
    return {vocabulary[i]: n for i, n in rows}


def _found(docs: DataFrame, block: Windows, all_rows: bool) -> DataFrame:
    """``doc_id, text_hash, n_words, spans, items`` of all rows or of those with a hit."""
    held = docs.sparkSession.sparkContext.broadcast(block)
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType()))])
    span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in small_batches(batches, "text"):
            rows, n_words, spans, items = [], [], [], []
            for row, t in enumerate(texts_as_bytes(b, "text")):
                words = words_of(t)
                places, found = own.find(words)
                if all_rows or places:
                    rows.append(row)
                    n_words.append(len(words))
                    spans.append([{"s": s, "e": e} for s, e in places])
                    items.append(sorted(found))
            kept = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), kept.column(1), pa.array(n_words, pa.int64()), pa.array(spans, span),
                 pa.array(items, pa.list_(pa.string()))], names=schema.names)

    return docs.select("doc_id", "text_hash", "text").mapInArrow(find, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, text_hash, n_words, spans, items`` per row: merged word ranges that are hit, ids of items found."""
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = whole.withColumn("text_hash", F.xxhash64("text"))
    found: list[DataFrame] = []
    for items in _blocks(benchmark, item_id, item_text, window, block_words):
        if len(found) == 1:
            found = [stored(found[0], "contamination")]  # it is read twice from now on
        block = Windows(items, window, shingle)
        block.order(_counted(whole, "text", block))
        found.append(_found(whole, block, all_rows=not found))
    if len(found) == 1:
        return found[0]
    more = found[0].filter(F.size("spans") > 0).distinct()
    for f in found[1:]:
        more = more.unionByName(f.distinct())
    more = more.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    f, m = found[0].select("doc_id", "text_hash", "n_words").alias("f"), more.alias("m")
    same = F.col("f.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("f.text_hash") == F.col("m.text_hash"))
    none = F.array().cast(found[0].schema["spans"].dataType)
    return f.join(m, same, "left").select(
        "f.*", F.coalesce("m.spans", none).alias("spans"),
        F.coalesce("m.items", F.array().cast("array<string>")).alias("items"))


def n_hit(spans):
    """Words inside any of the ranges, which must be in order of their start."""
    start = F.struct(F.lit(0).cast("long").alias("e"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, start, lambda acc, x: F.struct(
        F.greatest(acc["e"], x["e"]).alias("e"),
        (acc["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(acc["e"], x["s"]))).alias("n")))["n"]


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    return found.select(
        "doc_id", "n_words", n_hit("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, all columns, in which no window of the benchmark occurs."""
    hash_name = free_name(docs, "_hash")
    bad = contamination(docs, benchmark, doc_id, text, **options).filter(F.size("spans") > 0).select("doc_id", "text_hash").distinct()
    left = docs.withColumn(hash_name, F.xxhash64(F.coalesce(F.col(text), F.lit("")))).alias("d")
    same = F.col(f"d.{doc_id}").eqNullSafe(F.col("b.doc_id")) & (F.col(f"d.{hash_name}") == F.col("b.text_hash"))
    return left.join(bad.alias("b").hint("shuffle_hash"), same, "left_anti").drop(hash_name)
