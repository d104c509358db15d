"""Terms of texts by blocks: what a term needs from all texts is asked once a block, not once a text.

A block holds some thousand texts as packed words. It sends each of its different terms, with the number
of its texts that have it, to the bucket of the term; a bucket adds these up and answers every block. Unigrams and
bigrams of a text are counted from the block's words with numpy, so no row of a text and a term is shuffled
or stored. Blocks have a bounded size and buckets follow the number of blocks, so memory does not grow.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.session import stored

#: Bytes of words in a block, and what a text counts for beside its words; a text is never divided.
BLOCK = 3_000_000
TEXT = 16
#: Blocks whose terms, all together, are about as many as meet in a bucket.
SHARE = 2
#: Entries that a block returns in one Arrow batch, about.
ENTRIES = 250_000
#: Blocks are large rows and packed: pages and row groups end after any of them, and no codec holds buffers of a page.
WRITTEN = {"compression": "uncompressed", "parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
#: A packed array is preceded by its size.
HEAD = 8


def _pack(raw: bytes) -> bytes:
    return len(raw).to_bytes(HEAD, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> bytes:
    return pa.decompress(packed[HEAD:], decompressed_size=int.from_bytes(packed[:HEAD], "little"), codec="zstd", asbytes=True)


def _numbers(packed: bytes) -> np.ndarray:
    return np.frombuffer(_unpack(packed), np.int64)


def text_blocks(texts: DataFrame, key: str, words: Column, copies: Column | None = None) -> DataFrame:
    """Stored rows (block, key: all keys, copies, words): ``words`` are a text's words in order, an array; ``copies`` counts for 1 unless given."""
    kind = texts.schema[key].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("key", T.ArrayType(kind)),
                           T.StructField("copies", T.ArrayType(T.LongType())), T.StructField("words", T.BinaryType())])

    def one(rows: list[pa.RecordBatch], block: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        whole = lambda c: pa.concat_arrays(table[c].chunks)
        alone = lambda c: pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), whole(c))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), whole("words")), "\n")
        return pa.record_batch([pa.array([block], pa.int64()), alone("key"), alone("copies"),
                                pa.array([_pack(joined.cast(pa.binary())[0].as_py())], pa.binary())], names=schema.names)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, room = TaskContext.get().partitionId() << 32, [], BLOCK
        for batch in batches:
            ends, at = np.cumsum(pc.binary_length(batch["words"]).to_numpy(zero_copy_only=False).astype(np.int64) + TEXT), 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                to = min(int(np.searchsorted(ends, before + room)) + 1, batch.num_rows)
                held.append(batch.slice(at, to - at))
                room, at = room - int(ends[to - 1] - before), to
                if room <= 0:
                    yield one(held, block)
                    block, held, room = block + 1, [], BLOCK
        if held:
            yield one(held, block)

    # Words hold neither blanks nor line ends.
    rows = texts.select(F.col(key).alias("key"), (F.lit(1) if copies is None else copies).cast("long").alias("copies"),
                        F.array_join(words, " ").alias("words"))
    return stored(rows.mapInArrow(cut, schema), "blocks", **WRITTEN)


class Terms:
    """The terms of a block: ``codes`` are different and in the order of their words; entries are (row, term, tf), by term."""

    def __init__(self, packed: bytes) -> None:
        texts = pc.split_pattern(pa.array([_unpack(packed).decode()]), "\n").flatten()
        self.rows = len(texts)
        lists = pc.split_pattern(texts, " ")
        row = np.repeat(np.arange(self.rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        told = lists.flatten().dictionary_encode()
        order = pc.sort_indices(told.dictionary).to_numpy()
        self.words = told.dictionary.take(pa.array(order))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        word = rank[told.indices.to_numpy()]
        if len(order) and self.words[0].as_py() == "":  # a text without words
            some = word > 0
            row, word = row[some], word[some]
        self.base = len(order) + 1
        near = row[1:] == row[:-1]
        code = np.concatenate([word * self.base, (word[:-1] * self.base + word[1:] + 1)[near]])
        names = None
        if self.base**2 * self.rows >= 2**62:  # one text of many million words
            names, code = np.unique(code, return_inverse=True)
        code *= self.rows
        code += np.concatenate([row, row[1:][near]])
        code.sort()
        at = np.flatnonzero(np.diff(code, prepend=-1))
        self.tf = np.diff(np.append(at, len(code)))
        code, self.row = np.divmod(code[at], self.rows)
        new = np.diff(code, prepend=-1) > 0
        self.term, self.codes = np.cumsum(new) - 1, code[new] if names is None else names[code[new]]

    def by_row(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(self.row.astype(np.uint16 if self.rows <= 2**16 else np.int64), kind="stable")
        return self.row[order], self.term[order], self.tf[order]

    def names(self) -> pa.Array:
        first, second = self.codes // self.base, self.codes % self.base - 1
        return pc.binary_join_element_wise(self.words.take(pa.array(first)), self.words.take(pa.array(second, mask=second < 0)), " ", null_handling="skip")

    def by_bucket(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms ordered by bucket, the buckets that have any, and where they begin (and the last ends)."""
        mixed = np.array([zlib.crc32(w) for w in self.words.cast(pa.binary()).to_pylist()] + [1], np.uint64)
        h = mixed[self.codes // self.base] * np.uint64(0x9E3779B97F4A7C15) + mixed[self.codes % self.base - 1] * np.uint64(0xC2B2AE3D27D4EB4F)
        bucket = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        found, begins = np.unique(bucket[order], return_index=True)
        return order, found, np.append(begins, len(order))


def _asks(blocks: DataFrame, side: int, buckets: int) -> DataFrame:
    """(bucket, side, block, terms, counts): what each block has for each bucket."""

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, copies, packed in zip(*(batch[c] for c in ("block", "copies", "words")), strict=True):
                own = Terms(packed.as_py())
                if not len(own.codes):
                    continue
                counts = np.bincount(own.term, copies.values.to_numpy()[own.row]).astype(np.int64)
                order, found, begins = own.by_bucket(buckets)
                lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), own.names().take(pa.array(order)))
                yield pa.record_batch({
                    "bucket": pa.array(found, pa.int32()), "side": pa.array(np.full(len(found), side), pa.int32()),
                    "block": pa.array(np.full(len(found), block.as_py()), pa.int64()),
                    "terms": pa.array([_pack(x) for x in pc.binary_join(lists, "\n").cast(pa.binary()).to_pylist()], pa.binary()),
                    "counts": pa.array([_pack(counts[order[a:b]].tobytes()) for a, b in zip(begins, begins[1:])], pa.binary())})

    return blocks.select("block", "copies", "words").mapInArrow(ask, "bucket int, side int, block long, terms binary, counts binary")


def _answers(asks: DataFrame, buckets: int) -> DataFrame:
    """(side, block, bucket, df, at): of each block's terms the number of texts of side 0 and, where side 1 has the term, its number, else -1."""

    def answer(asks: pa.Table) -> pa.Table:
        asks = asks.sort_by([("side", "ascending"), ("block", "ascending")])
        lists = pc.split_pattern(pa.array([_unpack(x.as_py()).decode() for x in asks["terms"]], pa.large_string()), "\n")
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        number = lists.flatten().dictionary_encode().indices.to_numpy()
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        side = np.repeat(asks["side"].to_numpy(), size)
        counts = np.concatenate([_numbers(x.as_py()) for x in asks["counts"]])
        df = np.bincount(number, counts * (side == 0)).astype(np.int64)
        at = np.full(len(df), -1)
        asked = np.unique(number[side == 1])
        at[asked] = asked
        ends = np.cumsum(size)
        each = lambda x: pa.array([_pack(x[number[e - n: e]].tobytes()) for e, n in zip(ends, size)], pa.binary())
        return pa.table([asks["side"], asks["block"], asks["bucket"], each(df), each(at) if len(asked) else pa.nulls(len(asks), pa.binary())],
                        names=["side", "block", "bucket", "df", "at"])

    return asks.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answer, "side int, block long, bucket int, df binary, at binary")


def _repeated(blocks: DataFrame) -> DataFrame | None:
    """(block, rows): the rows whose key another row has too, nulls among each other; None if there are none."""
    key = blocks.select("block", F.posexplode("key").alias("row", "key"))
    again = key.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    rows = stored(again.groupBy("block").agg(F.collect_list("row").alias("rows")), "repeated")
    return None if rows.isEmpty() else rows


def _vectors(blocks: DataFrame, answers: DataFrame, count: int, buckets: int, n: int, min_df: int, numbered: bool) -> DataFrame:
    """(key, many, square, found): of each text the terms (or their numbers, where they have one) with tf-idf, and the sum of squares of all.

    ``many``: other rows have the key too.
    """
    kind = blocks.schema["key"].dataType.elementType
    entry = [T.StructField("at", T.LongType()) if numbered else T.StructField("term", T.StringType()), T.StructField("v", T.DoubleType())]
    schema = T.StructType([T.StructField("key", kind), T.StructField("many", T.BooleanType()), T.StructField("square", T.DoubleType()),
                           T.StructField("found", T.ArrayType(T.StructType(entry)))])

    def weighed(own: pa.Table, answers: pa.Table) -> pa.Table:
        keys, terms = pa.concat_arrays(own["key"].chunks), Terms(own["words"][0].as_py())
        order, _, _ = terms.by_bucket(buckets)
        told = answers.filter(pc.field("bucket") >= 0).sort_by("bucket")
        df, at = np.zeros(len(order), np.int64), np.full(len(order), -1)
        if told.num_rows:
            df[order] = np.concatenate([_numbers(x.as_py()) for x in told["df"]])
        if numbered:
            for_bucket = [(b.as_py(), x.as_py(), d.as_py()) for b, x, d in zip(told["bucket"], told["at"], told["df"])]
            parts = [np.full(len(_numbers(d)), -1) if x is None else np.where((y := _numbers(x)) < 0, -1, (b << 32) + y) for b, x, d in for_bucket]
            at[order] = np.concatenate(parts) if parts else at
        idf = np.log((1 + n) / (1 + df.astype(float))) + 1.0
        row, term, tf = terms.by_row()
        use = (df >= min_df)[term]
        row, term = row[use], term[use]
        v = (1.0 + np.log(tf[use].astype(float))) * idf[term]
        square = np.bincount(row, v * v, terms.rows)
        if numbered:
            use = at[term] >= 0
            row, term, v = row[use], term[use], v[use]
        starts = np.searchsorted(row, np.arange(terms.rows + 1))
        many = np.zeros(terms.rows, bool)
        for rows in answers.filter(pc.field("bucket") < 0)["rows"]:
            many[rows.values.to_numpy()] = True
        names, some = None if numbered else terms.names(), np.flatnonzero((np.diff(starts) > 0) | many)
        batches = []
        while len(some):
            now = some[: max(int(np.searchsorted(starts[some + 1], starts[some[0]] + ENTRIES)), 1)]
            some = some[len(now):]
            part = slice(starts[now[0]], starts[now[-1] + 1])
            first = pa.array(at[term[part]], pa.int64()) if numbered else names.take(pa.array(term[part]))
            entries = pa.StructArray.from_arrays([first, pa.array(v[part])], names=[f.name for f in entry])
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts[now], part.stop) - part.start, pa.int32()), entries)
            batches.append(pa.record_batch([keys.values.take(pa.array(now)), pa.array(many[now]), pa.array(square[now]), lists], names=schema.names))
        if not batches:
            empty = [pa.array([], x) for x in (keys.type.value_type, pa.bool_(), pa.float64(), pa.list_(pa.struct([("at", pa.int64()) if numbered else ("term", pa.string()), ("v", pa.float64())])))]
            batches = [pa.record_batch(empty, names=schema.names)]
        return pa.Table.from_batches(batches)

    at_once = lambda df: df.repartition(count, "block").groupBy("block")
    return at_once(blocks.select("block", "key", "words")).cogroup(at_once(answers.select("block", "bucket", "df", "at", "rows"))).applyInArrow(weighed, schema)


def _with_rows(answers: DataFrame, repeated: DataFrame | None) -> DataFrame:
    if repeated is None:
        return answers.withColumn("rows", F.lit(None).cast("array<int>"))
    return answers.unionByName(repeated.withColumn("bucket", F.lit(-1)), allowMissingColumns=True)


def _size(blocks: DataFrame) -> tuple[int, int]:
    """Blocks and texts."""
    n, texts = blocks.agg(F.count(F.lit(1)), F.sum(F.size("key"))).first()
    return n, texts or 0


def _buckets(spark, blocks: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-blocks // SHARE))


def features(blocks: DataFrame, min_df: int) -> DataFrame:
    """(key, square, found: term and v) of terms that ``min_df`` texts have; ``square`` is the sum over all rows of the key."""
    count, n = _size(blocks)
    buckets = _buckets(blocks.sparkSession, count)
    again = _repeated(blocks)
    answers = _answers(_asks(blocks, 0, buckets), buckets).drop("side")
    rows = _vectors(blocks, _with_rows(answers, again), max(count, 1), buckets, n, min_df, False)
    if again is not None:  # few rows as a rule; the others need no shuffle
        shared = rows.where("many").withColumn("square", F.sum("square").over(Window.partitionBy("key")))
        rows = rows.where("NOT many").unionByName(shared)
    return rows.drop("many")


def numbered(corpus: DataFrame, queries: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(key, norm, at, v) of the texts and of the queries: the terms that both have, numbered; ``norm`` is over all terms of the texts."""
    sizes = [_size(x)[0] for x in (corpus, queries)]
    buckets = _buckets(corpus.sparkSession, sum(sizes))
    answers = stored(_answers(_asks(corpus, 0, buckets).unionByName(_asks(queries, 1, buckets)), buckets), "answers")

    def of(blocks: DataFrame, side: int) -> DataFrame:
        again = _repeated(blocks)
        rows = _vectors(blocks, _with_rows(answers.where(F.col("side") == side).drop("side"), again), max(sizes[side], 1), buckets, n, 1, True)
        rows = rows.where("key IS NOT NULL").select("key", "many", "square", F.col("found.at").alias("at"), F.col("found.v").alias("v"))
        if again is None:
            found = rows.drop("many")
        else:
            shared = rows.where("many").groupBy("key").agg(F.sum("square").alias("square"), *[F.flatten(F.collect_list(c)).alias(c) for c in ("at", "v")])
            found = rows.where("NOT many").drop("many").unionByName(shared)
        return found.select("key", F.sqrt("square").alias("norm"), "at", "v")

    return of(corpus, 0), of(queries, 1)
