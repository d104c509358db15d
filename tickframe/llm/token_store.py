"""Token ids on disk as directly addressable codes.

Documents are range-partitioned by id, so that the partitions one after the other are
the corpus in ascending order. Each task encodes its documents and writes shards: rows of
a Parquet table with a binary ``payload`` and the list of documents in it. A shard ends
with the first document that fills it; a document is never divided.

Payload: ``DAC1``, number of ids (u64), number of levels (u8), then per level the number of
chunks (u64), the low 8 bits of what is left of each id (a byte each), a bitmap of those
ids that go on in the next level, and a rank directory: the set bits before every block of
512 bits (u32). The i-th id is read by walking down the levels with one rank each;
no other id is decoded. All integers are little-endian.

Rules: a null text is empty and still gets its end id. Rows that share an id come in the
order of their texts' hashes and texts; null ids come first. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.llm.common import small_batches
from tickframe.llm.encode import END, TOKENIZER, encoder

MAGIC, BLOCK = b"DAC1", 512
#: Ids after which a shard ends.
SHARD = 1 << 20


def pack_ids(ids: np.ndarray) -> bytes:
    """The payload for unsigned 32-bit ids."""
    left, levels = np.ascontiguousarray(ids, dtype="<u4"), []
    n = len(left)
    while len(left) or not levels:
        more = left > 0xFF
        bits = np.packbits(more, bitorder="little").tobytes()
        padded = np.zeros(-(-len(left) // BLOCK) * BLOCK, dtype=bool)
        padded[: len(more)] = more
        set_bits = padded.reshape(-1, BLOCK).sum(axis=1, dtype=np.uint64)
        rank = (np.cumsum(set_bits) - set_bits).astype("<u4").tobytes()
        levels.append(struct.pack("<Q", len(left)) + (left & 0xFF).astype(np.uint8).tobytes() + bits + rank)
        left = left[more] >> 8
    return MAGIC + struct.pack("<QB", n, len(levels)) + b"".join(levels)


class TokenShard:
    """Reads a payload: ``len``, ``shard[i]`` and ``ids()``."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.n, levels = struct.unpack_from("<QB", payload, 4)
        at, self.levels = 13, []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", payload, at)
            chunk, bits, blocks = at + 8, at + 8 + n, at + 8 + n + -(-n // 8)
            at = blocks + 4 * -(-n // BLOCK)
            self.levels.append((np.frombuffer(payload, np.uint8, n, chunk), np.frombuffer(payload, np.uint8, blocks - bits, bits),
                                np.frombuffer(payload, "<u4", (at - blocks) // 4, blocks)))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for depth, (chunks, bits, rank) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * depth
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            inside = np.unpackbits(bits[block * BLOCK // 8: (i >> 3) + 1], bitorder="little")[: i - block * BLOCK]
            i = int(rank[block]) + int(inside.sum())
        return value

    def ids(self) -> np.ndarray:
        """All ids, level by level."""
        value = np.zeros(self.n, dtype="<u4")
        place = np.arange(self.n)
        for depth, (chunks, bits, _) in enumerate(self.levels):
            value[place] |= chunks.astype(np.uint32) << np.uint32(8 * depth)
            place = place[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
        return value


def write_token_store(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
                      tokenizer: str = TOKENIZER, end: int = END, shard: int = SHARD) -> None:
    """Encodes every text, adds the end id and writes the shards in ascending order of the ids."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = whole.withColumn("tie", F.xxhash64("text"))
    ordered = whole.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    kind = whole.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()),
        T.StructField("first", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("documents", T.ArrayType(T.StructType([
            T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType())]))),
        T.StructField("payload", T.BinaryType())])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, tail = TaskContext.get().partitionId(), encoder(tokenizer), end.to_bytes(4, "little")
        number, first, ids, lens, held, size = 0, 0, [], [], [], 0

        def closed() -> pa.RecordBatch:
            keys = pa.concat_arrays(ids)
            listed = pa.StructArray.from_arrays([keys, pa.array(lens, pa.int64())], ["doc_id", "n_tokens"])
            payload = pack_ids(np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()),
                pa.array([size], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(lens)], pa.int32()), listed),
                pa.array([payload], pa.binary())], names=schema.names)

        for b in small_batches(batches, "text"):
            for i, found in enumerate(enc.all_ids(b.column(1))):
                held.append(found + tail)
                ids.append(b.column(0).slice(i, 1))
                lens.append(len(found) // 4 + 1)
                size += lens[-1]
                if size >= shard:
                    yield closed()
                    number, first, ids, lens, held, size = number + 1, first + size, [], [], [], 0
        if lens:
            yield closed()

    ordered.select("doc_id", "text").mapInArrow(shards, schema).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every stored document, decoded from the shards.

    ``start`` is the number of ids before it. Only the totals of the partitions are added up
    in one place, a row for each writing task.
    """
    files = spark.read.parquet(path)
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(before, F.lit(0)).alias("base"))
    kind = files.schema["documents"].dataType.elementType["doc_id"].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("local", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                part, first, documents, payload = (b.column(n)[row] for n in ("part", "first", "documents", "payload"))
                ids = TokenShard(payload.as_buffer()).ids()
                keys, lens = documents.values.field("doc_id"), documents.values.field("n_tokens").to_numpy()
                ends = np.cumsum(lens)
                crc = [zlib.crc32(ids[e - n: e]) for e, n in zip(ends, lens)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(lens), part.as_py(), np.int32)), keys,
                    pa.array(first.as_py() + ends - lens), pa.array(lens), pa.array(crc, pa.int64())], names=schema.names)

    found = files.select("part", "first", "documents", "payload").mapInArrow(decode, schema)
    return found.join(F.broadcast(base), "part").select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
