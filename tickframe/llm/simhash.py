"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints differ in at most ``2 r`` bits exactly when some value differs from both
in at most ``r`` bits. So every distinct fingerprint emits all variants within half the
radius, equal variants meet, and all fingerprints at one variant are within the radius of
each other: each is linked to the smallest one there, after its distance was checked.
No pairs inside a group are listed and no link is lost.

Variants travel in bundles: those of a fingerprint that share their first ``p`` bits are one
row (prefix, fingerprint), written out only by the task that has the prefix. ``p`` grows with
the number of fingerprints, so a task's variants stay at about ``per_task``. Where many
fingerprints crowd at a prefix (a large group of near copies), its variants are dealt to
several tasks by a linear hash of their bits; each task writes out its own variants only.

Rules: a null text has no words and fingerprint zero, linked like any other. Fewer words
than a shingle are one shingle. Repeated rows are linked like copies. A null id is in a
component but does not name it unless all its ids are null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.llm.common import DOCUMENTS, few_files, id_key, one_row_per_key, small_batches, stored, texts_as_bytes
from tickframe.llm.components import components

SHINGLE, BITS, SEED = 4, 4, 42
PER_TASK = 2_000_000
#: Shingles whose bits are counted at once.
_AT_ONCE = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 where over half of the shingles' XXH64 have it; zero without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # for bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -shingle] + 1)).tolist()
    hashes = np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1:].tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _AT_ONCE):
        part = hashes[i: i + _AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                 seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` of each row; fp is the fingerprint as a signed 64-bit number."""
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([whole.schema["doc_id"], T.StructField("fp", T.LongType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            found = np.array([fingerprint(t, shingle, seed) for t in texts_as_bytes(b, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return whole.mapInArrow(hashed, schema)


@lru_cache(maxsize=64)
def masks(width: int, most: int) -> list[list[int]]:
    """All values with 0, 1, ... ``most`` of the lowest ``width`` bits set, by their number."""
    return [[sum(1 << i for i in c) for c in combinations(range(width), k)] for k in range(most + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _columns(bits: int) -> np.ndarray:
    """For each bit of a variant a number of ``bits`` bits; their xor is the variant's linear hash."""
    x = np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - bits)) if bits else np.zeros(64, np.uint64)


def _linear(values: np.ndarray, columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.uint64)
    for i, c in enumerate(columns):
        out ^= np.where(values >> np.uint64(i) & np.uint64(1), c, np.uint64(0))
    return out


def _variants(fps: np.ndarray, prefix: int, p: int, r: int, part: int, part_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Variants with this prefix and part, and for each the place of its fingerprint."""
    low = 64 - p
    columns = _columns(part_bits)
    top = fps >> np.uint64(low) if p else np.zeros(len(fps), np.uint64)
    spent = np.bitwise_count(top ^ np.uint64(prefix))
    keep = np.uint64((1 << low) - 1)
    base = (fps & keep) | np.uint64((prefix << low) & (2**64 - 1))
    by_count = [np.array(m, np.uint64) for m in masks(low, r)]
    values, owners = [], []
    for used in range(r + 1):
        mine = np.flatnonzero(spent == used)
        if not len(mine):
            continue
        flips = np.concatenate(by_count[: r - used + 1])
        flip_hash, own_hash = _linear(flips, columns), _linear(base[mine], columns)
        for h in np.unique(own_hash):
            some, own = flips[flip_hash == (h ^ np.uint64(part))], mine[own_hash == h]
            values.append((base[own][:, None] ^ some[None, :]).ravel())
            owners.append(np.repeat(own.astype(np.int32), len(some)))
    if not values:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return np.concatenate(values), np.concatenate(owners)


def _meet(fps: np.ndarray, values: np.ndarray, owners: np.ndarray, most: int) -> np.ndarray:
    """Links (larger, smaller place) of fingerprints that meet at a variant; ``fps`` are in order."""
    order = np.argsort(values)
    values, owners = values[order], owners[order]
    shared = np.zeros(len(values) + 1, bool)
    shared[1:-1] = values[1:] == values[:-1]
    inside = shared[:-1] | shared[1:]
    values, owners = values[inside], owners[inside]
    if not len(values):
        return np.zeros((0, 2), np.int32)
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    first = np.repeat(np.minimum.reduceat(owners, starts), np.diff(np.append(starts, len(values))))
    links = np.unique(np.stack([owners, first], axis=1)[owners != first], axis=0)
    near = np.bitwise_count(fps[links[:, 0]] ^ fps[links[:, 1]]) <= most
    return links[near]


def links(nodes: DataFrame, bits: int = BITS, per_task: int = PER_TASK) -> DataFrame:
    """``u, v``: enough pairs of distinct fingerprints within ``bits`` to connect all that are.

    ``nodes`` has distinct ``fp``. Bits must be even: half of them is the radius of a ball.
    """
    if bits % 2:
        raise ValueError("an even number of bits is needed")
    r = bits // 2
    ball = sum(map(len, masks(64, r)))
    p = min(32, max(0, -(-nodes.count() * ball // per_task) - 1).bit_length())
    flips = F.array(*[F.lit(m) for k in masks(p, r) for m in k])
    top = F.shiftrightunsigned("fp", 64 - p) if p else F.lit(0).cast("long")
    sent = nodes.select("fp", top.alias("top")).select("fp", "top", F.explode(flips).alias("flip")).select(
        "fp", F.col("top").bitwiseXOR(F.col("flip").cast("long")).alias("prefix"))
    # How many variants each prefix will have decides in how many parts it is dealt.
    load = (
        nodes.groupBy(top.alias("top")).agg(F.count(F.lit(1)).alias("n"))
        .select("n", "top", F.explode(flips).alias("flip"))
        .select("n", F.col("top").bitwiseXOR(F.col("flip").cast("long")).alias("prefix"), F.bit_count("flip").alias("used"))
    )
    inside = F.lit(0)
    for used in range(r + 1):
        inside = F.when(F.col("used") == used, sum(map(len, masks(64 - p, r - used)))).otherwise(inside)
    load = load.groupBy("prefix").agg(F.sum(F.col("n") * inside).alias("variants"))
    parts = load.select("prefix", F.least(F.lit(11), F.greatest(F.lit(0), F.ceil(F.log2(
        F.col("variants") / (2.0 * per_task))))).cast("int").alias("part_bits"))
    part = F.expr("explode(sequence(0L, shiftleft(1L, part_bits) - 1))")
    dealt = sent.join(parts, "prefix").select("prefix", "part_bits", part.alias("part"), "fp")

    def meet(table: pa.Table) -> pa.Table:
        prefix, part_bits, part = (table.column(n)[0].as_py() for n in ("prefix", "part_bits", "part"))
        fps = np.sort(table.column("fp").to_numpy().astype(np.int64).view(np.uint64))
        found = _meet(fps, *_variants(fps, prefix, p, r, part, part_bits), bits)
        return pa.table({"u": fps[found[:, 0]].view(np.int64), "v": fps[found[:, 1]].view(np.int64)})

    return dealt.groupBy("prefix", "part_bits", "part").applyInArrow(meet, "u long, v long")


def _rooted(prints: DataFrame, rows: int, bits: int, per_task: int) -> DataFrame:
    """``fp, least, root`` of each distinct fingerprint: its least id and its component's smallest fingerprint."""
    nodes = stored(few_files(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), rows), "nodes")
    roots = components(links(nodes.select("fp"), bits, per_task), rows)
    return nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS,
                seed: int = SEED, per_task: int = PER_TASK) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row."""
    prints = stored(fingerprints(docs, doc_id, text, shingle, seed), "fingerprints")
    joined = _rooted(prints, prints.count(), bits, per_task)
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = joined.join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                      bits: int = BITS, seed: int = SEED, per_task: int = PER_TASK) -> DataFrame:
    """One row of each group, all columns: the one with the smallest id, then the smallest text hash.

    A null id is larger than any other, a null text's hash too. Ids need not be unique: a row is
    known by its id and text. Rows that agree in both are ties, of which one stays.
    """
    sha = F.coalesce(F.sha2(F.col(text), 256), F.lit("null"))
    known_by = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), sha.alias("sha"))
    prints = stored(fingerprints(docs.select(known_by.alias("row"), F.col(text).alias("text")), "row", "text", shingle, seed),
                    "fingerprints")
    rows = prints.count()
    first = _rooted(prints, rows, bits, per_task).groupBy("root").agg(F.min("least").alias("row"))
    kept = first.select(id_key(F.col("row.id")).alias("id"), F.col("row.sha").alias("sha"))
    return few_files(one_row_per_key(docs, kept, {"id": id_key(F.col(doc_id)), "sha": sha}), rows, DOCUMENTS)
