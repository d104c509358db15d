"""Streams: ingest, dedup, windowed figures, sessions, aging alerts, newest state.

Every job takes a streaming DataFrame, a target folder and a checkpoint folder in
shared storage, and processes what is available (``availableNow``) unless another
trigger is given. Batch folders are overwritten as a whole, so a batch that is
retried after a failure leaves the same result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickframe.functions.numbers import fixed_sum
from tickframe.operators.documented import aging_band, aging_share
from tickframe.plans.shape import keep_last
from tickframe.sources.keys import read_if_there
from tickframe.sources.sinks import append_new

AVAILABLE = {"availableNow": True}


def read_files(spark: SparkSession, folder: str, schema, glob: str | None = None,
               files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str,
           trigger: dict | None) -> StreamingQuery:
    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .foreachBatch(write).trigger(**(trigger or AVAILABLE)).start())


def to_changelog(stream: DataFrame, path: str, checkpoint: str, mode: str = "update",
                 trigger: dict | None = None) -> StreamingQuery:
    """Each batch's rows as one folder of Parquet, rewritten whole if the batch repeats."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _start(stream, write, checkpoint, mode, trigger)


def read_changelog(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """The changelog, or with ``keys`` only each key's row of the latest batch."""
    log = spark.read.parquet(path)
    return (keep_last(log, keys, ["batch"]) if keys else log).drop("batch")


def ingest(raw: DataFrame, clean: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
           order: list, trigger: dict | None = None) -> StreamingQuery:
    """Clean each batch, keep the last row per number by ``order``, append numbers not stored yet.

    The same as ``sinks.append_new`` with the checkpoint and the batch's number as its name: a batch
    that Spark repeats replaces what it wrote before, wherever it failed.
    """
    stream = zlib.crc32(checkpoint.encode())

    def write(batch: DataFrame, batch_id: int) -> None:
        append_new(batch.sparkSession, clean(batch), path, order=order, batch=f"stream-{stream:08x}-{batch_id}")

    return _start(raw, write, checkpoint, "append", trigger)


def dedup(stream: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """First row per key within the watermark; the batch rule keeps the last instead."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def tumbling_kpis(stream: DataFrame, time: str = "ts", size: str = "1 day", delay: str = "1 hour",
                  kind: str = "event_type", value: str = "value") -> DataFrame:
    """Rows, users and value per window and kind; value in whole 1/10000 units."""
    return (stream.withWatermark(time, delay).groupBy(F.window(time, size), kind)
            .agg(F.count("*").alias("n"), fixed_sum(value).alias("units"), F.max(value).alias("max_value"))
            .select(F.col("window.start").alias("start"), kind, "n",
                    (F.col("units") / F.lit(10_000.0)).alias("total"), "max_value"))


def sliding_volume(stream: DataFrame, time: str = "ts", size: str = "7 days", step: str = "1 day",
                   delay: str = "1 hour") -> DataFrame:
    return (stream.withWatermark(time, delay).groupBy(F.window(time, size, step)).agg(F.count("*").alias("n"))
            .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n"))


def sessions(stream: DataFrame, user: str = "user_id", time: str = "ts", gap: str = "1 hour",
             delay: str = "1 hour") -> DataFrame:
    """Activity per user, closed after an idle gap; append mode emits closed sessions."""
    return (stream.withWatermark(time, delay).groupBy(user, F.session_window(time, gap))
            .agg(F.count("*").alias("events"))
            .select(user, F.col("session_window.start").alias("start"),
                    F.col("session_window.end").alias("end"), "events"))


def aging_alerts(stream: DataFrame, as_of) -> DataFrame:
    """Open tickets with the elapsed share of their contract hours and its band; stateless."""
    share = aging_share(as_of)
    return stream.where(F.col("state").isin("Open", "In Progress", "On Hold")).select(
        "number", "priority", F.bround(share, 1).alias("elapsed_pct"), aging_band(share).alias("band"))


def latest_state(stream: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """Newest state per ticket; the state store holds one row per ticket, so for streams of few tickets.

    ``latest_store`` keeps the same on disk, for any number of tickets.
    """
    newest = F.max_by(state, F.struct(*order))
    return stream.groupBy(key).agg(newest.alias("state"), F.max(order[0]).alias("updated"), F.count("*").alias("updates"))


_STORE_PARTS = ["bucket", "slot"]


def latest_store(stream: DataFrame, key: str, state: str, order: list[str], path: str, checkpoint: str,
                 buckets: int = 64, trigger: dict | None = None) -> StreamingQuery:
    """Newest state per ticket in a table on shared storage; Spark's state store holds nothing.

    The table lies in ``buckets`` hash partitions of the key, each in two slots. A batch is reduced to
    one row per ticket, merged with the newest slot of the buckets it touches, and written to
    their other slots, so a reader always finds a whole slot and never more than two. Slots carry the batch
    that wrote them; a repeated batch does not read its own and writes the same again. Batches must come from one checkpoint.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = _newest(batch.select(F.col(key), F.struct(*order).alias("at"), F.col(state).alias("state"),
                                   F.col(order[0]).alias("updated"), F.lit(1).cast("long").alias("updates")), key)
        own = own.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist(StorageLevel.MEMORY_AND_DISK)
        touched = [r[0] for r in own.select("bucket").distinct().collect()]
        store = read_if_there(spark, path)
        newest: dict[int, int] = {}
        if store is not None and touched:
            store = store.where(F.col("bucket").isin(touched) & (F.col("batch") < batch_id))
            newest = {r["bucket"]: r["slot"] for r in _newest_slots(store).collect()}  # one row for each bucket
        slot = {b: 1 - newest.get(b, 1) for b in touched}
        rows = own
        if newest:
            in_slot = F.lit(False)
            for s in (0, 1):
                in_slot = in_slot | ((F.col("slot") == s) & F.col("bucket").isin([b for b, x in newest.items() if x == s]))
            rows = _newest(own.unionByName(store.where(in_slot).select(*own.columns)), key, "bucket")
        to = F.when(F.col("bucket").isin([b for b, s in slot.items() if s == 1]), 1).otherwise(0)
        # Both slots of a bucket are never in one job: it reads the one and replaces the other.
        # The hint lets AQE deal a large bucket to several tasks.
        (rows.withColumns({"slot": to, "batch": F.lit(batch_id).cast("long")}).hint("rebalance", "bucket")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_STORE_PARTS).parquet(path))
        own.unpersist()

    return _start(stream, write, checkpoint, "append", trigger)


def _newest(rows: DataFrame, key: str, *also: str) -> DataFrame:
    return rows.groupBy(key, *also).agg(F.max_by("state", "at").alias("state"), F.max("updated").alias("updated"),
                                        F.sum("updates").alias("updates"), F.max("at").alias("at"))


def _newest_slots(store: DataFrame) -> DataFrame:
    return store.groupBy("bucket").agg(F.max_by("slot", "batch").alias("slot"))


def read_latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """``key, state, updated, updates`` of every ticket that ``latest_store`` keeps."""
    store = spark.read.parquet(path)
    return store.join(_newest_slots(store), _STORE_PARTS, "left_semi").select(key, "state", "updated", "updates")
