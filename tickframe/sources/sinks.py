"""The incident table on disk, appends to it, exports and the ingest log."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tickframe.functions.clean import format_date
from tickframe.operators.ingest import drop_blank_key
from tickframe.plans.shape import keep_last
from tickframe.schema import CANONICAL_COLUMNS, EXPORT_COLUMNS
from tickframe.sources import keys

TABLE_EXTRAS = ["tower", "sdm", "priority_label", "urgency_label", "made_sla_bool", "week", "date",
                "hour", "dow", "mttr_hours"]


def write_clean(df: DataFrame, path: str, mode: str = "overwrite", extra: tuple[str, ...] = (), batch: str = "first") -> int:
    """Cleaned incidents as Parquet by month and batch; the number of rows written.

    ``overwrite`` replaces the table with its key index; any other mode only what this batch wrote
    before. The rebalance hint lets AQE split a month that holds most rows over several files and
    merge small months' leftovers, instead of one file per task and month. Rows are counted as they
    are written.
    """
    extras = [c for c in (*TABLE_EXTRAS, *extra) if c in df.columns]
    seen = Observation()
    rows = (df.select(*CANONICAL_COLUMNS, *extras, "month", F.lit(batch).alias("batch")).hint("rebalance", "month")
            .observe(seen, F.count(F.lit(1)).alias("rows")))
    writer = rows.write.mode("overwrite").partitionBy("month", "batch")
    if mode != "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
    return seen.get["rows"]


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    """The table; months stay text and prune partitions when filtered."""
    df = spark.read.parquet(path)
    return df.withColumn("month", F.col("month").cast("string")).drop("batch")


def append_new(spark: SparkSession, new: DataFrame, path: str, mode: str = "append", order: list | None = None,
               batch: str | None = None) -> int:
    """Add rows whose number the table does not hold yet, or replace the table.

    Rows without a number are refused; of a number that the upload repeats the last row by
    ``order`` is stored (the position ``_seq`` if there is one, else the last update). Known numbers
    are looked up in the key index (``sources.keys``), so a ticket sent again under another month, or none, is
    known too. A caller who may have to repeat an upload names it by ``batch``: the same name again
    replaces what it wrote. Returns the number of rows written.
    """
    order = order or (["_seq"] if "_seq" in new.columns else ["updated", "created"])
    batch = batch or f"upload-{uuid.uuid4().hex[:12]}"
    rows = keep_last(drop_blank_key(new), "number", order)
    if mode != "append":
        n = write_clean(rows, path, batch=batch)
    else:
        # Read twice, for the buckets that it touches and for its rows; a lost block is made again.
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        known = keys.known(rows, path, batch)
        fresh = rows if known is None else rows.withColumn("_k", F.trim("number")).join(known, "_k", "left_anti").drop("_k")
        n = write_clean(fresh, path, mode="append", batch=batch)
        rows.unpersist()
    if n:
        keys.add(spark.read.parquet(path).where(F.col("batch") == batch).select("number", F.lit(batch).alias("batch")), path)
    return n


def export_csv(df: DataFrame, path: str) -> None:
    """The 13 columns of a register view, every field quoted."""
    cols = [format_date(c).alias(c) if t == "timestamp" else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
            for c, t in df.select(*EXPORT_COLUMNS).dtypes]
    (df.select(*cols).write.mode("overwrite").option("header", True).option("quoteAll", True)
     .option("escape", '"').csv(path))


def source_inventory(log: DataFrame) -> DataFrame:
    """Name, type, records and last update per source, from the ingest log."""
    return (log.groupBy(F.col("source").alias("name"), "type")
            .agg(F.count("*").alias("records"), F.max("ingested_at").alias("last_updated"))
            .withColumn("status", F.lit("active")).orderBy("name"))
