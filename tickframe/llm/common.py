"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickframe.session import work_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Whole documents that a task writes at most, about, where their number decides.
DOCUMENTS = 4_000
#: The bytes that the operators call white space: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a result to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_files(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """For rows that are written next, about ``rows``: by as many tasks as there are cores or more, each of about ``most``.

    A session may deal a few thousand rows to hundreds of tasks. Where Hadoop has no native library, each file on a local
    folder makes its executor start three short-lived processes, which share the executor's memory until they run.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // most)))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII texts take the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not use yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(batches: Iterable[pa.RecordBatch], text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of at most about ``most`` text bytes (one row at least)."""
    for b in batches:
        col = b.column(b.schema.get_field_index(text))
        start, size = 0, 0
        lengths = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths):
            if size and size + n > most:
                yield b.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        if start < b.num_rows:
            yield b.slice(start)


def texts_as_bytes(batch: pa.RecordBatch, text: str) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    col = batch.column(batch.schema.get_field_index(text))
    return [b"" if x is None else x for x in col.cast(pa.large_binary()).to_pylist()]


def id_key(doc_id: Column) -> Column:
    """A text for each id, null too, so that rows can be joined and ranked by it in one shuffle."""
    return F.when(doc_id.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), doc_id.cast("string")))


def one_row_per_key(docs: DataFrame, kept: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows whose ``keys`` are those of a row of ``kept``; of rows that agree in them, one.

    ``keys`` gives for each column of ``kept`` the documents' expression; none may be null. One
    shuffle serves the join and the ranking.
    """
    own = {k: free_name(docs, f"_{k}") for k in keys}
    rank = free_name(docs, "_rank")
    wanted = kept.select(*(F.col(k).alias(n) for k, n in own.items())).distinct()
    left = docs.withColumns({own[k]: c for k, c in keys.items()}).join(wanted, list(own.values()), "left_semi")
    w = Window.partitionBy(*own.values()).orderBy(F.lit(1))
    return left.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) == 1).select(*docs.columns)
