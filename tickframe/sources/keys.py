"""The register's key index: which numbers it holds, so that an upload need not read the register.

A narrow table ``(number, bucket, batch)`` below the register, in ``_keys`` (a name that readers of
the register pass over). It is partitioned by a hash of the number, so a batch reads the buckets
that its own numbers fall into and no others, whatever month its tickets are dated.

Every write carries the name of its batch, in the register and in the index. A batch that is written
again, after a failure at any point, does not count its own earlier entries as known and replaces
both its register folders and its index folders: rows are neither lost nor stored twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed when a register is first written: the index's folders are named by it.
BUCKETS = 64
SCHEMA = "number string, bucket int, batch string"


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def read_if_there(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A Parquet table, or None where there is none yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        return None
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":  # a folder without a file
            raise
        return None


def add(register: DataFrame, path: str) -> None:
    """Enters the numbers of register rows (with their ``batch``); a batch's own folders are replaced."""
    key = F.trim("number")
    (register.select(key.alias("number"), bucket_of(key).alias("bucket"), "batch").repartition("bucket")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{path}/_keys"))


def known(rows: DataFrame, path: str, batch: str) -> DataFrame | None:
    """Trimmed numbers ``_k`` that other batches than this one stored, of the buckets that ``rows`` touch.

    The numbers of those buckets (at most ``BUCKETS``) are all that goes to the driver. A register
    that was written without an index gets one first.
    """
    spark = rows.sparkSession
    index = read_if_there(spark, f"{path}/_keys", SCHEMA)
    if index is None:
        register = read_if_there(spark, path)
        if register is None:
            return None
        add(register.select("number", F.col("batch").cast("string").alias("batch")), path)
        index = spark.read.schema(SCHEMA).parquet(f"{path}/_keys")
    touched = [r[0] for r in rows.select(bucket_of(F.trim("number"))).distinct().collect()]
    return index.where(F.col("bucket").isin(touched) & (F.col("batch") != batch)).select(F.col("number").alias("_k"))
