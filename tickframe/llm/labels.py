"""A bounded, repeatable sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm.common import stored


def rows_of_ids(docs: DataFrame, chosen: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row for each of the ``chosen`` ids (``id`` and other columns): the text with the smallest hash; stored.

    The chosen ids, a bounded number, are sent to every task, so the documents are not shuffled; of an id
    that repeats each task passes on one row.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("text"), "text"))
    return stored(rows.join(F.broadcast(chosen), "id").withColumn("nth", first).filter("nth = 1").drop("nth", "id"), "sample")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``text, label``: at most ``most`` labelled documents, the first by a hash of the id; stored.

    A label is 0 or 1; rows with a null id or label are not used, of several labels for one id the largest
    counts, and of several rows of one id the one whose text has the smallest hash.
    """
    chosen = (
        labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
        .filter("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(most)
    )
    return rows_of_ids(docs, chosen, doc_id, text).select("text", "label")
