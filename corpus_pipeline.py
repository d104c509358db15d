"""A corpus in five steps: language, exact copies, near copies, benchmark passages, packing.

Each stage takes all that its predecessor kept and returns whole documents (the last one the
pieces of packed sequences). Null texts and texts without a letter have no language and go
with the first stage; rows that repeat an id and a text go with the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm import decontaminate, exact_dedup, language, packing, simhash
from tickframe.llm.common import crc_of_id, stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents near a language that the training rows (crc32 of the id mod 4 not 2) show."""
    model = language.fit(docs.filter(F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) != 2))
    return language.known_language(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keeps the one with the largest id."""
    return exact_dedup.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by their fingerprints keeps the one with the smallest id."""
    return simhash.one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("language", identify_language), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
          ("decontaminate", drop_contaminated), ("packing", pack)]
#: Language ID and packing have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
