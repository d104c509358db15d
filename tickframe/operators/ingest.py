"""Deduplication, merging and linking of uploads with the existing register."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.plans.shape import keep_last


def drop_blank_key(df: DataFrame, key: str = "number") -> DataFrame:
    return df.where(F.trim(key) != "")


def dedup_keep_last(df: DataFrame, key: str = "number", order: list | None = None) -> DataFrame:
    """One row per key, the last in file order; ``order`` names the position columns."""
    return keep_last(df, key, order or ["_seq"])


def dedup_removed(df: DataFrame, key: str = "number") -> DataFrame:
    """Keys that occur more than once and how many of their rows dedup removes."""
    return (df.groupBy(key).agg((F.count("*") - 1).alias("removed")).where("removed > 0"))


def known_keys(new: DataFrame, existing: DataFrame, key: str = "number") -> DataFrame:
    """Trimmed keys (``_k``) of the upload that the register holds.

    The register is far larger than an upload, so it is reduced to the keys that
    occur in the upload: a semi join whose small side Spark broadcasts when its
    measured size allows.
    """
    k = F.trim(F.col(key)).alias("_k")
    wanted = new.select(k).where("_k IS NOT NULL").distinct()
    return existing.select(k).join(wanted, "_k", "left_semi").distinct()


def split_known(new: DataFrame, existing: DataFrame, key: str = "number") -> tuple[DataFrame, DataFrame]:
    """(rows with an unseen key, rows whose key exists), keys compared trimmed."""
    known = known_keys(new, existing, key)
    keyed = new.withColumn("_k", F.trim(F.col(key)))
    return (keyed.join(known, "_k", "left_anti").drop("_k"),
            keyed.join(known, "_k", "left_semi").drop("_k"))


def merge_incidents(new: DataFrame, existing: DataFrame, key: str = "number") -> DataFrame:
    """Counts of a merge: imported, skipped as known, total afterwards."""
    known = known_keys(new, existing, key).withColumn("_hit", F.lit(True))
    rows = new.select(F.trim(F.col(key)).alias("_k")).join(known, "_k", "left")
    counts = rows.agg(F.count_if(F.col("_hit").isNull()).alias("records_imported"),
                      F.count("_hit").alias("duplicates_skipped"))
    n = existing.agg(F.count("*").alias("n")).scalar()
    return counts.withColumn("total_in_system", F.col("records_imported") + n)


def union_existing(existing: DataFrame, new: DataFrame, key: str = "number") -> DataFrame:
    """The register followed by the upload's unseen rows."""
    return existing.unionByName(split_known(new, existing, key)[0], allowMissingColumns=True)


def link_key(columns: list[str]) -> str | None:
    """First column whose name speaks of an incident or a number."""
    return next((c for c in columns if "incident" in c.lower() or "number" in c.lower()), None)


def link_counts(rows: DataFrame, incidents: DataFrame, count_skipped: bool = True) -> DataFrame:
    """How many imported rows link to a known incident.

    Rows are pre-counted per key before the join, so a key that holds most of the
    import meets the register once and not once per row; the register is reduced to
    the import's keys before anything of it is shuffled.
    """
    key = link_key(rows.columns)
    skipped = (F.col("records_imported") - F.col("records_merged")) if count_skipped else F.lit(0).cast("long")
    if key is None:
        return (rows.agg(F.count("*").alias("records_imported"))
                .withColumns({"records_merged": F.lit(0).cast("long"),
                              "duplicates_skipped": F.lit(0).cast("long"),
                              "validation_warnings": F.lit(1)}))
    per_key = rows.groupBy(F.col(key).alias("number")).agg(F.count("*").alias("n"))
    known = (incidents.select("number").join(per_key.select("number"), "number", "left_semi").distinct()
             .withColumn("hit", F.lit(True)))
    return (per_key.join(known, "number", "left")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records_imported"),
                 F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("records_merged"))
            .withColumns({"duplicates_skipped": skipped, "validation_warnings": F.lit(0)}))


def link_scores(incidents: DataFrame, scores: DataFrame, value: str) -> DataFrame:
    """Every incident with the number, maximum and minimum of its linked scores (null without any)."""
    key = link_key(scores.columns)
    per_key = (scores.groupBy(F.col(key).alias("number"))
               .agg(F.count(value).alias("score_count"), F.max(value).alias("score_max"),
                    F.min(value).alias("score_min")))
    return incidents.join(per_key, "number", "left")


def except_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_anti")


def intersect_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_semi")


def union_files(*files: DataFrame) -> DataFrame:
    out = files[0]
    for f in files[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
