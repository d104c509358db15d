"""Top-n, shares and pivots over already aggregated rows; keep-last dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.functions.numbers import ratio_pct


def conditional_counts(column: str, values: dict) -> list[Column]:
    """One count per value; unlike ``pivot`` this stays a single aggregation."""
    return [F.count_if(F.col(column) == v).alias(name) for v, name in values.items()]


def with_share(counts: DataFrame, measure: str = "count", name: str = "percentage") -> DataFrame:
    """Share of the total; ``counts`` holds one row per group, so the window is small."""
    total = F.sum(measure).over(Window.partitionBy())
    return counts.withColumn(name, ratio_pct(F.col(measure), total))


def top_with_total(df: DataFrame, name: str, aggs: list[Column], rank_by: str, n: int) -> DataFrame:
    """The n largest groups, each with ``_total``: ``rank_by`` over all groups, blank ones included.

    The rollup's grand total travels as one more row through the distributed top-k, so
    however many groups there are, only n + 1 rows reach one task.
    """
    rows = df.rollup(name).agg(F.grouping_id().alias("_level"), *aggs)
    top = (rows.where((F.col("_level") == 1) | F.col(name).isNotNull())
           .orderBy(F.desc("_level"), F.desc(rank_by), name).limit(n + 1))
    total = F.max(F.when(F.col("_level") == 1, F.col(rank_by))).over(Window.partitionBy())
    return top.withColumn("_total", total).where("_level = 0").drop("_level")


def top_n_others(rows: DataFrame, name: str, rank_by: str, measures: list[str], n: int,
                 label: str = "Others", tie: str | None = None) -> DataFrame:
    """The n largest rows plus one row summing all others; ``folded`` counts them."""
    return (
        fold_others(rows, rows, name, rank_by, n, label, tie).groupBy(name, "_kept")
        .agg(*[F.sum(m).alias(m) for m in measures], F.count("*").alias("_n"))
        .withColumn("folded", F.when(F.col("_kept"), F.lit(0)).otherwise(F.col("_n")).cast("long"))
        .drop("_kept", "_n")
    )


def fold_others(rows: DataFrame, groups: DataFrame, name: str, rank_by: str, n: int, label: str = "Others",
                tie: str | None = None) -> DataFrame:
    """``rows`` with the name of all but the n largest ``groups`` replaced by ``label``; ``_kept`` tells which.

    The n names come from a distributed top-k and are the broadcast side of the join (n rows),
    so no task sees all groups.
    """
    top = groups.orderBy(F.desc(rank_by), F.asc(tie or name)).limit(n).select(F.col(name).alias("_name"), F.lit(True).alias("_top"))
    kept = F.col("_top").isNotNull()
    return (rows.join(F.broadcast(top), F.col(name).eqNullSafe(F.col("_name")), "left")
            .withColumns({"_kept": kept, name: F.when(kept, F.col(name)).otherwise(label)}).drop("_name", "_top"))


def long_to_wide(rows: DataFrame, key: str, column: str, value: str,
                 columns: list) -> DataFrame:
    """Long form to one column for each of the names given, missing cells 0.

    The caller names the columns, as they are part of the result's schema; rows of other
    names belong to no column.
    """
    return (rows.groupBy(key).pivot(column, columns).agg(F.sum(value))
            .na.fill(0, [str(c) for c in columns]).orderBy(key))


def keep_last(df: DataFrame, key: str | list[str], order: list) -> DataFrame:
    """One row per key, the last by ``order``.

    Spark turns ``row_number() <= 1`` into a per-partition group limit before the
    shuffle, so a key holding most rows sends one row per task and not all of them.
    """
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*[c.desc() if isinstance(c, Column) else F.desc(c)
                                            for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
