"""Ranks and exact quantiles of any number of rows, without a task that sees them all.

Rows are dealt to the tasks by ranges of their order and sorted there. What must be known across tasks is
how many rows each task holds: one number a task. The sorted rows are stored once, as the counts
and the rows must come from the same ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.session import stored

#: ``monotonically_increasing_id`` is the task's number times 2^33 plus the row's number there.
TASK_BITS = 33


def _sorted(rows: DataFrame, order: list[Column]) -> DataFrame:
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "sorted").withColumn(
        "_task", F.shiftright("_at", TASK_BITS))


def numbered(rows: DataFrame, order: list[Column], name: str = "rank", within: str | None = None) -> DataFrame:
    """``rows`` with their place in the order, from 1; with ``within``, in their group (few, large groups)."""
    own = [F.col(within).asc_nulls_first()] if within else []
    placed = _sorted(rows, [*own, *order])
    before = Window.partitionBy().orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = placed.groupBy("_task").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    local = F.col("_at") - F.shiftleft("_task", TASK_BITS)
    out = placed.join(tasks.drop("_n"), "_task").withColumn(name, F.col("_before") + local + 1)
    if within:
        # A group's first row: the place before it is taken off.
        first = (placed.join(tasks.drop("_n"), "_task").groupBy(F.col(within).alias("_group"))
                 .agg(F.min(F.col("_before") + local).alias("_first")))
        out = out.join(first, F.col(within).eqNullSafe(F.col("_group"))).withColumn(name, F.col(name) - F.col("_first")).drop("_group", "_first")
    return out.drop("_at", "_task", "_before")


def quantiles(rows: DataFrame, segment: list[str], value: str, shares: dict[str, float], count: str = "n") -> DataFrame:
    """``segment`` columns, ``count`` of values, and for each name of ``shares`` that quantile, interpolated.

    By selection: values are counted per segment (before they are shuffled), sorted over all tasks, and only
    the stretch of a task that holds a wanted place is summed up row by row. No buffer holds the values of
    a segment. Null values are left out.
    """
    key = F.struct(*segment).alias("_seg")
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = _sorted(counts, [F.col("_seg"), F.col("_v")])
    parts = placed.groupBy("_seg", "_task").agg(F.sum("_n").alias("_size"))
    over = Window.partitionBy("_seg").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_start", F.coalesce(F.sum("_size").over(over), F.lit(0)))
    totals = parts.groupBy("_seg").agg(F.sum("_size").alias(count))
    wanted = totals.select("_seg", F.inline(F.array(*[
        F.struct(F.lit(name).alias("_name"), (F.col(count) - 1).cast("double").alias("_last"), F.lit(p).alias("_p")) for name, p in shares.items()])))
    at = F.col("_last") * F.col("_p")
    low = F.floor(at)
    wanted = wanted.select("_seg", "_name", F.inline(F.array(
        F.struct(low.alias("_rank"), (1 - (at - low)).alias("_weight")), F.struct((low + 1).alias("_rank"), (at - low).alias("_weight"))))
    ).where("_weight > 0")
    places = (wanted.join(parts, "_seg").where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_size")))
              .select("_seg", "_task", "_name", "_weight", (F.col("_rank") - F.col("_start")).alias("_in")))
    running = Window.partitionBy("_seg", "_task").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = placed.join(places.select("_seg", "_task").distinct(), ["_seg", "_task"], "left_semi").withColumn("_upto", F.sum("_n").over(running))
    picked = near.join(places, ["_seg", "_task"]).where((F.col("_in") < F.col("_upto")) & (F.col("_in") >= F.col("_upto") - F.col("_n")))
    found = picked.groupBy("_seg").agg(*[
        F.sum(F.when(F.col("_name") == name, F.col("_v") * F.col("_weight"))).alias(name) for name in shares])
    return totals.join(found, "_seg").select("_seg.*", count, *shares)
