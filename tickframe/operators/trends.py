"""Trends over day, week or month; forecast; root causes; reassignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.functions.numbers import HOURS, fixed_sum, hours_avg, mean_of, ratio_pct
from tickframe.plans.shape import conditional_counts, fold_others, top_n_others

PERIODS = {"day": "date", "week": "week", "month": "month"}


def period_column(granularity: str) -> str:
    return PERIODS.get(granularity, "month")


def _by_period(df: DataFrame, granularity: str, *keys) -> DataFrame:
    c = F.col(period_column(granularity))
    rows = df.where(c.isNotNull() & (c != "Unknown"))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows.withColumn("period", c)


def volume(df: DataFrame, granularity: str = "month") -> DataFrame:
    """Tickets per period and group, with the period's total."""
    counts = (_by_period(df, granularity, "assignment_group")
              .groupBy("period", F.col("assignment_group").alias("group"))
              .agg(F.count("*").alias("count")))
    return (counts.withColumn("total", F.sum("count").over(Window.partitionBy("period")))
            .orderBy("period", "group"))


def mttr(df: DataFrame, granularity: str = "month") -> DataFrame:
    """Mean hours (> 0 only) per period and group, and per period.

    The overall mean comes from the groups' sums, so the tickets are read once
    and shuffled once.
    """
    sums = (_by_period(df, granularity).where("mttr_hours > 0")
            .groupBy("period", F.col("assignment_group").alias("group"))
            .agg(fixed_sum("mttr_hours", HOURS).alias("s"), F.count("*").alias("n")))
    w = Window.partitionBy("period")
    return (sums.withColumn("overall_avg", F.bround(
                mean_of(F.sum("s").over(w), F.sum("n").over(w), HOURS), 1))
            .withColumn("avg_mttr", F.bround(mean_of(F.col("s"), F.col("n"), HOURS), 1))
            .where("group IS NOT NULL")
            .select("period", "group", "avg_mttr", "overall_avg").orderBy("period", "group"))


def category(df: DataFrame, granularity: str = "month") -> DataFrame:
    return (_by_period(df, granularity, "category").groupBy("period", "category")
            .agg(F.count("*").alias("count")).orderBy("period", "category"))


def sla(df: DataFrame, granularity: str = "month") -> DataFrame:
    total, met = F.count("number"), F.count_if("made_sla_bool")
    return (_by_period(df, granularity).groupBy("period")
            .agg(total.alias("total"), met.alias("met"), (total - met).alias("breached"),
                 ratio_pct(met, total).alias("compliance_pct")).orderBy("period"))


def priority(df: DataFrame, granularity: str = "month") -> DataFrame:
    return (_by_period(df, granularity).groupBy("period")
            .agg(*conditional_counts("priority", {1: "P1", 2: "P2", 3: "P3", 4: "P4"}))
            .orderBy("period"))


def heatmap_dow_hour(df: DataFrame) -> DataFrame:
    """Tickets per weekday (Monday first) and hour."""
    day = F.weekday("created")
    return (df.where("dow IS NOT NULL").groupBy("dow", "hour")
            .agg(F.count("*").alias("count"), F.min(day).alias("dow_order"))
            .orderBy("dow_order", "hour"))


def reassign_by_group(df: DataFrame) -> DataFrame:
    return (df.where("assignment_group IS NOT NULL")
            .groupBy(F.col("assignment_group").alias("group"))
            .agg(F.bround(F.sum("reassignment_count") / F.count("reassignment_count"), 2)
                 .alias("avg_reassignments"),
                 F.count("number").alias("total_incidents"),
                 F.count_if(F.col("reassignment_count") >= 3).alias("high_reassignment"))
            .orderBy("group"))


def reassign_scatter(df: DataFrame, n: int = 500, below_hours: float = 500) -> DataFrame:
    """A repeatable sample of points: the n smallest hashes of the ticket number."""
    return (df.where(F.col("mttr_hours") < below_hours)
            .select("number", "mttr_hours", "reassignment_count", "priority",
                    F.col("assignment_group").alias("group"), "category")
            .orderBy(F.md5("number"), "number").limit(n))


def reassign_bucket(df: DataFrame) -> DataFrame:
    """0, 1, 2 and 3+ reassignments: tickets, breach % and mean hours, whole numbers."""
    rc = F.coalesce("reassignment_count", F.lit(0))
    label = (F.when(rc == 0, "0 (First Try)").when(rc == 1, "1 Reassign")
             .when(rc == 2, "2 Reassigns").otherwise("3+ Reassigns"))
    breached = F.count_if(~F.col("made_sla_bool"))

    def half_up(x):
        return F.floor(x + 0.5).cast("long")

    return (df.where(rc >= 0).groupBy(label.alias("label"))
            .agg(F.count("*").alias("total"),
                 half_up(F.lit(100.0) * breached / F.count("*")).alias("breach_pct"),
                 F.coalesce(half_up(hours_avg(where=F.col("mttr_hours") > 0)), F.lit(0))
                 .alias("avg_mttr"))
            .orderBy("label"))


def monthly_counts(df: DataFrame) -> DataFrame:
    return _by_period(df, "month").groupBy("period").agg(F.count("*").alias("count"))


def forecast(df: DataFrame, periods: int = 6) -> DataFrame:
    """Observed months, then a weighted linear trend times a month-of-year factor.

    Weights run evenly from 0.5 to 1 and enter the least-squares fit squared. Tickets
    are read once; everything after the monthly count is a window over one row per
    month, and the last month's row unfolds into the months to come.
    """
    whole, in_order = Window.partitionBy(), Window.partitionBy().orderBy("period")
    months = monthly_counts(df).select(
        "period", "count", (F.row_number().over(in_order) - 1).cast("double").alias("x"),
        F.count("*").over(whole).alias("m"), F.col("count").cast("double").alias("y"),
        F.substring("period", 6, 2).cast("int").alias("mon"))
    weight = F.lit(0.5) + F.col("x") * F.try_divide(F.lit(0.5), F.col("m") - 1)
    months = months.withColumns({"w": weight * weight, "mean": F.avg("y").over(whole),
                                 "season": F.avg("y").over(Window.partitionBy("mon"))})
    sw = F.sum("w").over(whole)
    months = months.withColumns({
        "xm": F.sum(F.col("w") * F.col("x")).over(whole) / sw, "ym": F.sum(F.col("w") * F.col("y")).over(whole) / sw,
        # At most twelve entries: the mean of each month of the year.
        "seasons": F.map_from_entries(F.collect_set(F.struct("mon", "season")).over(whole))})
    dx = F.col("x") - F.col("xm")
    months = months.withColumn("slope", F.try_divide(
        F.sum(F.col("w") * dx * (F.col("y") - F.col("ym"))).over(whole), F.sum(F.col("w") * dx * dx).over(whole)))

    def row(period, count, lower, upper, kind):
        return F.struct(period.alias("period"), count.cast("long").alias("count"), lower.cast("double").alias("ci_lower"),
                        upper.cast("double").alias("ci_upper"), F.lit(kind).alias("type"))

    def future(i: Column) -> Column:
        month = F.add_months(F.to_date(F.concat("period", F.lit("-01"))), i)
        trend = F.greatest(F.lit(0.0), F.col("ym") + F.col("slope") * (F.col("m") + i - 1 - F.col("xm")))
        factor = F.coalesce(F.try_element_at("seasons", F.month(month)) / F.col("mean"), F.lit(1.0))
        pred = F.bround(trend * factor, 0)
        band = F.bround(pred * 0.12, 0)
        return row(F.date_format(month, "yyyy-MM"), pred, F.greatest(F.lit(0.0), pred - band), pred + band, "forecast")

    actual = F.array(row(F.col("period"), F.col("count"), F.lit(None), F.lit(None), "actual"))
    last = (F.col("x") == F.col("m") - 1) & (F.col("m") >= 3) & F.col("slope").isNotNull()
    ahead = F.transform(F.sequence(F.lit(1), F.lit(periods)), future)
    return months.select(F.inline(F.when(last, F.concat(actual, ahead)).otherwise(actual))).orderBy("period")


def root_cause(df: DataFrame) -> DataFrame:
    """Category and subcategory counts with the category's total."""
    counts = (df.where("category IS NOT NULL AND subcategory IS NOT NULL")
              .groupBy("category", "subcategory").agg(F.count("*").alias("count")))
    w = Window.partitionBy("category")
    return (counts.withColumn("category_total", F.sum("count").over(w))
            .withColumn("rank", F.row_number().over(w.orderBy(F.desc("count"), "subcategory")))
            .orderBy(F.desc("category_total"), "category", "rank"))


def root_cause_tree(df: DataFrame) -> DataFrame:
    """The same as one row per category with its children, largest first."""
    child = F.struct((-F.col("count")).alias("o"), F.col("subcategory").alias("name"), F.col("count"))
    return (root_cause(df).groupBy(F.col("category").alias("name"))
            .agg(F.sum("count").alias("total"),
                 F.transform(F.sort_array(F.collect_list(child)),
                             lambda c: F.struct(c["name"].alias("name"), c["count"].alias("count")))
                 .alias("children"))
            .orderBy(F.desc("total"), "name"))


def _named_group():
    return F.when(F.coalesce("assignment_group", F.lit("")) == "", "Unknown").otherwise(F.col("assignment_group"))


def volume_by_group(df: DataFrame, n: int = 10) -> DataFrame:
    counts = df.groupBy(_named_group().alias("name")).agg(F.count("*").alias("count"))
    return top_n_others(counts, "name", "count", ["count"], n).orderBy("folded", F.desc("count"), "name")


def mttr_by_group(df: DataFrame, n: int = 10, min_rows: int = 2) -> DataFrame:
    """Slowest groups. Means are not added up into an "Others" row."""
    return (df.where("mttr_hours >= 0").groupBy(_named_group().alias("name"))
            .agg(F.bround(hours_avg(), 1).alias("mttr"), F.count("*").alias("count"))
            .where(F.col("count") >= min_rows).orderBy(F.desc("mttr"), "name").limit(n))


def series_top_n(df: DataFrame, n: int = 10, granularity: str = "month") -> DataFrame:
    """Period x group series with all but the n largest groups folded into Others."""
    counts = (_by_period(df, granularity, "assignment_group")
              .groupBy("period", F.col("assignment_group").alias("group"))
              .agg(F.count("*").alias("count")))
    largest = counts.groupBy("group").agg(F.sum("count").alias("all"))
    return (fold_others(counts, largest, "group", "all", n).groupBy("period", "group")
            .agg(F.sum("count").alias("count")).orderBy("period", "group"))
