"""Operational monitoring: KPIs, distributions, registers and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.functions.clean import ACTIVE_STATES, DONE_STATES
from tickframe.functions.numbers import clean_nan, hours_avg, ratio_pct, ratio_pct_or_zero
from tickframe.plans.shape import conditional_counts, top_n_others, top_with_total, with_share

STATE_COLUMNS = {"Open": "open", "In Progress": "in_progress", "On Hold": "on_hold",
                 "Resolved": "resolved", "Closed": "closed"}
PRIORITY_COLUMNS = {1: "p1", 2: "p2", 3: "p3", 4: "p4"}

active = lambda: F.col("state").isin(ACTIVE_STATES)
done = lambda: F.col("state").isin(DONE_STATES)
met = lambda: F.count_if(F.col("made_sla_bool"))


def kpis(df: DataFrame) -> DataFrame:
    """One row of headline figures; counts are 0 and means 0 over no rows."""
    return df.agg(
        F.count_if(active()).alias("total_active"),
        F.count("*").alias("total_incidents"),
        F.count_if(F.col("priority") == 1).alias("critical_p1"),
        F.count_if(F.col("priority") == 2).alias("high_p2"),
        F.count_if(~F.col("made_sla_bool")).alias("sla_breaches"),
        ratio_pct_or_zero(met(), F.count("*")).alias("sla_compliance_pct"),
        F.coalesce(F.bround(hours_avg(where=done()), 1), F.lit(0.0)).alias("avg_mttr_hours"),
        F.coalesce(F.sum("reopen_count"), F.lit(0)).alias("reopen_count"),
        F.count_if(F.col("state") == "On Hold").alias("on_hold"),
        F.coalesce(F.sum("reassignment_count"), F.lit(0)).alias("reassignments"),
    )


def by_group(df: DataFrame) -> DataFrame:
    total = F.count_if(F.col("state").isin(list(STATE_COLUMNS)))
    return (df.where("assignment_group IS NOT NULL AND state IS NOT NULL")
            .groupBy(F.col("assignment_group").alias("group"))
            .agg(*conditional_counts("state", STATE_COLUMNS), total.alias("total"))
            .orderBy(F.desc("total"), "group"))


def by_category(df: DataFrame) -> DataFrame:
    counts = df.where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("count"))
    return with_share(counts).orderBy(F.desc("count"), "category")


def sla_kpi(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total"), met().alias("met"),
        (F.count("*") - met()).alias("breached"),
        ratio_pct_or_zero(met(), F.count("*")).alias("compliance_pct"))


def sla_kpi_by_priority(df: DataFrame) -> DataFrame:
    return (df.where(F.col("priority").isin(1, 2, 3, 4)).groupBy("priority")
            .agg(F.count("*").alias("total"), met().alias("met"),
                 ratio_pct(met(), F.count("*")).alias("compliance"))
            .withColumn("label", F.concat(F.lit("P"), F.col("priority").cast("string")))
            .select("priority", "label", "total", "met", "compliance").orderBy("priority"))


def priority_heatmap(df: DataFrame) -> DataFrame:
    known = F.col("number").isNotNull()
    counts = [F.count_if(known & (F.col("priority") == p)).alias(n)
              for p, n in PRIORITY_COLUMNS.items()]
    return (df.where("assignment_group IS NOT NULL")
            .groupBy(F.col("assignment_group").alias("group"))
            .agg(*counts, F.count_if(known & F.col("priority").isin(1, 2, 3, 4)).alias("total"))
            .orderBy(F.desc("total"), "group"))


def heatmap_top_others(df: DataFrame, n: int = 10) -> DataFrame:
    """The n busiest groups and one row for all others, named with their number."""
    folded = top_n_others(priority_heatmap(df), "group", "total",
                          [*PRIORITY_COLUMNS.values(), "total"], n)
    label = F.concat(F.lit("Others ("), F.col("folded").cast("string"), F.lit(" groups)"))
    return (folded.withColumn("group", F.when(F.col("folded") > 0, label).otherwise(F.col("group")))
            .select("group", *PRIORITY_COLUMNS.values(), "total",
                    (F.col("folded") > 0).alias("is_others"))
            .orderBy("is_others", F.desc("total"), "group"))


def heatmap_p1p2(df: DataFrame, n: int = 15) -> DataFrame:
    """Groups ranked by their P1+P2 volume."""
    return (priority_heatmap(df).withColumn("p1p2", F.col("p1") + F.col("p2"))
            .orderBy(F.desc("p1p2"), "group").limit(n))


def reopen_monthly(df: DataFrame) -> DataFrame:
    return (df.where("reopen_count > 0 AND month IS NOT NULL")
            .groupBy(F.col("month").alias("period"))
            .agg(F.sum("reopen_count").alias("reopen_count"),
                 F.count("number").alias("incident_count")).orderBy("period"))


def reopen_top(df: DataFrame, n: int = 10) -> DataFrame:
    return (df.where("reopen_count > 0")
            .select("number", "short_description", "assignment_group", "priority",
                    "reopen_count", "state")
            .orderBy(F.desc("reopen_count"), "number").limit(n))


def reopen_totals(df: DataFrame) -> DataFrame:
    again = F.col("reopen_count") > 0
    return df.agg(F.count_if(again).alias("total_reopened"),
                  F.coalesce(F.sum(F.when(again, F.col("reopen_count"))), F.lit(0))
                  .alias("total_reopen_events"))


PAGE_COLUMNS = ["number", "created", "impact_user", "assignment_group", "tower", "sdm", "category",
                "subcategory", "priority", "priority_label", "urgency", "state",
                "short_description", "made_sla", "made_sla_bool", "resolved", "reopen_count",
                "reassignment_count", "mttr_hours", "assigned_to", "resolution_code",
                "resolution_notes"]
SORTABLE = ["created", "priority", "state", "assignment_group", "category", "mttr_hours"]


def incidents_page(df: DataFrame, page: int = 1, limit: int = 50, sort_by: str = "created",
                   ascending: bool = False) -> DataFrame:
    """One page of the register, nulls last. Deep pages: use ``incidents_after``."""
    c = sort_by if sort_by in SORTABLE else "created"
    first = F.asc_nulls_last(c) if ascending else F.desc_nulls_last(c)
    return (df.select(*PAGE_COLUMNS).withColumn("mttr_hours", clean_nan("mttr_hours"))
            .orderBy(first, "number").offset((page - 1) * limit).limit(limit))


def incidents_after(df: DataFrame, created, number: str, limit: int = 50) -> DataFrame:
    """The page that follows a given row, newest first: no skipped rows to sort."""
    t = F.lit(created).cast("timestamp")
    later = (F.col("created") < t) | ((F.col("created") == t) & (F.col("number") > number))
    return (df.where(later).select(*PAGE_COLUMNS)
            .orderBy(F.desc("created"), "number").limit(limit))


def incidents_page_total(df: DataFrame, limit: int = 50) -> DataFrame:
    n = F.count("*")
    return df.agg(n.alias("total"),
                  F.greatest(F.lit(1), F.ceil(n / F.lit(limit))).cast("long").alias("total_pages"))


def _top_share(df: DataFrame, column: str, n: int) -> DataFrame:
    named = df.where(F.trim(column) != "")
    return (top_with_total(named, column, [F.count("*").alias("count")], "count", n)
            .withColumn("percentage", ratio_pct(F.col("count"), F.col("_total"))).drop("_total")
            .orderBy(F.desc("count"), column))


def top_services(df: DataFrame, n: int = 10) -> DataFrame:
    """Shares are of all tickets with a service, not of the n shown."""
    return _top_share(df, "service_offering", n)


def resolution_codes(df: DataFrame, n: int = 12) -> DataFrame:
    return _top_share(df, "resolution_code", n)


def monthly_volume(df: DataFrame) -> DataFrame:
    return (df.where("month IS NOT NULL").groupBy(F.col("month").alias("period"))
            .agg(F.count("number").alias("total"), F.count_if(done()).alias("resolved"),
                 F.count_if(F.col("reopen_count") > 0).alias("reopened"),
                 F.bround(hours_avg(), 1).alias("avg_mttr")).orderBy("period"))


def _owner_summary(df: DataFrame, owner: str) -> DataFrame:
    return (df.where(F.trim(owner) != "").groupBy(owner)
            .agg(F.count("*").alias("n"), met().alias("met"),
                 F.coalesce(F.bround(hours_avg(where=done()), 1), F.lit(0.0)).alias("avg_mttr")))


def tower_summary(df: DataFrame) -> DataFrame:
    s = _owner_summary(df, "tower")
    return s.select("tower", F.col("n").alias("total_incidents"),
                    (F.col("n") - F.col("met")).alias("sla_breached"),
                    ratio_pct(F.col("met"), F.col("n")).alias("compliance_pct"), "avg_mttr") \
        .orderBy(F.desc("total_incidents"), "tower")


def sdm_summary(df: DataFrame) -> DataFrame:
    s = _owner_summary(df, "sdm")
    return s.select("sdm", F.col("n").alias("assignments"), "avg_mttr",
                    ratio_pct(F.col("met"), F.col("n")).alias("performance")) \
        .orderBy(F.desc("assignments"), "sdm")


def last_updated(df: DataFrame, n: int = 15) -> DataFrame:
    return (df.where("updated IS NOT NULL")
            .select("number", "updated", "state", "assignment_group", "short_description",
                    "priority", "updated_by")
            .orderBy(F.desc("updated"), "number").limit(n))
