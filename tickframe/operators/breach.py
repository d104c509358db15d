"""SLA-breach risk over the snapshot of open tickets (see functions.breach_columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.functions.breach_columns import SLA_RESOLUTION_HOURS, at
from tickframe.functions.buckets import (
    AGE_EDGES, AGE_LABELS, ELAPSED_EDGES, ELAPSED_LABELS, HOLD_EDGES, HOLD_LABELS,
    HOLD_RISK_LABELS, bucket_rank, bucketize,
)
from tickframe.functions.clean import agent_name, hours_between
from tickframe.functions.numbers import clean_nan_zero, fixed_avg, ratio_pct
from tickframe.plans.shape import conditional_counts, top_with_total
from tickframe.schema import SLA_CONTRACT

ELAPSED = "business_elapsed_percentage"
STATE_COLUMNS = {"On Hold": "on_hold", "In Progress": "in_progress"}


def _mean(c, where: Column | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.bround(fixed_avg(F.when(where, c) if where is not None else c), 1)


def _mean0(c, where: Column | None = None) -> Column:
    return F.coalesce(_mean(c, where), F.lit(0.0))


def _late() -> Column:
    return F.count_if("already_breached")


def days_open(as_of) -> Column:
    return F.greatest(hours_between("created", at(as_of)) / 24.0, F.lit(0.0))


def kpis(df: DataFrame, as_of) -> DataFrame:
    """One row of risk figures; shares are null over no rows."""
    late, hold, pct = F.col("already_breached"), F.col("on_hold"), F.col(ELAPSED)
    n = F.count("*")
    return df.agg(
        n.alias("total"), _late().alias("already_breached"),
        ratio_pct(_late(), n).alias("breached_pct"),
        F.count_if(hold).alias("on_hold"), ratio_pct(F.count_if(hold), n).alias("on_hold_pct"),
        F.count_if(hold & (pct >= 75)).alias("hold_restart_risk"),
        F.count_if(F.col("priority_num") <= 2).alias("critical_high"),
        F.count_if(~late & ~hold & (F.col("remaining_biz_hours") <= 24)).alias("breaching_24h"),
        _mean0(ELAPSED).alias("avg_elapsed_pct"),
        _mean0("overdue_biz_hours", late).alias("avg_overdue_hours"),
        _mean0("assignment_age_h").alias("avg_assignment_age_h"),
        F.count_if("has_bug_link").alias("bug_linked"),
        F.count_if(days_open(as_of) > 30).alias("over_30_days"),
        F.lit(95.0).alias("aging_kpi_target_pct"),
    )


def _breakdown(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(c).agg(F.count("*").alias("count")).orderBy(F.desc("count"), c)


def urgency_breakdown(df: DataFrame) -> DataFrame:
    return _breakdown(df, "urgency")


def severity_breakdown(df: DataFrame) -> DataFrame:
    return _breakdown(df, "sla_severity")


def timeline(df: DataFrame, as_of, days_back: int = 7, days_ahead: int = 14) -> DataFrame:
    """Breach dates from a week ago to two weeks ahead."""
    today = F.to_date(at(as_of))
    day = F.to_date("breach_time")
    rows = df.where(day.between(F.date_sub(today, days_back), F.date_add(today, days_ahead)))
    today_text = F.date_format(today, "yyyy-MM-dd")
    n = F.count("task")
    return (rows.groupBy(F.col("breach_date").alias("date"))
            .agg(n.alias("count"), _late().alias("already_breached"),
                 F.greatest(n - _late(), F.lit(0)).alias("upcoming"))
            .withColumns({"is_today": F.col("date") == today_text,
                          "is_past": F.col("date") < today_text,
                          "is_future": F.col("date") > today_text}).orderBy("date"))


def sla_compliance(df: DataFrame) -> DataFrame:
    """Per priority against the contract's hours."""
    n = F.count("*")
    hours = F.create_map(*[F.lit(x) for p, h in SLA_RESOLUTION_HOURS.items() for x in (p, h)])
    labels = F.create_map(*[F.lit(x) for row in SLA_CONTRACT for x in (row[0], row[4])])
    p = F.col("priority")
    return (df.where(F.col("priority_num").isin(1, 2, 3, 4))
            .groupBy(F.col("priority_num").alias("priority"))
            .agg(n.alias("total"), (n - _late()).alias("compliant"), _late().alias("breached"),
                 ratio_pct(n - _late(), n).alias("compliance_pct"),
                 _mean0(ELAPSED).alias("avg_elapsed_pct"),
                 _mean0("overdue_biz_hours", F.col("already_breached")).alias("avg_overdue_hours"))
            .withColumns({"sla_label": labels[p], "sla_hours": hours[p],
                          "sla_target": F.concat(hours[p].cast("string"), F.lit("h"))})
            .orderBy("priority"))


def by_service(df: DataFrame, n: int = 12) -> DataFrame:
    """Pareto of services; shares are of all tickets, those without a service included."""
    aggs = [F.count("*").alias("count"), _late().alias("already_breached"), _mean(ELAPSED).alias("avg_elapsed_pct"),
            F.count_if("on_hold").alias("on_hold_count"), _mean0("overdue_biz_hours").alias("avg_overdue_hours")]
    top = top_with_total(df, "service_offering", aggs, "count", n)
    running = F.sum("count").over(Window.partitionBy().orderBy(F.desc("count"), "service_offering")
                                  .rowsBetween(Window.unboundedPreceding, 0))
    return (top.withColumn("pct_total", ratio_pct(F.col("count"), F.col("_total")))
            .withColumn("cumulative_pct", ratio_pct(running, F.col("_total")))
            .drop("_total").orderBy(F.desc("count"), "service_offering"))


def by_group(df: DataFrame) -> DataFrame:
    """State counts and group figures in one pass; total counts the two states only."""
    return (df.where("assignment_group IS NOT NULL AND state IS NOT NULL")
            .groupBy(F.col("assignment_group").alias("group"))
            .agg(*conditional_counts("state", STATE_COLUMNS),
                 F.count_if(F.col("state").isin(list(STATE_COLUMNS))).alias("total"),
                 _mean(ELAPSED).alias("avg_elapsed_pct"), _late().alias("already_breached"),
                 F.count_if(F.col("priority_num") <= 2).alias("critical_high"),
                 _mean0("assignment_age_h").alias("avg_assignment_age_h"))
            .orderBy(F.desc("total"), "group"))


def elapsed_distribution(df: DataFrame) -> DataFrame:
    """Bin x group counts and bin totals; 0 % itself is outside all bins."""
    counts = (df.where("assignment_group IS NOT NULL")
              .withColumn("range", bucketize(ELAPSED, ELAPSED_EDGES, ELAPSED_LABELS))
              .where("range IS NOT NULL").groupBy("range", F.col("assignment_group").alias("group"))
              .agg(F.count("*").alias("count")))
    return (counts.withColumn("total", F.sum("count").over(Window.partitionBy("range")))
            .withColumn("range_order", bucket_rank("range", ELAPSED_LABELS))
            .orderBy("range_order", "group"))


def _held(df: DataFrame) -> DataFrame:
    return df.where("assignment_age_h IS NOT NULL")


def age_distribution(df: DataFrame) -> DataFrame:
    return (_held(df).withColumn("bucket", bucketize("assignment_age_h", AGE_EDGES, AGE_LABELS))
            .where("bucket IS NOT NULL").groupBy("bucket")
            .agg(*conditional_counts("state", STATE_COLUMNS),
                 F.count_if(F.col("state").isin(list(STATE_COLUMNS))).alias("total"))
            .withColumn("bucket_order", bucket_rank("bucket", AGE_LABELS)).orderBy("bucket_order"))


def age_by_group(df: DataFrame) -> DataFrame:
    return (_held(df).where("assignment_group IS NOT NULL")
            .groupBy(F.col("assignment_group").alias("group"))
            .agg(_mean("assignment_age_h").alias("avg_age_h"),
                 F.bround(F.max("assignment_age_h"), 1).alias("max_age_h"),
                 F.count_if(F.col("assignment_age_h") > 168).alias("over_7d"),
                 F.count("task").alias("count")).orderBy("group"))


def age_by_agent(df: DataFrame, n: int = 10) -> DataFrame:
    """Agents holding their tickets longest; ranked on the unrounded mean."""
    return (_held(df).where("assigned_to IS NOT NULL")
            .groupBy(agent_name("assigned_to").alias("agent_name"))
            .agg(fixed_avg("assignment_age_h").alias("mean"),
                 F.bround(F.max("assignment_age_h"), 1).alias("max_age_h"),
                 F.count("task").alias("count"), _late().alias("already_breached"))
            .orderBy(F.desc("mean"), "agent_name").limit(n)
            .select("agent_name", F.bround("mean", 1).alias("avg_age_h"), "max_age_h", "count",
                    "already_breached"))


def age_overall(df: DataFrame) -> DataFrame:
    return _held(df).agg(
        _mean0("assignment_age_h").alias("overall_avg_age_h"),
        clean_nan_zero(F.max("assignment_age_h")).alias("overall_max_age_h"),
        F.count_if(F.col("assignment_age_h") > 168).alias("over_7d_count"))


def reassign_impact(df: DataFrame) -> DataFrame:
    return (df.where("reassignment_count IS NOT NULL").groupBy("reassignment_count")
            .agg(F.count("task").alias("count"), _mean(ELAPSED).alias("avg_elapsed_pct"),
                 ratio_pct(_late(), F.count("*")).alias("breach_rate"),
                 _mean0("assignment_age_h").alias("avg_assignment_age_h"))
            .orderBy("reassignment_count"))


def priority_breakdown(df: DataFrame) -> DataFrame:
    number = F.split_part("priority", F.lit(" "), F.lit(1)).try_cast("int")
    hours = F.create_map(*[F.lit(x) for row in SLA_CONTRACT for x in (row[0], row[3])])
    labels = F.create_map(*[F.lit(x) for row in SLA_CONTRACT for x in (row[0], row[4])])
    return (df.where("priority IS NOT NULL").groupBy("priority")
            .agg(F.count("task").alias("count"), _late().alias("already_breached"),
                 _mean(ELAPSED).alias("avg_elapsed_pct"),
                 _mean0("overdue_biz_hours").alias("avg_overdue_hours"),
                 ratio_pct(_late(), F.count("task")).alias("breach_rate"))
            .withColumns({
                "sla_resolution_label": F.coalesce(F.try_element_at(labels, number), F.lit("Unknown")),
                "sla_resolution_hours": F.coalesce(F.try_element_at(hours, number), F.lit(0))})
            .orderBy("priority"))


def hold_days(as_of) -> Column:
    """Days on hold; an unknown start counts as 0."""
    days = hours_between("stop_time", at(as_of)) / 24.0
    return F.bround(F.greatest(F.coalesce(days, F.lit(0.0)), F.lit(0.0)), 1)


def on_hold_summary(df: DataFrame, as_of) -> DataFrame:
    """Here "in progress" is everything not on hold."""
    hold = F.col("on_hold")
    return df.agg(
        F.count_if(hold).alias("total_on_hold"), F.count_if(~hold).alias("total_in_progress"),
        ratio_pct(F.count_if(hold), F.count("*")).alias("on_hold_pct"),
        _mean0(hold_days(as_of), hold).alias("avg_hold_days"),
        _mean0(ELAPSED, hold).alias("avg_elapsed_on_hold"),
        _mean0(ELAPSED, ~hold).alias("avg_elapsed_in_prog"),
        F.count_if(hold & (F.col(ELAPSED) >= 75)).alias("restart_risk_count"))


def hold_age(df: DataFrame, as_of) -> DataFrame:
    return (df.where("on_hold").withColumn("age_bucket", bucketize(hold_days(as_of), HOLD_EDGES, HOLD_LABELS))
            .where("age_bucket IS NOT NULL").groupBy("age_bucket").agg(F.count("*").alias("count"))
            .withColumn("is_risk", F.col("age_bucket").isin(HOLD_RISK_LABELS))
            .withColumn("bucket_order", bucket_rank("age_bucket", HOLD_LABELS))
            .orderBy("bucket_order"))


def hold_by_group(df: DataFrame) -> DataFrame:
    return (df.where("assignment_group IS NOT NULL AND state IS NOT NULL")
            .groupBy(F.col("assignment_group").alias("group"))
            .agg(*conditional_counts("state", STATE_COLUMNS)).orderBy("group"))


def kpi_scorecard(df: DataFrame, as_of) -> DataFrame:
    """Four contract KPIs with their verdicts, from one aggregation."""
    n = F.count("*")
    p, late = F.col("priority_num"), F.col("already_breached")
    one = df.agg(
        n.alias("n"), F.count_if(days_open(as_of) > 30).alias("over_30"),
        F.coalesce(F.sum("reopen_count"), F.lit(0)).alias("reopens"),
        F.count_if("has_bug_link").alias("bugs"),
        F.count_if(late & (p == 1)).alias("p1"), F.count_if(late & (p == 2)).alias("p2"),
        F.count_if(late & (p <= 2)).alias("p12"))
    within = F.bround(100.0 * (1.0 - F.try_divide(F.col("over_30").cast("double"), F.col("n"))), 1)
    reopen = F.bround(100.0 * F.col("reopens") / F.greatest(F.col("n"), F.lit(1)), 2)
    none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")

    def row(kpi, label, target, target_pct, actual, count, status):
        return F.struct(F.lit(kpi).alias("kpi"), F.lit(label).alias("label"),
                        target.alias("target"), target_pct.alias("target_pct"),
                        actual.alias("actual_pct"), count.alias("count"), status.alias("status"))

    def verdict(ok):
        return F.when(ok, "PASS").otherwise("FAIL")

    return one.select(F.inline(F.array(
        row("aging_kpi", "Tickets Aging", F.lit("95% resolved ≤30 days"), F.lit(95.0), within,
            F.col("over_30"), verdict(within >= 95)),
        row("first_time_right", "First Time Right", F.lit("Reopen ≤1% of closed"), F.lit(1.0), reopen,
            F.col("reopens"), verdict(reopen <= 1.0)),
        row("bug_linked", "Bug-Linked (Change needed)", none_s, none_d,
            ratio_pct(F.col("bugs"), F.col("n")), F.col("bugs"), none_s),
        row("p1_breach", "P1/P2 SLA Breach", F.lit("Zero tolerance — P1 4h, P2 8h"), none_d, none_d,
            F.col("p1"), verdict(F.col("p12") == 0)),
        row("p2_breach", "P1/P2 SLA Breach", F.lit("Zero tolerance — P1 4h, P2 8h"), none_d, none_d,
            F.col("p2"), verdict(F.col("p12") == 0)),
    )))
