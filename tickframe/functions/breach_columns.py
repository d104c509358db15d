"""Columns derived from an open-ticket SLA snapshot, relative to ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import hours_between

# Contract hours, labels and limits.
SLA_RESOLUTION_HOURS = {1: 4, 2: 8, 3: 72, 4: 120}
URGENCY_ORDER = ["Already Breached", "On Hold (Paused)", "Breaching <4h", "Breaching Today",
                 "Breaching This Week", "Breaching Later"]
SEVERITY_ORDER = ["Breached", "Critical (90–100%)", "At Risk (75–90%)",
                  "Caution (50–75%)", "Healthy (<50%)"]
# End of fixed values.


def at(as_of) -> Column:
    """``as_of`` (text, datetime or Column) as a timestamp column."""
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp")


def sla_hours(priority: Column) -> Column:
    pairs = [F.lit(x) for kv in SLA_RESOLUTION_HOURS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), priority), F.lit(120))


def breach_flags() -> dict[str, Column]:
    return {
        "already_breached": F.col("business_elapsed_percentage") >= 100,
        "on_hold": F.coalesce(F.trim("state") == "On Hold", F.lit(False)),
        "has_bug_link": F.trim(F.coalesce("internal_id", F.lit(""))) != "",
    }


def overdue_remaining() -> dict[str, Column]:
    pct, hours = F.col("business_elapsed_percentage"), F.col("sla_resolution_hours")
    late = F.col("already_breached")
    return {
        "overdue_biz_hours":
            F.when(late, F.bround((pct - 100.0) / 100.0 * hours, 1)).otherwise(0.0),
        "remaining_biz_hours":
            F.when(~late, F.bround((100.0 - pct) / 100.0 * hours, 1)).otherwise(0.0),
    }


def assignment_age(as_of) -> Column:
    held = hours_between("last_assignment_date", at(as_of))
    return F.when(held.isNotNull(), F.bround(F.greatest(held, F.lit(0.0)), 1))


def urgency() -> Column:
    left = F.col("remaining_biz_hours")
    return (F.when(F.col("already_breached"), URGENCY_ORDER[0])
            .when(F.col("on_hold"), URGENCY_ORDER[1])
            .when(left <= 4, URGENCY_ORDER[2])
            .when(left <= 24, URGENCY_ORDER[3])
            .when(left <= 72, URGENCY_ORDER[4])
            .otherwise(URGENCY_ORDER[5]))


def sla_severity(pct: Column) -> Column:
    return (F.when(pct >= 100, SEVERITY_ORDER[0]).when(pct >= 90, SEVERITY_ORDER[1])
            .when(pct >= 75, SEVERITY_ORDER[2]).when(pct >= 50, SEVERITY_ORDER[3])
            .otherwise(SEVERITY_ORDER[4]))


def derive_breach(df: DataFrame, as_of) -> DataFrame:
    """All derived snapshot columns on typed input columns."""
    priority = F.coalesce(
        F.nullif(F.regexp_extract("priority", r"^(\d)", 1), F.lit("")).try_cast("int"), F.lit(4))
    return (
        df.withColumn("priority_num", priority)
        .withColumns({"sla_resolution_hours": sla_hours(F.col("priority_num")), **breach_flags()})
        .withColumns({
            **overdue_remaining(),
            "assignment_age_h": assignment_age(as_of),
            "breach_date": F.date_format("breach_time", "yyyy-MM-dd"),
            "sla_severity": sla_severity(F.col("business_elapsed_percentage")),
        })
        .withColumn("urgency", urgency())
    )
