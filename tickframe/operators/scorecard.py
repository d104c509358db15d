"""Service scorecards: the twelve contract metrics, agents, months, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.functions.breach_columns import at
from tickframe.functions.clean import ACTIVE_STATES, hours_between
from tickframe.functions.numbers import fixed_avg, hours_avg, ratio_pct, ratio_pct_or_zero
from tickframe.schema import AM_METRICS


def rag(actual: Column, target: Column, threshold: Column) -> Column:
    return F.when(actual >= target, "green").when(actual >= threshold, "amber").otherwise("red")


def _fixed_first_time() -> Column:
    return (F.col("reassignment_count") == 0) & (F.col("reopen_count") == 0)


def _scope(metric_id: str, priority: int | None) -> Column:
    if priority is not None:
        return F.col("priority") == priority
    is_access = F.coalesce(F.contains(F.lower("category"), F.lit("access")), F.lit(False))
    return {"AM.09": is_access, "AM.10": ~is_access}.get(metric_id, F.lit(True))


def _counts(metric_id: str, priority: int | None, window_h: int | None, as_of) -> tuple[Column, Column]:
    """(total, met) of a metric as aggregates over all tickets."""
    scope, hours = _scope(metric_id, priority), F.col("mttr_hours")
    if metric_id == "AM.17":
        return F.count_if(scope), F.count_if(scope & _fixed_first_time())
    if metric_id == "AM.18":
        young = hours_between("created", at(as_of)) <= window_h
        return F.count_if(scope), F.count_if(scope & F.coalesce(hours <= window_h, young, F.lit(False)))
    measured = F.count_if(scope & hours.isNotNull())
    return (F.when(measured > 0, measured).otherwise(F.count_if(scope)),
            F.when(measured > 0, F.count_if(scope & F.coalesce(hours <= window_h, F.lit(False))))
            .otherwise(F.count_if(scope & F.col("made_sla_bool"))))


def summary(df: DataFrame, as_of) -> DataFrame:
    """All metrics from one aggregation: two conditional counts each, then unpivoted."""
    aggs, rows = [], []
    for i, (mid, name, kind, priority, target, threshold, window_h, text) in enumerate(AM_METRICS):
        total, met = _counts(mid, priority, window_h, as_of)
        aggs += [total.alias(f"t{i}"), met.alias(f"m{i}")]
        rows.append(F.struct(
            F.lit(mid).alias("id"), F.lit(name).alias("name"), F.lit(kind).alias("type"),
            F.lit(target).alias("target"), F.lit(threshold).alias("threshold"),
            F.lit(text).alias("description"), F.col(f"t{i}").alias("total"),
            F.col(f"m{i}").alias("met")))
    long = df.agg(*aggs).select(F.inline(F.array(*rows)))
    return (long.withColumn("not_met", F.col("total") - F.col("met"))
            .withColumn("actual", ratio_pct_or_zero(F.col("met"), F.col("total")))
            .withColumn("rag", rag(F.col("actual"), F.col("target"), F.col("threshold")))
            .orderBy("id"))


def rag_counts(df: DataFrame, as_of) -> DataFrame:
    return summary(df, as_of).groupBy("rag").agg(F.count("*").alias("count")).orderBy("rag")


def _with_agent(df: DataFrame) -> DataFrame:
    return df.where(F.trim("assigned_to") != "").withColumnRenamed("assigned_to", "agent")


def by_agent(df: DataFrame, n: int = 15) -> DataFrame:
    return (_with_agent(df).groupBy("agent")
            .agg(F.count("*").alias("total"),
                 ratio_pct(F.count_if("made_sla_bool"), F.count("*")).alias("sla_pct"),
                 ratio_pct(F.count_if(_fixed_first_time()), F.count("*")).alias("ftf_pct"),
                 F.bround(hours_avg(), 1).alias("avg_mttr"))
            .orderBy(F.desc("total"), "agent").limit(n))


def _agent_priorities(df: DataFrame, n: int) -> DataFrame:
    """Top agents with an array of (priority, total, met): one aggregation, no join back."""
    p, met = F.col("priority"), F.col("made_sla_bool")
    cells = [F.struct(F.lit(i).alias("priority"), F.count_if(p == i).alias("total"),
                      F.count_if((p == i) & met).alias("met")) for i in (1, 2, 3, 4)]
    return (_with_agent(df).groupBy("agent")
            .agg(F.count("*").alias("_all"), F.array(*cells).alias("cells"))
            .orderBy(F.desc("_all"), "agent").limit(n))


def by_agent_priority(df: DataFrame, n: int = 15) -> DataFrame:
    return (_agent_priorities(df, n).select("agent", F.inline("cells")).where("total > 0")
            .withColumn("pct", ratio_pct(F.col("met"), F.col("total"))).orderBy("agent", "priority"))


def by_agent_nested(df: DataFrame, n: int = 15) -> DataFrame:
    """The dashboard's form: one row per agent with the priorities as an array."""
    cells = F.transform(
        F.filter("cells", lambda c: c["total"] > 0),
        lambda c: F.struct(c["priority"].alias("priority"), c["total"].alias("total"),
                           c["met"].alias("met"), ratio_pct(c["met"], c["total"]).alias("pct")))
    return _agent_priorities(df, n).select("agent", cells.alias("by_priority"))


def monthly(df: DataFrame) -> DataFrame:
    n = F.count("*")
    return (df.where("month IS NOT NULL").groupBy(F.col("month").alias("period"))
            .agg(n.alias("total"), ratio_pct(F.count_if("made_sla_bool"), n).alias("sla_pct"),
                 ratio_pct(F.count_if(_fixed_first_time()), n).alias("ftf_pct"),
                 F.bround(hours_avg(), 1).alias("avg_mttr")).orderBy("period"))


def group_stats(df: DataFrame) -> DataFrame:
    n = F.count("*")
    return (df.where("assignment_group IS NOT NULL")
            .groupBy(F.col("assignment_group").alias("group"))
            .agg(n.alias("total_incidents"),
                 F.count_if(F.col("state").isin(ACTIVE_STATES)).alias("active_incidents"),
                 F.bround(hours_avg(), 1).alias("avg_mttr_hours"),
                 F.bround(F.count_if("made_sla_bool") / n, 3).alias("sla_compliance"),
                 F.bround(fixed_avg("reassignment_count", 1), 2).alias("avg_reassignments"))
            .orderBy("group"))
