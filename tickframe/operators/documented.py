"""Measures that are described as formulas only: growth, bands, burndown, cost, ..."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.functions.breach_columns import at, sla_hours
from tickframe.functions.clean import ACTIVE_STATES, DONE_STATES, agent_name, hours_between
from tickframe.functions.numbers import HOURS, fixed_avg, fixed_sum, hours_avg, mean_of, ratio_pct
from tickframe.functions.rules import any_hit
from tickframe.operators.trends import mttr_by_group
from tickframe.plans.ordered import quantiles

COMPLIANCE_TARGET = 90.0


def rolling_7d(df: DataFrame, days: int = 7) -> DataFrame:
    """Daily volume and its moving average; days without tickets count as 0."""
    daily = df.where("created IS NOT NULL").groupBy(F.to_date("created").alias("day")).agg(F.count("*").alias("count"))
    # One row per day from here on; each day also stands for the empty days after it.
    w = Window.partitionBy().orderBy("day")
    gap = F.sequence("day", F.coalesce(F.date_sub(F.lead("day").over(w), 1), F.col("day")))
    filled = daily.withColumn("gap", gap).select(F.explode("gap").alias("d"), "day", "count")
    filled = filled.select(F.col("d").alias("day"),
                           F.when(F.col("d") == F.col("day"), F.col("count")).otherwise(0).alias("count"))
    back = w.rowsBetween(-(days - 1), 0)
    return (filled.withColumn("moving_avg", F.bround(F.sum("count").over(back) / F.count("*").over(back), 2))
            .select(F.date_format("day", "yyyy-MM-dd").alias("date"), "count", "moving_avg"))


def growth(df: DataFrame, flag_over: float = 20.0) -> DataFrame:
    """Month-over-month growth per category, flagged above a limit."""
    w = Window.partitionBy("category").orderBy("period")
    counts = (df.where("month IS NOT NULL AND category IS NOT NULL")
              .groupBy(F.col("month").alias("period"), "category").agg(F.count("*").alias("count")))
    prev = F.lag("count").over(w)
    g = F.bround(100.0 * (F.col("count") - prev) / prev, 1)
    return counts.withColumn("growth_pct", g).withColumn(
        "flag", F.coalesce(F.col("growth_pct") > flag_over, F.lit(False)))


def mttr_variance_slope(df: DataFrame) -> DataFrame:
    """Spread of MTTR per group and the slope of its monthly mean.

    Spread from exact integer sums of seconds; the fit runs over one row per group and month.
    """
    sec = F.round(F.col("mttr_hours") * 3600.0).cast("decimal(18,0)")
    cells = (df.where("mttr_hours IS NOT NULL AND month IS NOT NULL AND assignment_group IS NOT NULL")
             .groupBy("assignment_group", "month")
             .agg(F.count("*").alias("n"), F.sum(sec).alias("s"), F.sum(sec * sec).alias("ss")))
    w = Window.partitionBy("assignment_group").orderBy("month")
    cells = cells.withColumn("x", F.row_number().over(w).cast("double")).withColumn(
        "mean", F.col("s").cast("double") / F.col("n") / 3600.0)
    n, s, ss = F.sum("n"), F.sum("s").cast("double"), F.sum("ss").cast("double")
    var = F.greatest((ss - s * s / n) / F.nullif(n - 1, F.lit(0)), F.lit(0.0))
    return cells.groupBy(F.col("assignment_group").alias("group")).agg(
        n.alias("resolved"), F.bround(F.when(n > 1, F.sqrt(var) / 3600.0), 2).alias("mttr_stddev"),
        F.bround(F.regr_slope("mean", "x"), 3).alias("mttr_slope"))


def category_share(df: DataFrame) -> DataFrame:
    counts = (df.where("month IS NOT NULL AND category IS NOT NULL")
              .groupBy(F.col("month").alias("period"), "category").agg(F.count("*").alias("count")))
    return counts.withColumn("share_pct", ratio_pct(
        F.col("count"), F.sum("count").over(Window.partitionBy("period"))))


def reassign_rate_impact(df: DataFrame) -> DataFrame:
    moved = F.col("reassignment_count") > 0
    return df.agg(ratio_pct(F.count_if(moved), F.count("*")).alias("reassigned_pct"),
                  F.bround(fixed_avg("reassignment_count", 1), 2).alias("avg_reassignments"),
                  F.bround(hours_avg(where=~moved), 1).alias("mttr_first_try"),
                  F.bround(hours_avg(where=moved), 1).alias("mttr_reassigned"))


def _by_owner(df: DataFrame, *aggs) -> DataFrame:
    """Towers and managers in one pass: each ticket is one row of both before the partial sums."""
    owners = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("owner")) for k in ("tower", "sdm")])
    return (df.select("*", F.inline(owners)).where(F.trim("owner") != "").groupBy("kind", "owner").agg(*aggs))


def first_assignment_right(df: DataFrame) -> DataFrame:
    return _by_owner(df, F.count("*").alias("total"), ratio_pct(
        F.count_if(F.col("reassignment_count") == 0), F.count("*")).alias("far_pct"))


def tower_sdm_compare(df: DataFrame) -> DataFrame:
    n = F.count("*")
    return _by_owner(
        df, n.alias("total"), ratio_pct(F.count_if("made_sla_bool"), n).alias("sla_pct"),
        F.bround(hours_avg(), 1).alias("avg_mttr"),
        ratio_pct(F.count_if(F.col("reopen_count") > 0), n).alias("reopen_pct"),
        ratio_pct(F.count_if(F.col("reassignment_count") == 0), n).alias("far_pct"),
        ratio_pct(F.count_if(F.col("state").isin(DONE_STATES)), n).alias("resolved_pct"))


def composite_score(df: DataFrame) -> DataFrame:
    """0.4 SLA + 0.3 (100 - MTTR spread) + 0.2 FAR + 0.1 growth per tower, clipped to 0-100.

    Spread is the coefficient of variation of the monthly mean in percent, growth
    the last month against the one before; both are clipped to 0-100 first.
    """
    cells = (df.where("month IS NOT NULL").where(F.trim("tower") != "").groupBy("tower", "month")
             .agg(F.count("*").alias("n"), F.count_if("made_sla_bool").alias("met"),
                  F.count_if(F.col("reassignment_count") == 0).alias("far"),
                  F.bround(hours_avg(), 4).alias("mttr")))
    w = Window.partitionBy("tower").orderBy("month")
    cells = cells.withColumn("prev", F.lag("n").over(w))
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0))
    one = cells.groupBy("tower").agg(
        F.sum("n").alias("n"), F.sum("met").alias("met"), F.sum("far").alias("far"),
        (100.0 * F.stddev_samp("mttr") / F.avg("mttr")).alias("spread"),
        F.max_by("n", "month").alias("last"), F.max_by("prev", "month").alias("before"))
    sla = 100.0 * F.col("met") / F.col("n")
    far = 100.0 * F.col("far") / F.col("n")
    grow = 100.0 * (F.col("last") - F.col("before")) / F.col("before")
    total = (0.4 * sla + 0.3 * (100.0 - clip(F.coalesce("spread", F.lit(0.0)))) + 0.2 * far
             + 0.1 * clip(F.coalesce(grow, F.lit(0.0))))
    return one.select("tower", F.bround(total, 1).alias("score")).withColumn(
        "band", F.when(F.col("score") >= 80, "green").when(F.col("score") >= 70, "amber").otherwise("red"))


def pareto_80(df: DataFrame, share: float = 80.0) -> DataFrame:
    """The fewest towers that hold the given share of tickets."""
    counts = df.where(F.trim("tower") != "").groupBy("tower").agg(F.count("*").alias("count"))
    order = Window.partitionBy().orderBy(F.desc("count"), "tower")
    total = F.sum("count").over(Window.partitionBy())
    before = F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")
    return (counts.withColumns({"before": before, "all": total})
            .where(100.0 * F.col("before") / F.col("all") < share)
            .select("tower", "count", ratio_pct(F.col("before") + F.col("count"), F.col("all")).alias("cumulative_pct")))


def ownership_bands(snapshot: DataFrame) -> DataFrame:
    age = F.col("assignment_age_h")
    band = (F.when(age < 24, "green").when(age < 72, "amber").when(age < 168, "red").otherwise("critical"))
    return snapshot.where(age.isNotNull()).groupBy(band.alias("band")).agg(F.count("*").alias("count"))


def aging_share(as_of):
    """Elapsed share of a ticket's contract hours at ``as_of``, in percent."""
    return 100.0 * hours_between("created", at(as_of)) / sla_hours(F.col("priority"))


def aging_band(share):
    return (F.when(share < 25, "green").when(share < 75, "yellow").when(share <= 95, "red").otherwise("critical"))


def aging_bands(df: DataFrame, as_of) -> DataFrame:
    return (df.where(F.col("state").isin(ACTIVE_STATES)).groupBy(aging_band(aging_share(as_of)).alias("band"))
            .agg(F.count("*").alias("count")))


def burndown(df: DataFrame, limit_pct: float = 10.0) -> DataFrame:
    """Created and resolved tickets per tower and week, the backlog, and its growth flag.

    Each ticket becomes one or two (week, +1) rows before the partial sums, so one
    shuffle of tower-weeks serves both counts.
    """
    week = lambda c: F.to_date(F.date_trunc("week", c))
    marks = F.array(F.struct(week("created").alias("week"), F.lit(1).alias("c"), F.lit(0).alias("r")),
                    F.struct(week("resolved").alias("week"), F.lit(0).alias("c"), F.lit(1).alias("r")))
    weeks = (df.where(F.trim("tower") != "").select("tower", F.inline(marks)).where("week IS NOT NULL")
             .groupBy("tower", "week").agg(F.sum("c").alias("created"), F.sum("r").alias("resolved")))
    w = Window.partitionBy("tower").orderBy("week")
    backlog = F.sum(F.col("created") - F.col("resolved")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = weeks.withColumn("backlog", backlog).withColumn("prev", F.lag("backlog").over(w))
    g = F.bround(F.try_divide(100.0 * (F.col("backlog") - F.col("prev")), F.col("prev")), 1)
    return out.select("tower", F.date_format("week", "yyyy-MM-dd").alias("week"), "created", "resolved", "backlog",
                      g.alias("growth_pct")).withColumn(
        "flag", F.coalesce(F.col("growth_pct") > limit_pct, F.lit(False)))


def affinity(df: DataFrame) -> DataFrame:
    """How well and how fast each group handles each service."""
    n = F.count("*")
    return (df.where(F.trim("service_offering") != "").where("assignment_group IS NOT NULL")
            .groupBy("service_offering", F.col("assignment_group").alias("group"))
            .agg(n.alias("tickets"), ratio_pct(F.count_if("made_sla_bool"), n).alias("success_pct"),
                 F.bround(hours_avg(), 1).alias("avg_mttr"),
                 ratio_pct(F.count_if(F.col("reopen_count") > 0), n).alias("reopen_pct")))


def agent_ownership(snapshot: DataFrame) -> DataFrame:
    """Each agent's open load and remaining SLA hours against the group's mean load."""
    per = (snapshot.where(F.trim("assigned_to") != "")
           .groupBy(F.col("assignment_group").alias("group"), agent_name("assigned_to").alias("agent"))
           .agg(F.count("*").alias("load"), F.bround(fixed_avg("remaining_biz_hours"), 1).alias("avg_remaining_h"),
                F.count_if("already_breached").alias("breached")))
    w = Window.partitionBy("group")
    peers = F.sum("load").over(w) / F.count("*").over(w)
    return per.withColumn("vs_peers", F.bround(F.col("load") / peers, 2))


def queue_alerts(snapshot: DataFrame, queue_limit: int = 20) -> DataFrame:
    """Groups whose queue is too long, or that hold P1 breaches or overdue tickets."""
    per = (snapshot.groupBy(F.col("assignment_group").alias("group"))
           .agg(F.count("*").alias("queue"),
                F.count_if(F.col("already_breached") & (F.col("priority_num") == 1)).alias("p1_breaches"),
                F.count_if(F.col("overdue_biz_hours") > 0).alias("overdue")))
    alert = F.concat_ws(",", F.when(F.col("queue") > queue_limit, "queue"),
                        F.when(F.col("p1_breaches") > 0, "p1_breach"), F.when(F.col("overdue") > 0, "overdue"))
    return per.withColumn("alerts", alert).where("alerts <> ''")


def sla_variance(df: DataFrame, target: float = COMPLIANCE_TARGET) -> DataFrame:
    """Monthly compliance per priority against the target."""
    n = F.count("*")
    return (df.where("month IS NOT NULL").groupBy(F.col("month").alias("period"), "priority")
            .agg(ratio_pct(F.count_if("made_sla_bool"), n).alias("actual_pct"))
            .withColumn("target_pct", F.lit(target))
            .withColumn("variance", F.bround(F.col("actual_pct") - target, 1)))


def cost(df: DataFrame, rates: dict[int, float]) -> DataFrame:
    """Volume, hours and cost per group and priority at an hourly rate per priority.

    The cost per ticket is left unrounded: at given rates many values fall on half cents.
    """
    rate = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p, r in rates.items() for x in (p, float(r))]),
                                       F.col("priority")), F.lit(0.0))
    return (df.where("mttr_hours IS NOT NULL AND assignment_group IS NOT NULL")
            .groupBy(F.col("assignment_group").alias("group"), "priority")
            .agg(F.count("*").alias("tickets"), fixed_sum("mttr_hours", HOURS).alias("s"))
            .select("group", "priority", "tickets", F.bround(F.col("s") / 3600.0, 1).alias("hours"),
                    F.bround(F.col("s") / 3600.0 * rate, 0).alias("cost"),
                    (mean_of(F.col("s"), F.col("tickets"), HOURS) * rate).alias("cost_per_ticket")))


# Words in notes that hint at why a ticket moved.
REASSIGN_CAUSES = {
    "wrong_group": ["wrong group", "misrouted", "reassign"],
    "skill": ["skill", "knowledge", "expert"],
    "queue": ["queue", "delay", "waiting"],
}
# End of fixed values.


def reassign_causes(df: DataFrame, text: str = "resolution_notes",
                    causes: dict[str, list[str]] = REASSIGN_CAUSES) -> DataFrame:
    """Per group: reassignments and tickets whose notes mention each cause."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    moved = F.col("reassignment_count") > 0
    return (df.where("assignment_group IS NOT NULL").withColumn("_t", low)
            .groupBy(F.col("assignment_group").alias("group"))
            .agg(F.count("*").alias("tickets"), F.sum("reassignment_count").alias("reassignments"),
                 F.count_if(moved).alias("reassigned"),
                 *[F.count_if(moved & any_hit(F.col("_t"), words)).alias(name) for name, words in causes.items()]))


def tower_card(df: DataFrame) -> DataFrame:
    """Five measures per tower and month."""
    n = F.count("*")
    return (df.where(F.trim("tower") != "").where("month IS NOT NULL").groupBy("tower", F.col("month").alias("period"))
            .agg(n.alias("tickets"), ratio_pct(F.count_if("made_sla_bool"), n).alias("sla_pct"),
                 ratio_pct(F.count_if(F.col("reassignment_count") == 0), n).alias("far_pct"),
                 F.bround(hours_avg(), 1).alias("avg_mttr"),
                 ratio_pct(F.count_if(F.col("state").isin(DONE_STATES)), n).alias("resolution_pct")))


def mttr_band(df: DataFrame) -> DataFrame:
    m = F.col("mttr")
    return mttr_by_group(df).withColumn("band", F.when(m <= 4, "green").when(m <= 8, "orange").otherwise("red"))


def mttr_quantiles(df: DataFrame, exact: bool = True) -> DataFrame:
    """Median and 95th percentile per tower and priority; ``exact=False`` uses the bounded approximate sketch."""
    if exact:
        found = quantiles(df, ["tower", "priority"], "mttr_hours", {"p50": 0.5, "p95": 0.95}, "tickets")
        return found.withColumns({c: F.bround(c, 3) for c in ("p50", "p95")})
    q = lambda p: F.percentile_approx("mttr_hours", p, 10_000)
    return (df.where("mttr_hours IS NOT NULL").groupBy("tower", "priority")
            .agg(F.count("*").alias("tickets"), F.bround(q(0.5), 3).alias("p50"), F.bround(q(0.95), 3).alias("p95")))
