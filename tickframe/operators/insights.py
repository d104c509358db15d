"""Rule-based insights: one row each with message, severity, metric and chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.functions.clean import ACTIVE_STATES
from tickframe.functions.numbers import HOURS, fixed_sum, mean_of


def severity_band(value: Column, first: float, second: float, reverse: bool = False) -> Column:
    """positive / warning / critical by two limits; ``reverse`` where more is better."""
    if reverse:
        return F.when(value >= first, "positive").when(value >= second, "warning").otherwise("critical")
    return F.when(value < first, "positive").when(value < second, "warning").otherwise("critical")


def _num(value: Column, digits: int = 1, sign: bool = False) -> Column:
    return F.format_string(f"%{'+' if sign else ''}.{digits}f", F.bround(value, digits))


def _int(value: Column) -> Column:
    return value.cast("long").cast("string")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _row(key: str, title: str, message: Column, severity: Column, metric: Column, chart: str) -> Column:
    return F.struct(F.lit(key).alias("id"), F.lit(title).alias("title"), message.alias("message"),
                    severity.alias("severity"), metric.alias("metric"), F.lit(chart).alias("chart"))


def _emit(one_row: DataFrame, rows: list[tuple[Column, Column]]) -> DataFrame:
    """Unpivot the insight structs; an insight whose condition fails is left out."""
    cells = F.array(*[F.when(cond, row) for cond, row in rows])
    return one_row.select(F.inline(F.filter(cells, lambda c: c.isNotNull())))


def _first_largest(name: str, measure: Column) -> Column:
    """Name with the largest measure, first name on ties; rows without a measure are out."""
    return F.min_by(F.when(measure.isNotNull(), F.col(name)),
                    F.when(measure.isNotNull(), F.struct(-measure, F.col(name))))


def monitoring(df: DataFrame) -> DataFrame:
    """Six insights from one pass: tickets to (group, category) cells, cells to totals per
    group, per category and overall, and those few rows to one."""
    live = F.col("state").isin(ACTIVE_STATES)
    sums = ["n", "met", "live", "crit", "moves", "moved", "many", "held"]
    cells = df.groupBy("assignment_group", "category").agg(
        F.count("*").alias("n"), F.count_if("made_sla_bool").alias("met"),
        F.count_if(live).alias("live"), F.count_if(live & F.col("priority").isin(1, 2)).alias("crit"),
        F.sum("reassignment_count").alias("moves"), F.count("reassignment_count").alias("moved"),
        F.count_if(F.col("reassignment_count") >= 3).alias("many"),
        F.count_if(F.col("state") == "On Hold").alias("held"))
    level = F.grouping_id()  # 3: overall, 1: per group, 2: per category
    sets = cells.groupingSets([[], ["assignment_group"], ["category"]], "assignment_group", "category").agg(
        level.alias("level"), *[F.sum(c).alias(c) for c in sums])
    group_load = F.when((F.col("level") == 1) & F.col("assignment_group").isNotNull() & (F.col("live") > 0),
                        F.col("live"))
    cat_rows = F.when((F.col("level") == 2) & F.col("category").isNotNull(), F.col("n"))
    one = sets.agg(
        *[F.coalesce(F.max(F.when(F.col("level") == 3, F.col(c))), F.lit(0)).alias(c) for c in sums],
        _first_largest("assignment_group", group_load).alias("top_group"),
        F.max(group_load).alias("top_count"), F.count(group_load).alias("n_groups"),
        _first_largest("category", cat_rows).alias("top_cat"), F.max(cat_rows).alias("top_n"))
    n = F.col("n")
    sla = F.coalesce(F.try_divide(100.0 * F.col("met"), n), F.lit(0.0))
    load = F.try_divide(F.col("top_count").cast("double"), F.try_divide(F.col("live"), F.col("n_groups")))
    moves = F.try_divide(F.col("moves").cast("double"), F.col("moved"))
    held = F.coalesce(F.try_divide(100.0 * F.col("held"), n), F.lit(0.0))
    cat = F.try_divide(100.0 * F.col("top_n"), n)
    always = F.lit(True)
    return _emit(one, [
        # Titles and wording of the insights.
        (always, _row("sla_compliance", "SLA Compliance", _text(
            "Overall SLA compliance is ", _num(sla), "%. ",
            F.when(sla >= 90, "Performance is strong — maintain current response times.")
            .otherwise(_text("Below 90% target. ", _int(n * (1.0 - sla / 100.0)),
                             " incidents breached SLA this period."))),
            severity_band(sla, 90, 80, reverse=True), _text(_num(sla), "%"), "sla_gauge")),
        (always, _row("critical_backlog", "Critical & High Priority Backlog", _text(
            _int(F.col("crit")), " P1/P2 incidents are currently unresolved. ",
            F.when(F.col("crit") > 10, "Immediate escalation review recommended.")
            .otherwise("Critical backlog is within acceptable limits.")),
            severity_band(F.col("crit"), 5, 10), _int(F.col("crit")), "priority_heatmap")),
        (F.col("live") > 0, _row("group_load", "Assignment Group Workload", _text(
            F.col("top_group"), " carries the highest active load (", _int(F.col("top_count")),
            " tickets, ", _num(load), "x the average). Consider load balancing."),
            severity_band(load, 1.3, 1.7), _text(_int(F.col("top_count")), " active"), "by_group")),
        (n > 0, _row("reassignment", "Reassignment Rate", _text(
            "Average reassignment count is ", _num(moves, 2), " per incident. ",
            F.when(F.col("many") > 5, _text(_int(F.col("many")),
                                            " tickets reassigned 3+ times — review routing rules."))
            .otherwise("Reassignment rate is within normal bounds.")),
            severity_band(moves, 0.8, 1.5), _text(_num(moves, 2), " avg"), "by_group")),
        (always, _row("on_hold", "On-Hold Incidents", _text(
            _int(F.col("held")), " incidents (", _num(held), "%) are on hold. ",
            F.when(held > 10, "High hold rate may indicate supplier dependency or approval bottlenecks.")
            .otherwise("Hold queue is within acceptable levels.")),
            severity_band(held, 8, 15), _text(_num(held), "%"), "reopen_tracker")),
        (n > 0, _row("top_category", "Dominant Incident Category", _text(
            "'", F.col("top_cat"), "' accounts for ", _num(cat), "% of all incidents. ",
            F.when(cat > 25, "High concentration suggests a systemic issue or process gap worth investigating.")
            .otherwise("Incident distribution across categories is balanced.")),
            severity_band(cat, 25, 35), _text(_num(cat), "%"), "by_category")),
        # End of fixed values.
    ])


def trends(df: DataFrame) -> DataFrame:
    """Five insights from the last two months, the categories and the linear slope.

    One pass: tickets to (month, category) cells, cells to totals per month and per
    category; the windows run over one row per month.
    """
    sums = ["n", "met", "s", "sn"]
    cells = df.groupBy("month", "category").agg(
        F.count("*").alias("n"), F.count_if("made_sla_bool").alias("met"),
        fixed_sum("mttr_hours", HOURS).alias("s"), F.count("mttr_hours").alias("sn"))
    rows = cells.groupingSets([["month"], ["category"]], "month", "category").agg(
        F.grouping_id().alias("level"), *[F.sum(c).alias(c) for c in sums])
    rows = rows.where(F.when(F.col("level") == 1, F.col("month")).otherwise(F.col("category")).isNotNull()) \
        .withColumns({"mean": F.when(F.col("sn") > 0, mean_of(F.col("s"), F.col("sn"), HOURS)),
                      "sla": 100.0 * F.col("met") / F.col("n")})
    by_month = Window.partitionBy("level").orderBy("month")
    before = by_month.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "x": (F.row_number().over(by_month) - 1).cast("double"),
        "n_prev": F.lag("n").over(by_month), "sla_prev": F.lag("sla").over(by_month),
        "mean_prev": F.last("mean", ignorenulls=True).over(before)})
    monthly = F.col("level") == 1
    month, timed = F.when(monthly, F.col("month")), F.when(monthly & F.col("mean").isNotNull(), F.col("month"))
    slow = F.when(~monthly, F.col("mean"))
    one = rows.agg(
        F.count(month).alias("months"), F.max_by("n", month).alias("n"), F.max_by("n_prev", month).alias("n_prev"),
        F.max_by("sla", month).alias("sla"), F.max_by("sla_prev", month).alias("sla_prev"),
        F.max_by("mean", timed).alias("mttr"), F.max_by("mean_prev", timed).alias("mttr_prev"),
        F.regr_slope(F.when(monthly, F.col("n")), F.col("x")).alias("slope"),
        _first_largest("category", slow).alias("worst"), F.max(slow).alias("worst_mttr"))
    delta = (F.col("n") - F.col("n_prev")) / F.greatest(F.col("n_prev"), F.lit(1)) * 100.0
    shift = F.col("mttr") - F.col("mttr_prev")
    slope = F.col("slope")
    return _emit(one, [
        # Titles and wording of the insights.
        (F.col("n_prev").isNotNull(), _row("volume_trend", "Monthly Volume Trend", _text(
            "Incident volume ", F.when(delta > 0, "increased").otherwise("decreased"), " by ",
            _num(F.abs(delta)), "% vs the prior period (", _int(F.col("n_prev")), " → ",
            _int(F.col("n")), "). ",
            F.when(delta > 15, "Investigate root cause of surge.")
            .when(F.abs(delta) < 5, "Stable trend — no immediate concern.")
            .otherwise("Monitor closely over next period.")),
            severity_band(F.abs(delta), 10, 20), _text(_num(delta, sign=True), "%"), "volume")),
        (F.col("mttr_prev").isNotNull(), _row("mttr_trend", "MTTR Trajectory", _text(
            "Mean Time to Resolve is ", _num(F.col("mttr")), " hrs (prev period: ",
            _num(F.col("mttr_prev")), " hrs). ",
            F.when(shift < -1, "Resolution times are improving — positive trend.")
            .when(F.abs(shift) < 1, "MTTR is stable.")
            .otherwise("MTTR deteriorating — review resolver capacity and ticket complexity.")),
            severity_band(shift, 0, 5), _text(_num(F.col("mttr")), "h"), "mttr")),
        (F.col("worst").isNotNull(), _row("worst_category_mttr", "Slowest Category to Resolve", _text(
            "'", F.col("worst"), "' has the highest average MTTR at ", _num(F.col("worst_mttr")),
            " hours. Consider dedicated knowledge articles, automation, or routing optimisation."),
            severity_band(F.col("worst_mttr"), 24, 72), _text(_num(F.col("worst_mttr")), "h"),
            "category_distribution")),
        (F.col("sla_prev").isNotNull(), _row("sla_trend", "SLA Compliance Trend", _text(
            "SLA compliance this period: ", _num(F.col("sla")), "% (prev: ", _num(F.col("sla_prev")), "%). ",
            F.when(F.col("sla") > F.col("sla_prev"), "Compliance improving — good operational progress.")
            .otherwise("Compliance declining — prioritise P1/P2 response times.")),
            severity_band(F.col("sla"), 90, 80, reverse=True), _text(_num(F.col("sla")), "%"),
            "sla_compliance")),
        (F.col("months") >= 4, _row("forecast", "Volume Forecast Signal", _text(
            "Linear trend slope: ", _num(slope, sign=True), " incidents/period. ",
            F.when(slope > 5, "Upward trend detected. Infrastructure capacity planning recommended.")
            .when(slope < -5, "Downward trend. Potential improvement from recent initiatives.")
            .otherwise("Volume is stable with no significant directional drift.")),
            severity_band(F.abs(slope), 5, 15), _text(_num(slope, sign=True), "/period"), "forecast")),
        # End of fixed values.
    ])
