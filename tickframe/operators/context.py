"""Fact sections for a question about the register, and routing of questions to sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.functions.clean import ACTIVE_STATES, DONE_STATES, priority_short_label
from tickframe.functions.numbers import HOURS, fixed_sum, mean_of
from tickframe.functions.rules import any_hit, lowered
from tickframe.plans.ordered import numbered
from tickframe.session import stored

# Section order, question keywords, headings, size of a context.
SECTION_KEYWORDS: dict[str, list[str]] = {
    "priority_breakdown": ["priority", "p1", "p2", "p3", "p4", "critical", "urgent", "severe", "high"],
    "group_workload": ["group", "team", "assign", "backlog", "workload", "who", "queue", "which team"],
    "categories": ["category", "type", "kind", "hardware", "network", "software", "access", "error",
                   "application", "service", "infrastructure"],
    "mttr_by_group": ["mttr", "resolution time", "how long", "duration", "resolve", "mean time", "time to"],
    "sla_compliance": ["sla", "breach", "compliance", "target", "met", "missed", "service level"],
    "monthly_trend": ["trend", "week", "month", "recent", "last", "this month", "over time", "history",
                      "timeline", "pattern"],
    "reassignment": ["reassign", "bounce", "routing", "wrong group", "escalat", "transfer"],
    "top_active_incidents": ["top", "worst", "highest", "most", "list", "show me", "what are the"],
}
SECTION_HEADINGS: dict[str, str] = {
    "priority_breakdown": "\n**Priority Breakdown:**",
    "group_workload": "\n**Active Incidents by Assignment Group:**",
    "categories": "\n**Category Distribution:**",
    "mttr_by_group": "\n**Average MTTR by Group (hours):**",
    "sla_compliance": "\n**SLA Compliance by Group:**",
    "monthly_trend": "\n**Monthly Incident Volume (last 6 periods):**",
    "reassignment": "\n**Reassignment Analysis:**",
    "top_active_incidents": "\n**Top 5 Active Incidents (by priority):**",
}
MAX_CONTEXT_CHARS = 2800
TRUNCATED = "\n…[context truncated]"
BULLET = "• "
# End of fixed values.


def _commas(c) -> Column:
    return F.format_number(c, 0)


def _one(c: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f", F.bround(c, digits))


def _line(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _fact(section: str, order: list, label, value, line) -> Column:
    """One line of a section; ``order`` is a number to sort by, then a text."""
    number, text = order
    return F.struct(F.lit(section).alias("section"), number.cast("double").alias("o1"), text.alias("o2"),
                    label.cast("string").alias("label"), value.cast("double").alias("value"),
                    line.alias("line"))


# How many lines a section shows.
SECTION_LIMITS = {"group_workload": 8, "categories": 10, "monthly_trend": 6}
# End of fixed values.


def facts(df: DataFrame) -> DataFrame:
    """All nine sections as (section, rank, label, value, line).

    Tickets are aggregated once to (priority, group, category, month) cells, the cells
    to totals per priority, group, category, month and overall; a second, narrow scan
    finds the five oldest tickets of highest priority.
    """
    live = F.col("state").isin(ACTIVE_STATES)
    keys = ["priority", "assignment_group", "category", "month"]
    sums = ["n", "live", "done", "met", "s", "sn", "moves", "moved", "many"]
    cells = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(live).alias("live"),
        F.count_if(F.col("state").isin(DONE_STATES)).alias("done"), F.count_if("made_sla_bool").alias("met"),
        fixed_sum("mttr_hours", HOURS).alias("s"), F.count("mttr_hours").alias("sn"),
        F.sum("reassignment_count").alias("moves"), F.count("reassignment_count").alias("moved"),
        F.count_if(F.col("reassignment_count") >= 3).alias("many"),
        F.min("created").alias("first"), F.max("created").alias("last"))
    sets = cells.groupingSets([[], *[[k] for k in keys]], *keys).agg(
        F.grouping_id().alias("level"), *[F.sum(c).alias(c) for c in sums],
        F.min("first").alias("first"), F.max("last").alias("last"))
    n, sla = F.col("n"), F.try_divide(100.0 * F.col("met"), F.col("n"))
    mttr = mean_of(F.col("s"), F.col("sn"), HOURS)
    moves = F.try_divide(F.col("moves").cast("double"), F.col("moved"))
    # Categories meet the total in one task; groups and months, of which there may be many, do not need it.
    with_total = F.when(F.col("level").isin(13, 15), F.lit(0)).otherwise(1 + F.pmod(F.hash(*keys), F.lit(1000)))
    everything = F.max(F.when(F.col("level") == 15, n)).over(Window.partitionBy(with_total))
    sets = sets.withColumn("all", everything).where("n > 0")
    none, blank = F.lit(0), F.lit("")

    def day(c):
        return F.date_format(c, "dd MMM yyyy")

    pri = F.coalesce(priority_short_label("priority"), F.concat(F.lit("P"), F.col("priority").cast("string")))
    g, cat, month = F.col("assignment_group"), F.col("category"), F.col("month")
    by_level = {
        15: [
            _fact("overview", [F.lit(1), blank], F.lit("total"), n,
                  _line("**Platform Overview** (", _commas("n"), " total incidents)")),
            _fact("overview", [F.lit(2), blank], F.lit("active"), F.col("live"),
                  _line(BULLET, "Active: ", _commas("live"), "  |  Resolved/Closed: ", _commas("done"))),
            _fact("overview", [F.lit(3), blank], F.lit("sla_pct"), F.bround(sla, 1),
                  _line(BULLET, "Overall SLA compliance: ", _one(sla), "%")),
            _fact("overview", [F.lit(4), blank], F.lit("avg_mttr"), F.bround(mttr, 1),
                  _line(BULLET, "Overall avg MTTR: ", _one(mttr), " hours")),
            _fact("overview", [F.lit(5), blank], F.lit("date_range"), F.lit(None),
                  _line(BULLET, "Data range: ", day("first"), " → ", day("last"))),
            _fact("reassignment", [F.lit(1), blank], F.lit("avg_reassignments"), F.bround(moves, 2),
                  _line(BULLET, "Avg reassignments per incident: ", _one(moves, 2))),
            _fact("reassignment", [F.lit(2), blank], F.lit("high_reassignments"), F.col("many"),
                  _line(BULLET, "Incidents with 3+ reassignments: ", _commas("many"))),
        ],
        7: [_fact("priority_breakdown", [F.col("priority"), blank], pri, n,
                  _line(BULLET, pri, ": ", _commas("n"), " total, ", _commas("live"), " active"))],
        11: [
            _fact("group_workload", [-F.nullif(F.col("live"), F.lit(0)), g], g, F.col("live"),
                  _line(BULLET, g, ": ", _commas(F.nullif(F.col("live"), F.lit(0))), " active")),
            _fact("mttr_by_group", [mttr, g], g, F.bround(mttr, 1), _line(BULLET, g, ": ", _one(mttr), "h")),
            _fact("sla_compliance", [-sla, g], g, F.bround(sla, 1), _line(BULLET, g, ": ", _one(sla), "%")),
        ],
        13: [_fact("categories", [-n, cat], cat, n, _line(
            BULLET, cat, ": ", _commas("n"), " (", _one(100.0 * n / F.col("all"), 0), "%)"))],
        14: [_fact("monthly_trend", [none, month], month, n, _line(BULLET, month, ": ", _commas("n")))],
    }
    lines = F.lit(None)
    for level, structs in by_level.items():
        lines = F.when(F.col("level") == level, F.array(*structs)).otherwise(lines)
    # A line is null where its key or its mean is.
    rows = sets.select(F.inline(lines)).where("line IS NOT NULL")
    top = (df.where(live).select("priority", "created", "number", "short_description")
           .orderBy("priority", "created", "number").limit(5)
           .withColumn("pos", F.row_number().over(Window.partitionBy().orderBy("priority", "created", "number"))))
    listed = top.select(F.inline(F.array(_fact(
        "top_active_incidents", [F.col("pos"), blank], F.col("number"), F.col("priority"),
        _line(BULLET, "[", priority_short_label("priority"), "] ", F.col("number"), " — ",
              F.substring("short_description", 1, 80))))))
    # The first rows of a limited section are found by a limit in each task. Sections that list all groups
    # are ranked over all tasks. The lines are stored, as they are read three times.
    rows = stored(rows.unionByName(listed), "facts")
    w = Window.partitionBy("section")
    months = F.col("section") == "monthly_trend"
    latest = (rows.where(months).withColumn("end", F.row_number().over(w.orderBy(F.desc("o1"), F.desc("o2"))))
              .where(F.col("end") <= SECTION_LIMITS["monthly_trend"]).drop("end"))
    short = rows.where(F.col("section").isin(list(SECTION_LIMITS)) & ~months).unionByName(latest)
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in SECTION_LIMITS.items() for x in kv]), F.col("section"))
    first = (short.withColumn("rank", F.row_number().over(w.orderBy("o1", "o2")))
             .where(F.col("rank") <= max(SECTION_LIMITS.values())).where(F.col("rank") <= limit))
    whole = numbered(rows.where(~F.col("section").isin(list(SECTION_LIMITS))), [F.col("o1"), F.col("o2")], "rank", "section")
    ranked = first.withColumn("rank", F.col("rank").cast("long")).unionByName(whole)
    return ranked.select("section", "rank", "label", "value", "line")


def route(questions: DataFrame, facts_rows: DataFrame, text: str = "text") -> DataFrame:
    """Sections each question asks for, and the context text built from them.

    A context shows at most MAX_CONTEXT_CHARS characters. A line has one at least, so lines
    ranked beyond that number can never show; dropping them bounds what is collected, and each
    section is cut to one character more before any question gets it.
    """
    lines = (facts_rows.where(F.col("rank") <= MAX_CONTEXT_CHARS).groupBy("section")
             .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))),
                              lambda s: s["line"]).alias("lines")))
    headings = F.create_map(*[F.lit(x) for kv in SECTION_HEADINGS.items() for x in kv])
    body = F.substring(F.concat_ws("\n", F.try_element_at(headings, F.col("section")), F.col("lines")), 1, MAX_CONTEXT_CHARS + 1)
    book = lines.agg(F.map_from_entries(F.collect_list(F.struct("section", body))).alias("book"))
    asked = lowered(text, lambda low: F.array_compact(F.array(*[
        F.when(any_hit(low, words), F.lit(name)) for name, words in SECTION_KEYWORDS.items()])))
    full = F.concat_ws("\n", F.transform(
        F.concat(F.array(F.lit("overview")), F.col("sections")),
        lambda s: F.try_element_at(F.col("_book"), s)))
    return (questions.withColumn("sections", asked)
            .withColumn("_book", book.scalar())
            .withColumn("_full", full).drop("_book")
            .withColumn("context", F.when(
                F.length("_full") > MAX_CONTEXT_CHARS,
                F.concat(F.substring("_full", 1, MAX_CONTEXT_CHARS), F.lit(TRUNCATED)))
                .otherwise(F.col("_full")))
            .drop("_full"))


def history_window(messages: DataFrame, n: int = 20, session: str = "conv_id",
                   order: str = "turn") -> DataFrame:
    """The last n messages per session; Spark limits each group before the shuffle."""
    w = Window.partitionBy(session).orderBy(F.desc(order))
    return (messages.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn"))
