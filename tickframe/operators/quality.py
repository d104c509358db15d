"""Quality reports on raw and cleaned rows; each is one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.functions import clean as cl
from tickframe.functions.breach_columns import sla_hours
from tickframe.operators.ingest import split_known
from tickframe.schema import REQUIRED_COLUMNS


def _long(one: DataFrame, names: list[str], key: str, value: str) -> DataFrame:
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias(key), F.col(n).alias(value)) for n in names])))


def required_blank(df: DataFrame, columns: list[str] = REQUIRED_COLUMNS) -> DataFrame:
    """Blank values per required column."""
    aggs = [F.count_if(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "").alias(c)
            for c in columns]
    return _long(df.agg(*aggs), columns, "column", "blanks")


def value_fixes(raw: DataFrame) -> DataFrame:
    """Values that cleaning had to replace, and dates that no format reads."""
    dates = ["created", "updated", "resolved", "sla_due", "last_assignment_date"]
    bad_dates = sum((F.count_if((F.trim(c) != "") & cl.parse_date(c).isNull())
                     for c in dates if c in raw.columns), F.lit(0).cast("long"))
    state = F.trim("state")
    return raw.agg(
        F.count_if(~cl.priority_is_known(F.coalesce("priority", F.lit("")))).alias("priority_fixed"),
        F.count_if(~cl.urgency_is_known(F.coalesce("urgency", F.lit("")))).alias("urgency_fixed"),
        F.count_if(~cl.sla_is_known("made_sla")).alias("sla_fixed"),
        F.count_if(~F.coalesce(state.isin(cl.STATES), F.lit(False))).alias("state_fixed"),
        bad_dates.alias("date_failures"))


def file_summary(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Per upload: rows, repeats inside it, rows already known, net new rows.

    Rows are first reduced to one per (file, number); only those meet the register.
    """
    per_key = rows.groupBy("_file", "number").agg(F.count("*").alias("n"))
    fresh, known = split_known(per_key, existing)
    flagged = fresh.withColumn("known", F.lit(0)).unionByName(known.withColumn("known", F.lit(1)))
    return (flagged.groupBy(F.col("_file").alias("file"))
            .agg(F.sum("n").alias("rows_in_file"), F.sum(F.col("n") - 1).alias("internal_duplicates"),
                 F.sum("known").alias("existing_duplicates"),
                 F.sum(1 - F.col("known")).alias("net_new_rows")).orderBy("file"))


def quality_checks(df: DataFrame, max_hours: float = 720) -> DataFrame:
    """Missing owners or priority, implausible durations, SLA flag against the target."""
    hours = F.col("mttr_hours")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = {
        "missing_tower": blank("tower"), "missing_sdm": blank("sdm"),
        "missing_priority": F.col("priority").isNull(),
        "mttr_over_limit": F.coalesce(hours > max_hours, F.lit(False)),
        "sla_contradicts_mttr": F.coalesce(
            F.col("made_sla_bool") != (hours <= sla_hours(F.col("priority"))), F.lit(False)),
    }
    one = df.agg(*[F.count_if(cond).alias(name) for name, cond in rules.items()])
    return _long(one, list(rules), "rule", "rows")
