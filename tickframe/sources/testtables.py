"""Incidents and SLA snapshots derived from the order tables used for checking.

One order is one ticket; its lines give duration, reassignments and reopenings.
All rules are integer arithmetic on keys, so another engine can repeat them. The
functions remember the plans they built (not the data) per session and folder.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.functions.breach_columns import derive_breach
from tickframe.functions.clean import (
    DONE_STATES, EXPORT_DATE, PRIORITY_TEXT, derive_mttr, derive_time_parts,
    priority_short_label, urgency_short_label,
)

AS_OF = "2001-08-02 14:00:00"


@lru_cache(maxsize=64)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plus(ts: Column, unit: str, n: Column) -> Column:
    return F.timestamp_add(unit, n.cast("int"), ts)


@lru_cache(maxsize=64)
def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned incidents, one row per order."""
    # Dealt by order once: lines are grouped by order and supplier, and then by order, where they lie.
    line = (
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_suppkey", "l_quantity", "l_partkey",
            ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")).alias("reopened"))
        .repartition("l_orderkey").groupBy("l_orderkey", "l_suppkey").agg(
            F.sum("l_quantity").alias("q"), F.count_if("reopened").alias("nr"), F.min("l_partkey").alias("pk"))
        .groupBy("l_orderkey").agg(
            F.sum("q").alias("q"), F.count("l_suppkey").alias("ns"), F.sum("nr").alias("nr"), F.min("pk").alias("pk"))
    )
    org = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "n_name", "r_name")
    )
    customer = (
        table(spark, sf_dir, "customer")
        .join(org, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "n_nationkey", "n_name", "r_name", "c_mktsegment")
    )
    base = (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"),
              F.col("pk") == F.col("p_partkey"), "left")
    )
    k = F.col("o_orderkey")
    digit = F.substring("o_orderpriority", 1, 1)
    created = F.timestamp_add(
        "MINUTE", ((k % 24) * 60 + k % 60).cast("int"), F.col("o_orderdate").cast("timestamp"))
    status = F.col("o_orderstatus")
    word = F.split_part("p_name", F.lit(" "), F.lit(2))
    df = base.select(
        k.alias("seq"), "o_custkey", "q",
        F.concat(F.lit("INC"), F.lpad(k.cast("string"), 9, "0")).alias("number"),
        created.alias("created"),
        F.concat_ws("-", "n_name", "c_mktsegment").alias("assignment_group"),
        F.when(k % 4 == 0, F.concat("n_name", F.lit("-BUILDING")))
        .otherwise(F.concat_ws("-", "n_name", "c_mktsegment")).alias("first_assignment_group"),
        F.col("r_name").alias("tower"),
        F.concat(F.lit("SDM_"), (F.col("n_nationkey") % 8).cast("string")).alias("sdm"),
        F.when(digit.isin("1", "2", "3", "4"), digit.cast("int")).otherwise(3).alias("priority"),
        F.when(status == "F", F.when(k % 5 == 0, "Closed").otherwise("Resolved"))
        .when(status == "P", "In Progress")
        .otherwise(F.when(k % 3 == 0, "On Hold").otherwise("Open")).alias("state"),
        F.when(F.col("ns").isNull(), 0)
        .otherwise(F.greatest(F.col("ns") - 1, F.lit(0)) % 5).cast("int").alias("reassignment_count"),
        F.coalesce("nr", F.lit(0)).cast("int").alias("reopen_count"),
        F.when(k % 17 == 0, "").otherwise(F.concat(
            F.lit("Agent "), (F.col("o_custkey") % 40).cast("string"), F.lit(" (a"),
            (F.col("o_custkey") % 40).cast("string"), F.lit("@example.com)"))).alias("assigned_to"),
        F.concat(F.lit("user"), F.col("o_custkey").cast("string")).alias("impact_user"),
        F.concat(F.lit("agent"), (k % 15).cast("string")).alias("updated_by"),
        F.coalesce(F.concat_ws(" ", F.col("p_type"), F.col("p_brand")), F.lit("")).alias("service_offering"),
        F.coalesce("p_name", F.lit("")).alias("short_description"),
        F.when(word.isin("ring", "rod"), "Network").when(word.isin("widget", "gizmo"), "Hardware")
        .when(word.isin("gear", "bolt"), "Software & Tools").when(word == "plate", "Application Access")
        .otherwise("General").alias("category"),
        F.coalesce("p_type", F.lit("General")).alias("subcategory"), "p_type",
        *[F.lit("").alias(c) for c in ("hold_reason", "tags", "resolution_notes", "internal_id")],
        F.lit(None).cast("timestamp").alias("last_reopened_at"),
    )
    p = F.col("priority")
    df = df.withColumns({
        "urgency": F.least(p, F.lit(3)),
        "resolved": F.when(F.col("state").isin(DONE_STATES) & F.col("q").isNotNull(),
                           _plus(F.col("created"), "SECOND", F.col("q") * p * 450)),
        "last_assignment_date": _plus(F.col("created"), "HOUR", F.col("seq") % 48),
    })
    df = derive_time_parts(derive_mttr(df))
    hours = F.when(p == 1, 4).when(p == 2, 8).when(p == 3, 72).otherwise(120)
    return df.withColumns({
        "priority_label": priority_short_label("priority"),
        "urgency_label": urgency_short_label("urgency"),
        "made_sla_bool": F.when(F.col("resolved").isNotNull(), F.col("mttr_hours") <= hours)
        .otherwise(F.col("seq") % 10 >= 3),
        "updated": F.coalesce("resolved", _plus(F.col("created"), "HOUR", F.col("seq") % 120)),
        "sla_due": _plus(F.col("created"), "HOUR", hours),
        "business_duration": F.coalesce(F.col("mttr_hours") * 3600.0, F.lit(0.0)),
        "resolution_code": F.when(F.col("resolved").isNotNull(), F.col("p_type")).otherwise(""),
    }).withColumn("made_sla", F.when(F.col("made_sla_bool"), "TRUE").otherwise("FALSE")) \
        .drop("o_custkey", "q", "p_type")


@lru_cache(maxsize=64)
def breach_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed snapshot of the open tickets, before the derived columns."""
    return breach_of(incidents(spark, sf_dir))


def breach_of(tickets: DataFrame) -> DataFrame:
    k, p = F.col("seq"), F.col("priority")
    as_of = F.lit(AS_OF).cast("timestamp")
    pct = ((k * 7919) % 17600).cast("double") / 100.0
    sla = F.when(p == 1, 4).when(p == 2, 8).when(p == 3, 72).otherwise(120)
    label = F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY_TEXT.items() for x in kv]), p)
    return tickets.where(~F.col("state").isin(DONE_STATES)).select(
        F.col("number").alias("task"), "seq", "created", "assignment_group", "service_offering",
        "assigned_to", "reassignment_count", "reopen_count", label.alias("priority"),
        F.when(F.col("state") == "On Hold", "On Hold").otherwise("In Progress").alias("state"),
        pct.alias("business_elapsed_percentage"),
        _plus(as_of, "SECOND", F.round((100.0 - pct) * sla * 50.4)).alias("breach_time"),
        F.when(F.col("state") == "On Hold", _plus(as_of, "DAY", -(k % 45))).alias("stop_time"),
        F.when(k % 11 != 0, _plus(as_of, "HOUR", -((k * 31) % 400))).alias("last_assignment_date"),
        F.when(k % 5 == 0, F.concat(F.lit("BUG "), k.cast("string"))).otherwise("").alias("internal_id"),
    )


@lru_cache(maxsize=64)
def breach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_breach(breach_raw(spark, sf_dir), AS_OF)


def org_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisation dimension: every group with its tower and manager.

    Built from customers, nations and regions, where the group names come from.
    """
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.concat_ws("-", "n_name", "c_mktsegment").alias("assignment_group"),
                F.col("r_name").alias("tower"),
                F.concat(F.lit("SDM_"), (F.col("n_nationkey") % 8).cast("string")).alias("sdm"))
        .distinct()
    )


def raw_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incidents as an all-text export: other headers, spellings and date formats."""
    k = F.col("seq")
    iso = "yyyy-MM-dd HH:mm:ss"
    state = (F.when(F.col("state") == "Closed", "close").when(F.col("state") == "Resolved", "completed")
             .when(F.col("state") == "In Progress", "WIP").when(F.col("state") == "On Hold", " pending ")
             .otherwise("new"))
    priority = F.when(k % 3 == 0, F.concat(F.lit("P"), F.col("priority").cast("string"))) \
        .when(k % 3 == 1, F.element_at(
            F.create_map(*[F.lit(x) for kv in PRIORITY_TEXT.items() for x in kv]), F.col("priority"))) \
        .otherwise(F.concat(F.lit("Prio "), F.col("priority").cast("string")))
    return incidents(spark, sf_dir).select(
        F.col("number").alias("Number"),
        F.date_format("created", EXPORT_DATE).alias("Opened At"),
        F.col("impact_user").alias("Impacted user"),
        F.col("first_assignment_group").alias("First Assignment Group"),
        F.col("assignment_group").alias("Assignment group"),
        F.col("tower").alias("Tower"), F.col("sdm").alias("SDM"),
        F.col("service_offering").alias("Business-Service"),
        priority.alias("Priority"),
        F.col("urgency").cast("string").alias("Urgency"),
        state.alias("State"),
        F.col("assigned_to").alias("Assigned to"),
        F.col("short_description").alias("Short description"),
        F.col("category").alias("Category"), F.col("subcategory").alias("Subcategory"),
        F.date_format("updated", iso).alias("Updated"),
        F.col("updated_by").alias("Updated by"),
        F.when(F.col("made_sla_bool"), F.when(k % 2 == 0, "yes").otherwise(" true "))
        .otherwise(F.when(k % 2 == 0, "No").otherwise("FALSE")).alias("Made SLA"),
        F.coalesce(F.date_format("resolved", iso), F.lit("")).alias("Resolved"),
        F.when(k % 13 == 0, F.lit("n/a")).otherwise(F.col("reopen_count").cast("string")).alias("Reopen count"),
        F.col("reassignment_count").cast("string").alias("Reassignment count"),
        F.col("resolution_code").alias("Close Code"),
        F.lit("line one\nline two, \"quoted\"").alias("Close Notes"),
        F.lit("x").alias("Unknown Column"),
        k.cast("string").alias("File Row"),
    )


def raw_messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export with normal headers and planted faults, for the quality reports."""
    from tickframe.sources.files import normalize_columns

    df = normalize_columns(raw_export(spark, sf_dir))
    k = F.col("file_row").cast("long")

    def fault(column: str, every: int, at: int, value: str) -> Column:
        return F.when(k % every == at, value).otherwise(F.col(column))

    return df.withColumns({
        "number": fault("number", 101, 0, " "), "created": fault("created", 53, 7, "junk"),
        "priority": fault("priority", 7, 3, "unknown"), "urgency": fault("urgency", 11, 4, "none"),
        "state": fault("state", 9, 2, " "), "made_sla": fault("made_sla", 10, 1, "maybe"),
    })


def ticket_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as repeated rows of the same ticket; three files by return flag."""
    number = F.concat(F.lit("INC"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0"))
    rank = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    return table(spark, sf_dir, "lineitem").select(
        number.alias("number"), rank.alias("file_rank"),
        F.col("l_shipdate").cast("timestamp").alias("updated"), "l_linenumber", "l_partkey",
        "l_suppkey", "l_quantity", "l_extendedprice")


UPDATE_ORDER = ["updated", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores per ticket from the events; half of the numbers are unknown."""
    number = F.concat(F.lit("INC"), F.lpad((F.col("event_id") * 2).cast("string"), 9, "0"))
    return table(spark, sf_dir, "events").select(
        "event_id", number.alias("incident_number"), F.col("value").alias("csat_score"))


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from tickframe.streaming.jobs import read_files

    return read_files(spark, sf_dir, table(spark, sf_dir, name).schema, glob=f"{name}.parquet")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def order_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets as they arrive: number, created, priority and state."""
    k, digit, status = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus")
    return _stream(spark, sf_dir, "orders").select(
        F.concat(F.lit("INC"), F.lpad(k.cast("string"), 9, "0")).alias("number"),
        F.timestamp_add("MINUTE", ((k % 24) * 60 + k % 60).cast("int"),
                        F.col("o_orderdate").cast("timestamp")).alias("created"),
        F.when(digit.isin("1", "2", "3", "4"), digit.cast("int")).otherwise(3).alias("priority"),
        F.when(status == "F", F.when(k % 5 == 0, "Closed").otherwise("Resolved")).when(status == "P", "In Progress")
        .otherwise(F.when(k % 3 == 0, "On Hold").otherwise("Open")).alias("state"))


def state_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as ticket updates with a state."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("INC"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0")).alias("number"),
        F.concat("l_linestatus", "l_returnflag").alias("state"), F.col("l_shipdate").cast("timestamp").alias("updated"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
