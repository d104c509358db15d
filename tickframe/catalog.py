"""Every operator as a named query over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickframe.operators import monitoring as mon
from tickframe.operators import trends as tr
from tickframe.plans import filters as flt
from tickframe.plans import shape
from tickframe.plans.ordered import numbered
from tickframe.sources import testtables as tt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


class Over:
    """An operator applied to one adapted table."""

    def __init__(self, source: Query, fn: Callable[..., DataFrame], kw: dict):
        self.source, self.fn, self.kw = source, fn, kw

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.on(self.source(spark, sf_dir))

    def on(self, df: DataFrame) -> DataFrame:
        return self.fn(df, **self.kw)


def over(source: Query, fn: Callable[..., DataFrame], **kw) -> Query:
    return Over(source, fn, kw)


def inc(fn, **kw) -> Query:
    return over(tt.incidents, fn, **kw)


SEARCH = "(ring|user7)"

QUERIES |= {
    "mon_kpis": inc(mon.kpis),
    "mon_by_group": inc(mon.by_group),
    "mon_by_category": inc(mon.by_category),
    "mon_sla_kpi": inc(mon.sla_kpi),
    "mon_sla_kpi_by_priority": inc(mon.sla_kpi_by_priority),
    "mon_priority_heatmap": inc(mon.priority_heatmap),
    "mon_heatmap_top10_others": inc(mon.heatmap_top_others),
    "top_n_others": inc(lambda df: shape.top_n_others(
        df.where("service_offering <> ''").groupBy("service_offering").agg(F.count("*").alias("count")),
        "service_offering", "count", ["count"], 5)),
    "mon_reopen_monthly": inc(mon.reopen_monthly),
    "mon_reopen_top": inc(mon.reopen_top),
    "mon_reopen_totals": inc(mon.reopen_totals),
    "mon_incidents_page": inc(lambda df: mon.incidents_page(
        flt.filter_search(df, SEARCH), page=3, limit=50, sort_by="mttr_hours")),
    "mon_incidents_page_total": inc(lambda df: mon.incidents_page_total(flt.filter_search(df, SEARCH))),
    "mon_incidents_after": inc(mon.incidents_after, created="1998-06-01 05:00:00", number="INC000005000"),
    "mon_top_services": inc(mon.top_services),
    "mon_resolution_codes": inc(mon.resolution_codes),
    "mon_monthly_volume": inc(mon.monthly_volume),
    "mon_tower_summary": inc(mon.tower_summary),
    "mon_sdm_summary": inc(mon.sdm_summary),
    "mon_last_updated": inc(mon.last_updated),
    "doc_heatmap_p1p2": inc(mon.heatmap_p1p2),
}


def _volume_wide(spark: SparkSession, sf: str) -> DataFrame:
    """A column for each tower of the organisation dimension."""
    towers = sorted(r[0] for r in tt.table(spark, sf, "region").select("r_name").collect())
    counts = (tr._by_period(tt.incidents(spark, sf), "month", "tower").groupBy("period", "tower")
              .agg(F.count("*").alias("count")))
    return shape.long_to_wide(counts, "period", "tower", "count", towers)


QUERIES |= {
    "trend_volume": inc(tr.volume),
    "trend_volume_weekly": inc(tr.volume, granularity="week"),
    "trend_volume_wide": _volume_wide,
    "trend_mttr": inc(tr.mttr),
    "trend_category": inc(tr.category),
    "trend_sla": inc(tr.sla),
    "trend_priority": inc(tr.priority),
    "trend_heatmap_dow_hour": inc(tr.heatmap_dow_hour),
    "trend_reassign_by_group": inc(tr.reassign_by_group),
    "trend_reassign_scatter": inc(tr.reassign_scatter),
    "trend_reassign_bucket": inc(tr.reassign_bucket),
    "trend_forecast": inc(tr.forecast),
    "trend_root_cause": inc(tr.root_cause),
    "trend_volume_by_group": inc(tr.volume_by_group),
    "trend_mttr_by_group": inc(tr.mttr_by_group),
    "trend_series_top_n": inc(tr.series_top_n),
}

from tickframe.operators import breach as bre  # noqa: E402
from tickframe.operators import scorecard as sco  # noqa: E402


def snap(fn, **kw) -> Query:
    return over(tt.breach, fn, **kw)


AT = {"as_of": tt.AS_OF}

QUERIES |= {
    "breach_kpis": snap(bre.kpis, **AT),
    "breach_urgency_breakdown": snap(bre.urgency_breakdown),
    "breach_severity_breakdown": snap(bre.severity_breakdown),
    "breach_timeline": snap(bre.timeline, **AT),
    "breach_sla_compliance": snap(bre.sla_compliance),
    "breach_by_service": snap(bre.by_service),
    "breach_by_group": snap(bre.by_group),
    "breach_elapsed_distribution": snap(bre.elapsed_distribution),
    "breach_age_distribution": snap(bre.age_distribution),
    "breach_age_by_group": snap(bre.age_by_group),
    "breach_age_by_agent": snap(bre.age_by_agent),
    "breach_age_overall": snap(bre.age_overall),
    "breach_reassign_impact": snap(bre.reassign_impact),
    "breach_priority_breakdown": snap(bre.priority_breakdown),
    "breach_on_hold_summary": snap(bre.on_hold_summary, **AT),
    "breach_hold_age": snap(bre.hold_age, **AT),
    "breach_hold_by_group": snap(bre.hold_by_group),
    "breach_kpi_scorecard": snap(bre.kpi_scorecard, **AT),
    "score_summary": inc(sco.summary, **AT),
    "score_rag_counts": inc(sco.rag_counts, **AT),
    "score_by_agent": inc(sco.by_agent),
    "score_by_agent_priority": inc(sco.by_agent_priority),
    "score_monthly": inc(sco.monthly),
    "group_stats": inc(sco.group_stats),
}

from tickframe.functions.numbers import ratio_pct  # noqa: E402
from tickframe.operators import context as ctx  # noqa: E402
from tickframe.operators import insights as ins  # noqa: E402


def _bands(df: DataFrame) -> DataFrame:
    return (df.groupBy(F.col("assignment_group").alias("group"))
            .agg(ratio_pct(F.count_if("made_sla_bool"), F.count("*")).alias("sla"), F.count("*").alias("n"))
            .withColumns({"sla_band": ins.severity_band(F.col("sla"), 60, 50, reverse=True),
                          "load_band": ins.severity_band(F.col("n"), 110, 130)}))


def _route(spark: SparkSession, sf: str) -> DataFrame:
    questions = tt.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return (ctx.route(questions, ctx.facts(tt.incidents(spark, sf)))
            .select("conv_id", "turn", F.concat_ws(",", "sections").alias("sections"), "context"))


RAW: dict[str, Query] = {
    name: (lambda spark, sf, name=name: tt.table(spark, sf, name))
    for name in ("documents", "conversations", "orders", "events", "customer")}


def raw(name: str, fn, **kw) -> Query:
    return over(RAW[name], fn, **kw)


QUERIES |= {
    "insights_monitoring": inc(ins.monitoring),
    "insights_trends": inc(ins.trends),
    "severity_band": inc(_bands),
    "context_facts": inc(ctx.facts),
    "context_route": _route,
    "history_window": raw("conversations", ctx.history_window),
    "history_window_3": raw("conversations", ctx.history_window, n=3),
}

from tickframe.functions import breach_columns as bc  # noqa: E402
from tickframe.functions import buckets as bk  # noqa: E402
from tickframe.functions import clean as cl  # noqa: E402
from tickframe.functions import numbers as num  # noqa: E402
from tickframe.operators import ingest as ing  # noqa: E402
from tickframe.operators import quality as qua  # noqa: E402
from tickframe.schema import CANONICAL_COLUMNS, LOADER_DEFAULTS, sla_contract  # noqa: E402
from tickframe.session import dealt, stored, work_dir  # noqa: E402
from tickframe.sources import files, sinks  # noqa: E402


def pick(source, *cols) -> Query:
    return lambda spark, sf: source(spark, sf).select(*cols)


def messy(*cols) -> Query:
    return lambda spark, sf: (tt.raw_messy(spark, sf).withColumn("k", F.col("file_row").cast("long"))
                              .select("k", *cols))


def _normal(spark: SparkSession, sf: str) -> DataFrame:
    return files.normalize_columns(tt.raw_export(spark, sf))


def _date_texts(df: DataFrame) -> DataFrame:
    k, t = F.col("seq") % 17, F.col("created")
    spellings = ["dd-MM-yyyy HH:mm", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm", "dd-MM-yyyy", "d-M-yyyy H:mm", "d/M/yyyy",
                 "dd-MMM-yyyy HH:mm", "dd.MM.yyyy", "yyyy/MM/dd HH:mm", "yyyyMMdd", "MMM d, yyyy", "d MMMM yyyy h:mm a",
                 "dd-MM-yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss"]
    text = F.when(k == 14, "junk").when(k == 15, "  ").otherwise(F.date_format(t, "MM/28/yyyy"))
    for i, spelling in enumerate(spellings):
        text = F.when(k == i, F.date_format(t, spelling)).otherwise(text)
    return df.select("number", text.alias("raw")).withColumn("parsed", cl.parse_date("raw"))


def _parse_priority(spark: SparkSession, sf: str) -> DataFrame:
    m = messy(F.col("priority").alias("raw"), cl.parse_priority("priority").alias("priority"))(spark, sf)
    raw_order = tt.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), cl.parse_priority("o_orderpriority").alias("order_priority"))
    return m.join(raw_order, "k")


def _clamp(df: DataFrame) -> DataFrame:
    text = F.col("c_acctbal").cast("string")
    return df.select("c_custkey", cl.clamp_numeric(text).alias("floored"), cl.to_number(text).alias("kept"),
                     cl.clamp_numeric("c_name").alias("from_text"))


def _faulty(df: DataFrame) -> DataFrame:
    """Tickets without an owner or a priority, with turned SLA flags and overlong durations."""
    at = lambda n, c, fault: F.when(F.col("seq") % n == 0, fault).otherwise(F.col(c))
    return df.withColumns({
        "tower": at(29, "tower", F.lit(" ")), "sdm": at(31, "sdm", F.lit(None).cast("string")),
        "priority": at(37, "priority", F.lit(None).cast("int")), "made_sla_bool": at(23, "made_sla_bool", ~F.col("made_sla_bool")),
        "mttr_hours": at(41, "mttr_hours", F.col("mttr_hours") + 1000.0)})


def _nan(df: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    v = (F.when(k % 7 == 0, F.lit(float("nan"))).when(k % 11 == 0, F.lit(float("inf")))
         .otherwise(F.col("o_totalprice")))
    return df.select("o_orderkey", num.clean_nan(v).alias("cleaned"), num.clean_nan_zero(v).alias("zeroed"))


_REGISTERS: dict[tuple[str, str], str] = {}


def register(spark: SparkSession, sf: str) -> DataFrame:
    """The incidents as the stored table that filters read in use: written once per session and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _REGISTERS:
        path = work_dir(spark, "register")
        sinks.write_clean(tt.incidents(spark, sf), path)
        _REGISTERS[key] = path
    return sinks.read_clean(spark, _REGISTERS[key])


def filtered(**kw) -> Query:
    return over(register, lambda df: flt.apply_filters(df, kw).select("number", "created"))


def _filter_org(spark: SparkSession, sf: str) -> DataFrame:
    return flt.filter_org(tt.breach(spark, sf), tt.org_map(spark, sf), towers=["ASIA"], sdms=["SDM_3"],
                          date_from="1996-01-01").select("task", "assignment_group")


QUERIES |= {
    "normalize_columns": _normal,
    "fill_defaults": lambda spark, sf: files.fill_defaults(_normal(spark, sf)).select(
        "number", *sorted(LOADER_DEFAULTS)),
    "canonical_select": lambda spark, sf: files.canonical_select(_normal(spark, sf)),
    "parse_date": inc(_date_texts),
    "format_date": inc(lambda df: df.select("number", cl.format_date("resolved").alias("text"))),
    "parse_priority": _parse_priority,
    "parse_urgency": lambda spark, sf: messy(
        F.col("urgency").alias("raw"), cl.parse_urgency("urgency").alias("urgency"))(spark, sf),
    "priority_to_label": lambda spark, sf: messy(
        F.col("priority").alias("raw"), cl.priority_to_label("priority").alias("label"))(spark, sf),
    "parse_sla": lambda spark, sf: messy(
        F.col("made_sla").alias("raw"), cl.parse_sla("made_sla").alias("met"))(spark, sf),
    "normalize_state": lambda spark, sf: messy(
        F.col("state").alias("raw"), cl.normalize_state("state").alias("state"))(spark, sf),
    "clamp_numeric": raw("customer", _clamp),
    "derive_time_parts": pick(tt.incidents, "number", "created", "month", "week", "date", "hour", "dow"),
    "derive_mttr": pick(tt.incidents, "number", "mttr_hours"),
    "derive_breach_flags": pick(tt.breach, "task", "already_breached", "on_hold", "has_bug_link"),
    "derive_overdue_remaining": pick(tt.breach, "task", "overdue_biz_hours", "remaining_biz_hours"),
    "derive_assignment_age": pick(tt.breach, "task", "assignment_age_h"),
    "derive_urgency": pick(tt.breach, "task", "urgency"),
    "derive_sla_severity": pick(tt.breach, "task", "sla_severity"),
    "agent_name": inc(lambda df: df.groupBy(cl.agent_name("assigned_to").alias("agent"))
                      .agg(F.count("*").alias("tickets"))),
    "bucketize": raw("events", lambda df: df.select(
        "event_id", "value", bk.bucketize("value", bk.ELAPSED_EDGES, bk.ELAPSED_LABELS).alias("bucket"))),
    "null_to_none": raw("orders", _nan),
    "audit_required_blank": over(tt.raw_messy, qua.required_blank),
    "audit_value_fixes": over(tt.raw_messy, qua.value_fixes),
    "drop_blank_key": over(tt.raw_messy, lambda df: ing.drop_blank_key(df).select("number", "state")),
    "f1_date_from": filtered(date_from="1998-01-01"),
    "f2_date_to": filtered(date_to="1998-06-30"),
    "f3_towers": filtered(towers=["ASIA", "EUROPE"]),
    "f4_sdms": filtered(sdms=["SDM_1", "SDM_5"]),
    "f5_groups": filtered(groups=["NATION_3-BUILDING", "NATION_7-MACHINERY"]),
    "f6_priorities": filtered(priorities=[1, 2]),
    "f7_categories": filtered(categories=["Network", "General"]),
    "f8_states": filtered(states=["Open", "On Hold"]),
    "f9_sla": filtered(sla="breached"),
    "filter_combined": filtered(date_from="1997-01-01", date_to="1999-12-31", towers=["ASIA"],
                                priorities=[1, 3], states=["Resolved", "Closed"], sla="met"),
    "filter_month_set": filtered(months=["1996-02", "1998-11", "2001-07"]),
    "filter_org": _filter_org,
    "filter_search": inc(lambda df: flt.filter_search(df, "^INC0000000[1-3]")
                         .select("number", "short_description", "impact_user")),
    "filter_options": inc(flt.filter_options),
    "register_presets": inc(flt.register_presets),
    "sla_lookup": lambda spark, sf: tt.incidents(spark, sf).select("number", "priority").join(
        F.broadcast(sla_contract(spark)), "priority", "left"),
    "doc_filtered_of_total": inc(flt.filtered_of_total, filters={"towers": ["ASIA"], "priorities": [1, 2]}),
    "doc_quality_checks": inc(lambda df: qua.quality_checks(_faulty(df))),
}


# ---- sources and sinks: written below the shared work folder, then read back ----

def _write_export(spark: SparkSession, sf: str) -> str:
    path = work_dir(spark, "export")
    tt.raw_export(spark, sf).write.option("header", True).option("escape", '"').csv(path)
    return path


CLEAN_COLUMNS = ["number", "created", "updated", "resolved", "impact_user", "assignment_group",
                 "first_assignment_group", "tower", "sdm", "priority", "priority_label", "urgency",
                 "urgency_label", "state", "made_sla", "made_sla_bool", "category", "subcategory",
                 "service_offering", "short_description", "assigned_to", "month", "week", "date", "hour",
                 "dow", "mttr_hours", "reopen_count", "reassignment_count", "resolution_notes",
                 "business_duration"]


def _src_incidents_csv(spark: SparkSession, sf: str) -> DataFrame:
    return files.read_incidents_csv(spark, _write_export(spark, sf)).select(*CLEAN_COLUMNS)


def _yearly(spark: SparkSession, sf: str) -> list[str]:
    """The export as one upload per year."""
    path = work_dir(spark, "uploads")
    year = F.substring("`Opened At`", 7, 4)
    (tt.raw_export(spark, sf).withColumn("yr", year).hint("rebalance", "yr")
     .write.partitionBy("yr").option("header", True).option("escape", '"').csv(path))
    years = spark.read.option("header", True).csv(path).select("yr").distinct().collect()
    return [f"{path}/yr={y}" for y in sorted(r["yr"] for r in years)]


def _src_multi_file(spark: SparkSession, sf: str) -> DataFrame:
    rows = files.read_many(spark, _yearly(spark, sf))
    return rows.select(F.col("_file").alias("file"), "number", cl.normalize_state("state").alias("state"))


def _lines_register(spark: SparkSession, sf: str) -> DataFrame:
    """A register holding the tickets that have order lines."""
    return tt.ticket_updates(spark, sf).select("number").distinct()


def _audit_file_summary(spark: SparkSession, sf: str) -> DataFrame:
    return qua.file_summary(files.read_many(spark, _yearly(spark, sf)), _lines_register(spark, sf))


def _canonical_audit(spark: SparkSession, sf: str) -> DataFrame:
    paths = _yearly(spark, sf)
    rows = files.read_many(spark, paths).groupBy(F.col("_file").alias("file")).agg(
        F.count("*").alias("rows_in_file"))
    audit = files.file_column_audit(spark, paths)
    lists = ["columns_kept", "columns_added", "columns_dropped"]
    return rows.join(F.broadcast(audit), "file").select(
        "file", "rows_in_file", *[F.concat_ws(",", c).alias(c) for c in lists])


def _src_breach_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = work_dir(spark, "snapshot")
    raw_rows = tt.breach_raw(spark, sf)
    stamp = "yyyy-MM-dd HH:mm:ss"
    cols = [F.date_format(c, stamp).alias(c) if t == "timestamp" else F.col(c).cast("string").alias(c)
            for c, t in raw_rows.dtypes]
    titled = raw_rows.select(*cols).toDF(*[c.replace("_", " ").title() for c in raw_rows.columns])
    titled.write.option("header", True).csv(path)
    return files.read_breach_csv(spark, path, tt.AS_OF).select(
        "task", "priority", "priority_num", "state", "created", "breach_time", "stop_time",
        "last_assignment_date", "business_elapsed_percentage", "already_breached", "on_hold",
        "has_bug_link", "overdue_biz_hours", "remaining_biz_hours", "assignment_age_h", "breach_date",
        "urgency", "sla_severity", "sla_resolution_hours", "reassignment_count", "reopen_count")


def _src_org_map(spark: SparkSession, sf: str) -> DataFrame:
    path = work_dir(spark, "org")
    org = tt.org_map(spark, sf)
    org.unionByName(org).write.option("header", True).csv(path)
    return files.read_org_map(spark, path)


def _src_json(spark: SparkSession, sf: str) -> DataFrame:
    path = work_dir(spark, "json")
    tt.table(spark, sf, "events").select(
        F.col("event_id").alias("Event-ID"), F.col("user_id").alias("USER ID"), "event_type", "value",
        F.col("props").alias("Raw.Props")).write.json(path)
    return files.read_json(spark, path, "`Event-ID` long, `USER ID` long, event_type string, "
                                        "value double, `Raw.Props` string")


def _src_encoding(spark: SparkSession, sf: str) -> DataFrame:
    path = work_dir(spark, "latin1")
    (tt.table(spark, sf, "conversations").write.option("header", True).option("encoding", "ISO-8859-1")
     .option("escape", '"').csv(path))
    return files.read_csv(spark, path).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")


def _sink_clean(spark: SparkSession, sf: str) -> DataFrame:
    path = work_dir(spark, "register")
    sinks.write_clean(tt.incidents(spark, sf), path)
    return sinks.read_clean(spark, path).select(
        "number", "month", "state", "priority", "made_sla", "category", "created", "mttr_hours", "tower")


def _sink_append_new(spark: SparkSession, sf: str) -> DataFrame:
    """Older tickets first, then the whole register twice: each ticket is stored once."""
    path = work_dir(spark, "register")
    df = tt.incidents(spark, sf)
    # Every fifth ticket comes twice in each upload, the older row after the newer one.
    older = df.where("seq % 5 = 0").withColumns({"updated": F.col("updated") - F.expr("INTERVAL 1 DAY"), "state": F.lit("Old")})
    df = stored(df.unionByName(older).unionByName(df.limit(3).withColumn("number", F.lit(" "))), "upload")
    sinks.append_new(spark, df.where("created < '1999-01-01'"), path, mode="replace")
    for _ in range(2):
        sinks.append_new(spark, df, path)
    return sinks.read_clean(spark, path).groupBy("month").agg(
        F.count("*").alias("rows"), F.count_distinct("number").alias("tickets"),
        F.count_if(F.col("state") == "Old").alias("old_rows"))


def _sink_export_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = work_dir(spark, "view")
    sinks.export_csv(tt.incidents(spark, sf), path)
    back = files.read_csv(spark, path).drop("_pos")
    filled = {c: F.coalesce(F.col(c), F.lit("")) for c in back.columns}
    return back.withColumns(filled).withColumn("mttr_hours", F.nullif("mttr_hours", F.lit("")).cast("double"))


QUERIES |= {
    "src_incidents_csv": _src_incidents_csv,
    "src_breach_csv": _src_breach_csv,
    "src_org_map": _src_org_map,
    "src_json": _src_json,
    "src_multi_file": _src_multi_file,
    "src_encoding": _src_encoding,
    "audit_file_summary": _audit_file_summary,
    "canonical_audit": _canonical_audit,
    "sink_clean": _sink_clean,
    "sink_append_new": _sink_append_new,
    "sink_export_csv": _sink_export_csv,
    "source_inventory": inc(lambda df: sinks.source_inventory(df.select(
        F.concat(F.lit("export_"), F.substring("month", 1, 4), F.lit(".csv")).alias("source"),
        F.lit("incidents").alias("type"), F.col("updated").alias("ingested_at")))),
}


# ---- dedup, merge, link, set operations, window kinds ----

def _known(which: int) -> Query:
    return lambda spark, sf: ing.split_known(
        tt.incidents(spark, sf), _lines_register(spark, sf))[which].select("number", "state")


def _union_files(spark: SparkSession, sf: str) -> DataFrame:
    return ing.union_files(
        tt.incidents(spark, sf).select("number", "state"),
        tt.breach(spark, sf).select(F.col("task").alias("number"), "state", "business_elapsed_percentage"),
        tt.surveys(spark, sf).select(F.col("incident_number").alias("number"), "csat_score"))


def _urgent(spark: SparkSession, sf: str) -> DataFrame:
    return tt.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("c_custkey"))


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return tt.table(spark, sf, "customer").select("c_custkey", "c_name")


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    number = F.concat(F.lit("INC"), F.lpad((F.col("l_orderkey") * 3).cast("string"), 9, "0"))
    return tt.table(spark, sf, "lineitem").select(number.alias("incident_ref"), "l_quantity")


def _ranking(df: DataFrame) -> DataFrame:
    counts = df.groupBy(F.col("assignment_group").alias("group")).agg(F.count("*").alias("count"))
    return numbered(counts, [F.desc("count"), F.asc("group")])


def _running(df: DataFrame) -> DataFrame:
    w = Window.partitionBy().orderBy(F.desc("count"), "category").rowsBetween(Window.unboundedPreceding, 0)
    counts = df.groupBy("category").agg(F.count("*").alias("count"))
    return counts.withColumn("running", F.sum("count").over(w))


def _grouping_sets(df: DataFrame) -> DataFrame:
    return (df.rollup("tower", "category").agg(F.count("*").alias("count"))
            .withColumns({c: F.coalesce(F.col(c), F.lit("ALL")) for c in ("tower", "category")}))


QUERIES |= {
    "dedup_keep_last": over(tt.ticket_updates, ing.dedup_keep_last, order=tt.UPDATE_ORDER),
    "dedup_removed": over(tt.ticket_updates, ing.dedup_removed),
    "dedup_cross_file": over(tt.ticket_updates, ing.dedup_keep_last, order=["file_rank", *tt.UPDATE_ORDER]),
    "dedup_vs_existing": _known(0),
    "dedup_existing_list": _known(1),
    "merge_incidents": lambda spark, sf: ing.merge_incidents(
        tt.incidents(spark, sf).select("number"), _lines_register(spark, sf)),
    "union_existing": lambda spark, sf: ing.union_existing(
        _lines_register(spark, sf), tt.incidents(spark, sf).select("number", "state")),
    "union_files": _union_files,
    "except_by_key": lambda spark, sf: ing.except_by_key(_customers(spark, sf), _urgent(spark, sf), "c_custkey"),
    "intersect_by_key": lambda spark, sf: ing.intersect_by_key(
        _customers(spark, sf), _urgent(spark, sf), "c_custkey"),
    "link_surveys": lambda spark, sf: ing.link_counts(tt.surveys(spark, sf), tt.incidents(spark, sf)),
    "link_sla_breach": lambda spark, sf: ing.link_counts(
        tt.breach(spark, sf).withColumn("number", F.when(F.col("seq") % 6 == 0, F.concat(F.lit("OLD"), "task")).otherwise(F.col("task"))).drop("task"),
        tt.incidents(spark, sf)),
    "link_metrics": lambda spark, sf: ing.link_counts(
        _metrics(spark, sf), tt.incidents(spark, sf), count_skipped=False),
    "link_scores": lambda spark, sf: ing.link_scores(
        tt.incidents(spark, sf), tt.surveys(spark, sf), "csat_score").select(
        "number", "priority", F.col("score_count").cast("double").alias("score_count"), "score_max", "score_min"),
    "breach_group_join": QUERIES["breach_by_group"],
    "mttr_overall_join": QUERIES["trend_mttr"],
    "top_k": inc(lambda df: df.where(mon.active()).select("number", "priority", "created")
                 .orderBy("priority", "created", "number").limit(5)),
    "cumulative_sum": inc(_running),
    "share_of_total": inc(lambda df: shape.with_share(
        df.groupBy("tower").agg(F.count("*").alias("count")))),
    "lag_last_vs_previous": inc(lambda df: tr.monthly_counts(df).withColumn(
        "previous", F.lag("count").over(Window.partitionBy().orderBy("period")).cast("double"))),
    "ranking": inc(_ranking),
    "grouping_sets": inc(_grouping_sets),
    "distinct_count": inc(lambda df: df.groupBy("month").agg(
        F.count_distinct("assignment_group").alias("groups"))),
    "sample": inc(lambda df: df.select("number").orderBy(F.md5("number"), "number").limit(500)),
}

from tickframe.functions import rules  # noqa: E402
from tickframe.operators import audit as aud  # noqa: E402
from tickframe.operators import text as txt  # noqa: E402


# A phrase of a ticket for every rule, added to the documents' invented prose.
PHRASES = [
    'login with badge and permission', 'permission denied for this role', 'certif renewal needs access',
     'account lock after login', 'badge and role access', 'error, it went wrong and is not working',
     'crash, very slow, cannot go on', 'crash and unable to start', 'report with data fetch to export',
     'upload of a document', 'validation of the export, rejected', 'new user onboard, profile for a joiner',
     'vpn, wifi and dns', 'laptop, printer and monitor', 'install software and a patch',
     'update to this software version', 'license for the software patch',
     'server, storage and backup of the database', 'enhancement in the product backlog, a feature request',
     'provision of materials management', 'complete failure and total outage', 'significant delay',
     'significant for multiple users', 'how to, an inquiry and a question', 'nothing of note']


def phrased(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Half of the check of the keyword rules is these phrases: the invented prose rarely meets a rule."""
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.floor(F.col(key) / 2) % len(PHRASES) + 1).cast("int"))
    return df.withColumn(text, F.concat(text, F.lit(" "), phrase))


def spoken(df: DataFrame) -> DataFrame:
    """Tickets that say what the audit looks for, so that every verdict occurs."""
    return phrased(df, "short_description", "seq")


def _category_table(spark: SparkSession, sf: str) -> DataFrame:
    """Generic rules with a caller's table added: another category, another word."""
    own = spark.createDataFrame([("Parts", "Ring"), ("Parts", "bolt "), ("Network", "the that")], "category string, keyword string")
    return tt.table(spark, sf, "documents").select(
        "doc_id", rules.classify_category("text", rules.rules_from_table(own)).alias("category"))


def _documents_as_tickets(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit("DOC"), F.col("doc_id").cast("string")).alias("number"),
                     F.col("text").alias("short_description"), F.col("source").alias("service_offering"),
                     (F.col("doc_id") % 2 + 1).cast("int").alias("priority"))


def _subcategory(df: DataFrame) -> DataFrame:
    return phrased(df).select("doc_id", "text", rules.classify_category("text").alias("category")).select(
        "doc_id", "category", rules.classify_subcategory("category", "text").alias("subcategory"))


def with_text(df: DataFrame) -> DataFrame:
    """Incidents with the text that classifiers and features read."""
    return df.withColumn("text", rules.incident_text("short_description", "service_offering", "category"))


def spread(df: DataFrame) -> DataFrame:
    """A text multiplies into its terms, but a small file is one task: dealt to all cores first."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def spread_file(df: DataFrame) -> DataFrame:
    """``spread``, but a file read by as many tasks as there are cores stays as it is."""
    return df if df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism else spread(df)


def _articles(spark: SparkSession, sf: str) -> DataFrame:
    return tt.table(spark, sf, "documents")


def _similar(spark: SparkSession, sf: str) -> DataFrame:
    return txt.similar(tt.table(spark, sf, "benchmark"), _articles(spark, sf),
                       "item_id", "doc_id")


def _similar_tickets(spark: SparkSession, sf: str) -> DataFrame:
    """For every open ticket of highest priority the done ones most like it."""
    show = ["short_description", "category", "priority", "state", "assignment_group", "resolution_notes", "mttr_hours"]
    df = stored(with_text(tt.incidents(spark, sf)).where((F.col("state") == "Open") | F.col("state").isin(cl.DONE_STATES)).select(
        "number", "text", *show), "tickets")
    asked = df.where("state = 'Open' AND priority = 1").select(F.col("number").alias("asked"), "text")
    done = df.where(F.col("state").isin(cl.DONE_STATES)).select(
        "number", "text", "short_description", "category", "priority", "state", F.col("assignment_group").alias("group"),
        F.substring("resolution_notes", 1, 250).alias("resolution"), F.bround("mttr_hours", 1).alias("mttr_hours"))
    return txt.similar_incidents(asked, done, "asked", "number", description="short_description",
                                 show=("category", "priority", "state", "group", "resolution", "mttr_hours"))


def _kb(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest article for every user message."""
    asked = tt.table(spark, sf, "conversations").where("role = 'user'").select(
        F.concat_ws("-", "conv_id", "turn").alias("ticket"), "text")
    return txt.similar(asked, _articles(spark, sf), "ticket", "doc_id", k=1).select(
        "ticket", F.col("doc_id").alias("article"), F.bround("score", 3).alias("similarity"))


QUERIES |= {
    "classify_category": raw("documents", lambda df: phrased(df).select(
        "doc_id", rules.classify_category("text").alias("category"))),
    "classify_category_table": _category_table,
    "classify_category_import": raw("documents", lambda df: phrased(df).select(
        "doc_id", rules.classify_category("text", rules.CATEGORY_KEYWORDS_IMPORT).alias("category"))),
    "classify_subcategory": raw("documents", _subcategory),
    "audit_priority_rules": inc(lambda df: aud.rule_audit(spoken(df))),
    "audit_document_rules": raw("documents", lambda df: aud.rule_audit(_documents_as_tickets(phrased(df))).drop(
        "short_description", "service_offering")),
    "audit_sample": inc(lambda df: aud.rule_audit(aud.sample(spoken(df)))),
    "union_sample": inc(lambda df: aud.sample(df).select("number", "priority")),
    "audit_summary": inc(lambda df: aud.summary(aud.rule_audit(spoken(df)))),
    "audit_prompts": inc(aud.prompts),
    "priority_definitions": lambda spark, sf: (
        tt.incidents(spark, sf).groupBy("priority").agg(F.count("*").alias("tickets"))
        .join(F.broadcast(aud.priority_definitions(spark)), "priority").select("priority", "label", "tickets")),
    "text_features": inc(lambda df: txt.text_features(spread(with_text(df).select("number", "text")), "number", "text").withColumn(
        "weight", F.round("weight", 9))),
    "text_features_documents": raw("documents", lambda df: txt.text_features(spread_file(df.select("doc_id", "text")), "doc_id", "text")
                                   .groupBy("doc_id").agg(F.count("*").alias("terms"),
                                                          F.round(F.sum("weight"), 6).alias("total"),
                                                          F.max("term").alias("last_term"))),
    "similar_incidents": lambda spark, sf: txt.similar_incidents(
        tt.table(spark, sf, "benchmark"), _articles(spark, sf), "item_id", "doc_id",
        show=("source", "lang")),
    "similarity_join": lambda spark, sf: _similar(spark, sf).select(
        F.col("item_id").alias("qid"), F.col("doc_id").alias("did"), "rank",
        F.bround("score", 3).alias("similarity")),
    "doc_kb_recommender": _kb,
    "similar_tickets": _similar_tickets,
}

from tickframe.operators import classify as cls  # noqa: E402
from tickframe.operators import documented as doc  # noqa: E402


def _uneven_queues(snapshot: DataFrame) -> DataFrame:
    """Each group as one long queue and six short ones, so that each alert has queues with and without it."""
    part = F.least(F.col("seq") % 13, F.lit(6)).cast("string")
    return snapshot.withColumn("assignment_group", F.concat("assignment_group", F.lit("/"), part))


def _slow_and_fast(df: DataFrame) -> DataFrame:
    """Towers as groups, two of them ten and five times as fast as they were, in whole seconds."""
    faster = F.when(F.col("tower") == "AFRICA", 10).when(F.col("tower") == "AMERICA", 5).otherwise(1)
    seconds = F.floor(F.round(F.col("mttr_hours") * 3600.0) / faster)
    return df.withColumns({"assignment_group": F.col("tower"), "mttr_hours": seconds.cast("double") / 3600.0})


QUERIES |= {
    "doc_rolling_7d": inc(doc.rolling_7d),
    "doc_growth": inc(doc.growth),
    "doc_mttr_variance_slope": inc(doc.mttr_variance_slope),
    "doc_category_share": inc(doc.category_share),
    "doc_reassign_rate_impact": inc(doc.reassign_rate_impact),
    "doc_first_assignment_right": inc(doc.first_assignment_right),
    "doc_tower_sdm_compare": inc(doc.tower_sdm_compare),
    "doc_composite_score": inc(doc.composite_score),
    "doc_pareto_80": inc(doc.pareto_80),
    "doc_ownership_bands": snap(doc.ownership_bands),
    "doc_aging_bands": inc(doc.aging_bands, **AT),
    "doc_class_metrics": inc(cls.class_metrics, actual="priority", predicted="urgency"),
    "doc_confusion": inc(lambda df: cls.confusion(aud.rule_audit(spoken(df)), "current_priority", "suggested_priority")),
    "doc_burndown": inc(doc.burndown),
    "doc_affinity": inc(doc.affinity),
    "doc_agent_ownership": snap(doc.agent_ownership),
    "doc_queue_alerts": snap(lambda df: doc.queue_alerts(_uneven_queues(df))),
    "doc_sla_variance": inc(doc.sla_variance),
    "doc_cost": inc(doc.cost, rates={1: 120, 2: 90, 3: 60, 4: 45}),
    "doc_reassign_causes": inc(doc.reassign_causes, text="short_description",
                               causes={"parts": ["ring", "bolt"], "colour": ["red"]}),
    "doc_tower_card": inc(doc.tower_card),
    "doc_mttr_band": inc(lambda df: doc.mttr_band(_slow_and_fast(df))),
    "doc_mttr_quantiles": inc(doc.mttr_quantiles),
}

# ---- classifiers: one fit per session, data and label ----

_MODELS: dict[tuple[str, str, str], cls.TextModel | None] = {}


def _model(spark: SparkSession, sf: str, label: str) -> cls.TextModel | None:
    key = (spark.sparkContext.applicationId, sf, label)
    if key not in _MODELS:
        where = F.col("category") != "General" if label == "category" else None
        _MODELS[key] = cls.train(with_text(tt.incidents(spark, sf)), label, where=where)
    return _MODELS[key]


def _request_text(spark: SparkSession, sf: str) -> DataFrame:
    """What a caller sends: description and service, without the category."""
    return tt.incidents(spark, sf).withColumn(
        "text", rules.incident_text("short_description", "service_offering"))


def _train(label: str) -> Query:
    return lambda spark, sf: cls.training_report(tt.incidents(spark, sf), _model(spark, sf, label), label)


def _predict_priority(spark: SparkSession, sf: str) -> DataFrame:
    hinted = _request_text(spark, sf).withColumn("hint", F.when(F.col("seq") % 10 == 0, F.lit(1)))
    return cls.predict_priority(_model(spark, sf, "priority"), hinted, hint="hint")


def _model_metrics(spark: SparkSession, sf: str) -> DataFrame:
    df = tt.incidents(spark, sf)
    unseen = _request_text(spark, sf).where(cls.held_out())
    predicted = cls.predict_category(_model(spark, sf, "category"), unseen)
    pairs = df.select("number", F.col("category").alias("actual")).join(predicted, "number")
    return cls.class_metrics(pairs, "actual", "category")


# What a ticket of each priority says, added to the text so that wrong priorities can be told.
SAID = ["complete outage of production", "degraded service for many users", "single user affected", "question about usage"]


def _wrong_priorities(spark: SparkSession, sf: str) -> DataFrame:
    """Tickets that speak of their priority, one in 256 filed under another."""
    df = tt.incidents(spark, sf)
    said = F.element_at(F.array(*map(F.lit, SAID)), F.col("priority"))
    wrong = F.substring(F.md5("number"), 1, 2) == "00"
    return df.select("number", F.concat_ws(" ", "short_description", said).alias("text"),
                     F.when(wrong, F.col("priority") % 4 + 1).otherwise(F.col("priority")).alias("priority"))


def _planted_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    df = stored(_wrong_priorities(spark, sf), "wrong_priorities")
    return cls.priority_mismatch(cls.cross_predict_priority(df, df), df).select("number", "assigned", "predicted")


def _telling(spark: SparkSession, sf: str) -> DataFrame:
    """Tickets whose text says their priority and their group."""
    df = tt.incidents(spark, sf)
    said = F.element_at(F.array(*map(F.lit, SAID)), F.col("priority"))
    return df.select("number", F.concat_ws(" ", "short_description", said, F.lit("for"), F.regexp_replace("assignment_group", "[^A-Za-z0-9_]+", "")).alias("text"),
                     "priority", "assignment_group")


def _told(label: str, answer: Callable[[cls.TextModel, DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = dealt(_telling(spark, sf), "telling")
        return answer(cls.train(df, label), df)

    return run


def _known_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted categories of the tickets that have one."""
    asked = _request_text(spark, sf).where("category <> 'General'").select("number", "text")
    return cls.predict_category(_model(spark, sf, "category"), asked).select("number", "category")


QUERIES |= {
    "train_priority_planted": _told("priority", lambda m, df: cls.training_report(df, m, "priority")),
    "train_group_planted": _told("assignment_group", lambda m, df: cls.training_report(df, m, "assignment_group")),
    "predict_priority_planted": _told("priority", lambda m, df: cls.predict_priority(m, df).select("number", "priority", "priority_label")),
    "predict_group_planted": _told("assignment_group", lambda m, df: cls.score(m, df, ["number"]).select(
        "number", F.col("ranked")[0]["class"].alias("group"))),
    "predict_category_known": _known_categories,
    "doc_priority_mismatch_planted": _planted_mismatch,
    "train_category": _train("category"),
    "train_priority": _train("priority"),
    "train_group": _train("assignment_group"),
    "predict_category": lambda spark, sf: cls.predict_category(
        _model(spark, sf, "category"), _request_text(spark, sf)),
    "predict_priority": _predict_priority,
    "predict_group_topk": lambda spark, sf: cls.predict_group_topk(
        _model(spark, sf, "assignment_group"), with_text(tt.incidents(spark, sf)),
        sco.group_stats(tt.incidents(spark, sf))),
    "model_metrics": _model_metrics,
    "doc_priority_mismatch": lambda spark, sf: cls.priority_mismatch(
        cls.cross_predict_priority(with_text(tt.incidents(spark, sf)), _request_text(spark, sf)),
        tt.incidents(spark, sf)),
}

from tickframe.streaming import jobs  # noqa: E402


def streamed(build: Callable[[SparkSession, str], DataFrame], name: str, mode: str = "update",
             keys: list[str] | None = None) -> Query:
    """Run a stream over what is available and read its changelog back."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        base = work_dir(spark, name)
        query = jobs.to_changelog(build(spark, sf), f"{base}/out", f"{base}/checkpoint", mode)
        query.awaitTermination()
        return jobs.read_changelog(spark, f"{base}/out", keys)

    return run


def _some_older(export: DataFrame) -> DataFrame:
    """Tickets whose number ends in 7 come a second time, as they were before."""
    times = F.when(F.substring("number", -1, 1) == "7", F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    older = F.col("_older")
    return export.withColumn("_older", F.explode(times)).withColumns({
        "updated": F.when(older, "1990-01-01 00:00:00").otherwise(F.col("updated")),
        "state": F.when(older, "new").otherwise(F.col("state"))}).drop("_older")


def _arrive(rows: DataFrame, folder: str, *by: str) -> int:
    """Rows written as files for a stream, dealt by columns; how many files make a third of them."""
    rows.repartition(max(6, 2 * rows.sparkSession.sparkContext.defaultParallelism), *by).write.parquet(folder)
    return -(-len(rows.sparkSession.read.schema(rows.schema).parquet(folder).inputFiles()) // 3)


def _stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """The export arrives in files, in three batches, some tickets twice; each is stored once, as last updated."""
    base = work_dir(spark, "stream_ingest")
    export = files.normalize_columns(tt.raw_export(spark, sf))
    third = _arrive(_some_older(export), f"{base}/in", "number")
    raw_stream = jobs.read_files(spark, f"{base}/in", export.schema, files_per_batch=third)
    jobs.ingest(raw_stream, files.clean_incidents, f"{base}/table", f"{base}/checkpoint",
                order=["updated"]).awaitTermination()
    return sinks.read_clean(spark, f"{base}/table").select(
        "number", "month", "state", "priority", "made_sla", "category", "created", "mttr_hours", "tower")


def _twice(spark: SparkSession, sf: str) -> DataFrame:
    """Every event delivered twice."""
    both = tt.event_stream(spark, sf).union(tt.event_stream(spark, sf))
    return jobs.dedup(both, ["event_id"], "ts").select("event_id", "user_id", "event_type", "value")


def _latest_store(spark: SparkSession, sf: str) -> DataFrame:
    """Updates arrive in files, in three batches; later batches bring older and newer rows of known tickets."""
    base = work_dir(spark, "stream_latest")
    updates = tt.state_updates(spark, sf)
    third = _arrive(updates, f"{base}/in", "number", "updated", "l_linenumber")
    jobs.latest_store(jobs.read_files(spark, f"{base}/in", updates.schema, files_per_batch=third), "number", "state",
                      tt.UPDATE_ORDER + ["state"], f"{base}/store", f"{base}/checkpoint", buckets=16).awaitTermination()
    return jobs.read_latest(spark, f"{base}/store", "number")


QUERIES |= {
    "stream_ingest": _stream_ingest,
    "stream_dedup": streamed(_twice, "stream_dedup", "append"),
    "stream_kpis_tumbling": streamed(lambda spark, sf: jobs.tumbling_kpis(tt.event_stream(spark, sf)),
                                     "stream_kpis", keys=["start", "event_type"]),
    "stream_volume_sliding": streamed(lambda spark, sf: jobs.sliding_volume(tt.event_stream(spark, sf)),
                                      "stream_sliding", keys=["start"]),
    "stream_sessions": streamed(lambda spark, sf: jobs.sessions(tt.event_stream(spark, sf)),
                                "stream_sessions", "append"),
    "stream_aging_alerts": streamed(lambda spark, sf: jobs.aging_alerts(tt.order_stream(spark, sf), tt.AS_OF),
                                    "stream_aging", "append"),
    "stream_latest_state": _latest_store,
}
