"""Monitoring figures in SQL."""

from .base import BIG, avgh, inc, pct, pct0, r

MET = "count(*) FILTER (WHERE made_sla_bool)"
DONE = "state IN ('Resolved', 'Closed')"

HEAT = """heat AS (
  SELECT assignment_group AS "group", count(*) FILTER (WHERE priority = 1) AS p1,
         count(*) FILTER (WHERE priority = 2) AS p2, count(*) FILTER (WHERE priority = 3) AS p3,
         count(*) FILTER (WHERE priority = 4) AS p4, count(*) AS total
  FROM inc GROUP BY 1)"""

PAGE = """number, created, impact_user, assignment_group, tower, sdm, category, subcategory, priority,
 priority_label, urgency, state, short_description, made_sla, made_sla_bool, resolved, reopen_count,
 reassignment_count, mttr_hours, assigned_to, resolution_code, resolution_notes"""

SQL = {
    "mon_kpis": inc(f"""SELECT count(*) FILTER (WHERE state IN ('Open','In Progress','On Hold')) AS total_active,
        count(*) AS total_incidents, count(*) FILTER (WHERE priority = 1) AS critical_p1,
        count(*) FILTER (WHERE priority = 2) AS high_p2, count(*) FILTER (WHERE NOT made_sla_bool) AS sla_breaches,
        {pct0(MET, 'count(*)')} AS sla_compliance_pct,
        coalesce({r(avgh(where=DONE))}, 0) AS avg_mttr_hours,
        {BIG('sum(reopen_count)')} AS reopen_count, count(*) FILTER (WHERE state = 'On Hold') AS on_hold,
        {BIG('sum(reassignment_count)')} AS reassignments FROM inc"""),
    "mon_by_group": inc("""SELECT assignment_group AS "group", count(*) FILTER (WHERE state = 'Open') AS open,
        count(*) FILTER (WHERE state = 'In Progress') AS in_progress, count(*) FILTER (WHERE state = 'On Hold') AS on_hold,
        count(*) FILTER (WHERE state = 'Resolved') AS resolved, count(*) FILTER (WHERE state = 'Closed') AS closed,
        count(*) AS total FROM inc GROUP BY 1"""),
    "mon_by_category": inc(f"""SELECT category, count(*) AS count,
        {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage FROM inc GROUP BY category"""),
    "mon_sla_kpi": inc(f"""SELECT count(*) AS total, {MET} AS met, count(*) - {MET} AS breached,
        {pct0(MET, 'count(*)')} AS compliance_pct FROM inc"""),
    "mon_sla_kpi_by_priority": inc(f"""SELECT priority, 'P' || priority AS label, count(*) AS total, {MET} AS met,
        {pct(MET, 'count(*)')} AS compliance FROM inc GROUP BY priority"""),
    "mon_priority_heatmap": inc("SELECT * FROM heat", HEAT),
    "mon_heatmap_top10_others": inc("""SELECT CASE WHEN rn <= 10 THEN "group" ELSE 'Others (' || (n - 10) || ' groups)' END AS "group",
        CAST(sum(p1) AS BIGINT) AS p1, CAST(sum(p2) AS BIGINT) AS p2, CAST(sum(p3) AS BIGINT) AS p3,
        CAST(sum(p4) AS BIGINT) AS p4, CAST(sum(total) AS BIGINT) AS total, rn > 10 AS is_others
        FROM (SELECT *, row_number() OVER (ORDER BY total DESC, "group") AS rn, count(*) OVER () AS n FROM heat)
        GROUP BY 1, rn > 10""", HEAT),
    "top_n_others": inc("""SELECT CASE WHEN rn <= 5 THEN service_offering ELSE 'Others' END AS service_offering,
        CAST(sum(c) AS BIGINT) AS count, CASE WHEN rn <= 5 THEN 0 ELSE count(*) END AS folded
        FROM (SELECT service_offering, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, service_offering) AS rn
              FROM inc WHERE service_offering <> '' GROUP BY 1)
        GROUP BY 1, rn <= 5"""),
    "mon_reopen_monthly": inc("""SELECT month AS period, CAST(sum(reopen_count) AS BIGINT) AS reopen_count, count(*) AS incident_count
        FROM inc WHERE reopen_count > 0 GROUP BY 1"""),
    "mon_reopen_top": inc("""SELECT number, short_description, assignment_group, priority, reopen_count, state
        FROM inc WHERE reopen_count > 0 ORDER BY reopen_count DESC, number LIMIT 10"""),
    "mon_reopen_totals": inc("""SELECT count(*) AS total_reopened, CAST(sum(reopen_count) AS BIGINT) AS total_reopen_events
        FROM inc WHERE reopen_count > 0"""),
    "mon_incidents_page": inc(f"""SELECT {PAGE} FROM inc
        WHERE regexp_matches(number, '(?i)(ring|user7)') OR regexp_matches(short_description, '(?i)(ring|user7)')
              OR regexp_matches(impact_user, '(?i)(ring|user7)')
        ORDER BY mttr_hours DESC NULLS LAST, number LIMIT 50 OFFSET 100"""),
    "mon_incidents_page_total": inc("""SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 50.0) AS BIGINT)) AS total_pages FROM inc
        WHERE regexp_matches(number, '(?i)(ring|user7)') OR regexp_matches(short_description, '(?i)(ring|user7)')
              OR regexp_matches(impact_user, '(?i)(ring|user7)')"""),
    "mon_incidents_after": inc(f"""SELECT {PAGE} FROM inc
        WHERE created < TIMESTAMP '1998-06-01 05:00:00' OR (created = TIMESTAMP '1998-06-01 05:00:00' AND number > 'INC000005000')
        ORDER BY created DESC, number LIMIT 50"""),
    "mon_top_services": inc(f"""SELECT service_offering, count(*) AS count, {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage
        FROM inc WHERE trim(service_offering) <> '' GROUP BY 1 ORDER BY count DESC, service_offering LIMIT 10"""),
    "mon_resolution_codes": inc(f"""SELECT resolution_code, count(*) AS count, {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage
        FROM inc WHERE trim(resolution_code) <> '' GROUP BY 1 ORDER BY count DESC, resolution_code LIMIT 12"""),
    "mon_monthly_volume": inc(f"""SELECT month AS period, count(*) AS total, count(*) FILTER (WHERE {DONE}) AS resolved,
        count(*) FILTER (WHERE reopen_count > 0) AS reopened, {r(avgh())} AS avg_mttr FROM inc GROUP BY 1"""),
    "mon_tower_summary": inc(f"""SELECT tower, count(*) AS total_incidents, count(*) - {MET} AS sla_breached,
        {pct(MET, 'count(*)')} AS compliance_pct, coalesce({r(avgh(where=DONE))}, 0) AS avg_mttr FROM inc GROUP BY 1"""),
    "mon_sdm_summary": inc(f"""SELECT sdm, count(*) AS assignments, coalesce({r(avgh(where=DONE))}, 0) AS avg_mttr,
        {pct(MET, 'count(*)')} AS performance FROM inc GROUP BY 1"""),
    "mon_last_updated": inc("""SELECT number, updated, state, assignment_group, short_description, priority, updated_by
        FROM inc ORDER BY updated DESC, number LIMIT 15"""),
    "doc_heatmap_p1p2": inc("""SELECT *, p1 + p2 AS p1p2 FROM heat ORDER BY p1p2 DESC, "group" LIMIT 15""", HEAT),
}
