"""SLA-breach risk in SQL."""

from .base import AS_OF, BIG, avg4, br, pct, r

LATE = "count(*) FILTER (WHERE already_breached)"
HOLD = "count(*) FILTER (WHERE on_hold)"
DAYS = f"greatest(CAST(date_diff('second', created, {AS_OF}) AS DOUBLE) / 3600.0 / 24.0, 0)"
HOLD_DAYS = (f"round_even(greatest(coalesce(CAST(date_diff('second', stop_time, {AS_OF}) AS DOUBLE) / 3600.0 / 24.0, 0), 0), 1)")


def z(x: str) -> str:
    return f"coalesce({r(x)}, CAST(0 AS DOUBLE))"


def bins(x, edges, labels):
    whens = " ".join(f"WHEN {x} > {a}" + (f" AND {x} <= {b}" if b is not None else "") + f" THEN '{label}'"
                     for a, b, label in zip(edges, edges[1:], labels))
    return f"CASE {whens} END"


def rank(x, labels):
    whens = " ".join(f"WHEN '{label}' THEN {i + 1}" for i, label in enumerate(labels))
    return f"CASE {x} {whens} END"


EL = ['0–25% Healthy', '25–50% Caution', '50–75% Elevated', '75–90% At Risk', '90–100% Critical', '>100% Breached']
AL = ['<4h', '4–8h', '8–24h', '1–3 days', '3–7 days', '>7 days']
HL = ['<1 day', '1–3 days', '3–7 days', '7–14 days', '14–30 days', '>30 days']
ELB = bins("pct", [0, 25, 50, 75, 90, 100, None], EL)
ALB = bins("assignment_age_h", [0, 4, 8, 24, 72, 168, None], AL)
HLB = bins("hd", [0, 1, 3, 7, 14, 30, None], HL)
CON = "(VALUES (1, 4, '4 hours'), (2, 8, '8 hours'), (3, 72, '72 business hours'), (4, 120, '120 business hours')) AS c(p, h, l)"

SQL = {
    "breach_kpis": br(f"""SELECT count(*) AS total, {LATE} AS already_breached, {pct(LATE, 'count(*)')} AS breached_pct,
        {HOLD} AS on_hold, {pct(HOLD, 'count(*)')} AS on_hold_pct, count(*) FILTER (WHERE on_hold AND pct >= 75) AS hold_restart_risk,
        count(*) FILTER (WHERE priority_num <= 2) AS critical_high,
        count(*) FILTER (WHERE NOT already_breached AND NOT on_hold AND remaining_biz_hours <= 24) AS breaching_24h,
        {z(avg4('pct'))} AS avg_elapsed_pct, {z(avg4('overdue_biz_hours', 'already_breached'))} AS avg_overdue_hours,
        {z(avg4('assignment_age_h'))} AS avg_assignment_age_h, count(*) FILTER (WHERE has_bug_link) AS bug_linked,
        count(*) FILTER (WHERE {DAYS} > 30) AS over_30_days, CAST(95 AS DOUBLE) AS aging_kpi_target_pct FROM brx"""),
    "breach_urgency_breakdown": br("SELECT urgency, count(*) AS count FROM brx GROUP BY 1"),
    "breach_severity_breakdown": br("SELECT sla_severity, count(*) AS count FROM brx GROUP BY 1"),
    "breach_timeline": br(f"""SELECT breach_date AS date, count(*) AS count, {LATE} AS already_breached, count(*) - {LATE} AS upcoming,
        breach_date = '2001-08-02' AS is_today, breach_date < '2001-08-02' AS is_past, breach_date > '2001-08-02' AS is_future
        FROM brx WHERE breach_date BETWEEN '2001-07-26' AND '2001-08-16' GROUP BY breach_date"""),
    "breach_sla_compliance": br(f"""SELECT priority_num AS priority, l AS sla_label, h AS sla_hours, h || 'h' AS sla_target,
        count(*) AS total, count(*) - {LATE} AS compliant, {LATE} AS breached, {pct(f'count(*) - {LATE}', 'count(*)')} AS compliance_pct,
        {z(avg4('pct'))} AS avg_elapsed_pct, {z(avg4('overdue_biz_hours', 'already_breached'))} AS avg_overdue_hours
        FROM brx JOIN {CON} ON priority_num = p GROUP BY priority_num, l, h"""),
    "breach_by_service": br(f"""SELECT service_offering, count, already_breached, avg_elapsed_pct, on_hold_count, avg_overdue_hours,
        {pct('count', 'al')} AS pct_total,
        {pct('sum(count) OVER (ORDER BY count DESC, service_offering ROWS UNBOUNDED PRECEDING)', 'al')} AS cumulative_pct
        FROM (SELECT service_offering, count(*) AS count, {LATE} AS already_breached, {r(avg4('pct'))} AS avg_elapsed_pct,
                     {HOLD} AS on_hold_count, {z(avg4('overdue_biz_hours'))} AS avg_overdue_hours, (SELECT count(*) FROM brx) AS al
              FROM brx WHERE service_offering IS NOT NULL GROUP BY 1 ORDER BY count DESC, service_offering LIMIT 12)"""),
    "breach_by_group": br(f"""SELECT assignment_group AS "group", {HOLD} AS on_hold, count(*) FILTER (WHERE state = 'In Progress') AS in_progress,
        count(*) AS total, {r(avg4('pct'))} AS avg_elapsed_pct, {LATE} AS already_breached,
        count(*) FILTER (WHERE priority_num <= 2) AS critical_high, {z(avg4('assignment_age_h'))} AS avg_assignment_age_h
        FROM brx GROUP BY 1"""),
    "breach_elapsed_distribution": br(f"""SELECT range, "group", c AS count, CAST(sum(c) OVER (PARTITION BY range) AS BIGINT) AS total,
        {rank('range', EL)} AS range_order
        FROM (SELECT {ELB} AS range, assignment_group AS "group", count(*) AS c FROM brx GROUP BY 1, 2) WHERE range IS NOT NULL"""),
    "breach_age_distribution": br(f"""SELECT bucket, count(*) FILTER (WHERE state = 'On Hold') AS on_hold,
        count(*) FILTER (WHERE state = 'In Progress') AS in_progress, count(*) AS total, {rank('bucket', AL)} AS bucket_order
        FROM (SELECT *, {ALB} AS bucket FROM brx) WHERE bucket IS NOT NULL GROUP BY bucket"""),
    "breach_age_by_group": br(f"""SELECT assignment_group AS "group", {r(avg4('assignment_age_h'))} AS avg_age_h,
        {r('max(assignment_age_h)')} AS max_age_h, count(*) FILTER (WHERE assignment_age_h > 168) AS over_7d, count(*) AS count
        FROM brx WHERE assignment_age_h IS NOT NULL GROUP BY 1"""),
    "breach_age_by_agent": br(f"""SELECT agent_name, round_even(m, 1) AS avg_age_h, max_age_h, count, already_breached FROM (
        SELECT CASE WHEN contains(assigned_to, '(') THEN rtrim(split_part(assigned_to, '(', 1)) ELSE assigned_to END AS agent_name,
               {avg4('assignment_age_h')} AS m, max(assignment_age_h) AS max_age_h, count(*) AS count, {LATE} AS already_breached
        FROM brx WHERE assignment_age_h IS NOT NULL GROUP BY 1 ORDER BY m DESC, agent_name LIMIT 10)"""),
    "breach_age_overall": br(f"""SELECT {z(avg4('assignment_age_h'))} AS overall_avg_age_h, {z('max(assignment_age_h)')} AS overall_max_age_h,
        count(*) FILTER (WHERE assignment_age_h > 168) AS over_7d_count FROM brx"""),
    "breach_reassign_impact": br(f"""SELECT reassignment_count, count(*) AS count, {r(avg4('pct'))} AS avg_elapsed_pct,
        {pct(LATE, 'count(*)')} AS breach_rate, {z(avg4('assignment_age_h'))} AS avg_assignment_age_h FROM brx GROUP BY 1"""),
    "breach_priority_breakdown": br(f"""SELECT priority, count(*) AS count, {LATE} AS already_breached, {r(avg4('pct'))} AS avg_elapsed_pct,
        {z(avg4('overdue_biz_hours'))} AS avg_overdue_hours, {pct(LATE, 'count(*)')} AS breach_rate, l AS sla_resolution_label,
        h AS sla_resolution_hours FROM brx JOIN {CON} ON priority_num = p GROUP BY priority, l, h"""),
    "breach_on_hold_summary": br(f"""SELECT {HOLD} AS total_on_hold, count(*) - {HOLD} AS total_in_progress, {pct(HOLD, 'count(*)')} AS on_hold_pct,
        {z(avg4('hd', 'on_hold'))} AS avg_hold_days, {z(avg4('pct', 'on_hold'))} AS avg_elapsed_on_hold,
        {z(avg4('pct', 'NOT on_hold'))} AS avg_elapsed_in_prog, count(*) FILTER (WHERE on_hold AND pct >= 75) AS restart_risk_count
        FROM (SELECT *, {HOLD_DAYS} AS hd FROM brx)"""),
    "breach_hold_age": br(f"""SELECT age_bucket, count(*) AS count, age_bucket IN ('7–14 days', '14–30 days', '>30 days') AS is_risk,
        {rank('age_bucket', HL)} AS bucket_order
        FROM (SELECT {HLB} AS age_bucket FROM (SELECT {HOLD_DAYS} AS hd FROM brx WHERE on_hold)) WHERE age_bucket IS NOT NULL GROUP BY age_bucket"""),
    "breach_hold_by_group": br(f"""SELECT assignment_group AS "group", {HOLD} AS on_hold,
        count(*) FILTER (WHERE state = 'In Progress') AS in_progress FROM brx GROUP BY 1"""),
    "breach_kpi_scorecard": br(f"""SELECT kpi, label, target, target_pct, actual_pct, count, status FROM
        (SELECT count(*) AS n, count(*) FILTER (WHERE {DAYS} > 30) AS o30, {BIG('sum(reopen_count)')} AS re, count(*) FILTER (WHERE has_bug_link) AS bugs,
                count(*) FILTER (WHERE already_breached AND priority_num = 1) AS p1, count(*) FILTER (WHERE already_breached AND priority_num = 2) AS p2 FROM brx) t,
        LATERAL (VALUES
          ('aging_kpi', 'Tickets Aging', '95% resolved ≤30 days', CAST(95 AS DOUBLE), round_even(CAST(100 AS DOUBLE) * (CAST(1 AS DOUBLE) - CAST(o30 AS DOUBLE) / n), 1), o30,
            CASE WHEN round_even(CAST(100 AS DOUBLE) * (CAST(1 AS DOUBLE) - CAST(o30 AS DOUBLE) / n), 1) >= 95 THEN 'PASS' ELSE 'FAIL' END),
          ('first_time_right', 'First Time Right', 'Reopen ≤1% of closed', CAST(1 AS DOUBLE), round_even(CAST(100 AS DOUBLE) * re / greatest(n, 1), 2), re,
            CASE WHEN round_even(CAST(100 AS DOUBLE) * re / greatest(n, 1), 2) <= 1 THEN 'PASS' ELSE 'FAIL' END),
          ('bug_linked', 'Bug-Linked (Change needed)', NULL, NULL, {pct('bugs', 'n')}, bugs, NULL),
          ('p1_breach', 'P1/P2 SLA Breach', 'Zero tolerance — P1 4h, P2 8h', NULL, NULL, p1, CASE WHEN p1 + p2 = 0 THEN 'PASS' ELSE 'FAIL' END),
          ('p2_breach', 'P1/P2 SLA Breach', 'Zero tolerance — P1 4h, P2 8h', NULL, NULL, p2, CASE WHEN p1 + p2 = 0 THEN 'PASS' ELSE 'FAIL' END)
        ) AS v(kpi, label, target, target_pct, actual_pct, count, status)"""),
}
