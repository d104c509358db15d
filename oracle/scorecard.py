"""Scorecards in SQL."""

from .base import AS_OF, avgh, inc, pct, pct0, r

MET = "count(*) FILTER (WHERE made_sla_bool)"
FTF = "count(*) FILTER (WHERE reassignment_count = 0 AND reopen_count = 0)"
DEFS = """defs(id, name, type, prio, target, threshold, win, description) AS (VALUES
 ('AM.01', 'P1 Incident Response', 'SLA', 1, CAST(97 AS DOUBLE), CAST(95 AS DOUBLE), 1, 'P1 acknowledged within 1 hour [24×7]'),
 ('AM.02', 'P2 Incident Response', 'SLA', 2, 95, 90, 4, 'P2 acknowledged within 4 hours [24×7]'),
 ('AM.03', 'P3 Incident Response', 'SLA', 3, 90, 85, 4, 'P3 acknowledged within 4 business hours [24×5]'),
 ('AM.04', 'P4 Incident Response', 'SLA', 4, 85, 80, 8, 'P4 acknowledged within 8 business hours [24×5]'),
 ('AM.05', 'P1 Incident Resolution', 'SLA', 1, 95, 90, 24, 'P1 resolved within 24 hours [24×7]'),
 ('AM.06', 'P2 Incident Resolution', 'SLA', 2, 95, 90, 8, 'P2 resolved within 8 hours [24×7]'),
 ('AM.07', 'P3 Incident Resolution', 'SLA', 3, 95, 90, 12, 'P3 resolved avg within 12 business hours'),
 ('AM.08', 'P4 Incident Resolution', 'SLA', 4, 95, 90, 120, 'P4 resolved within 5 business days (120 h)'),
 ('AM.09', 'SR Resolution (Access)', 'SLA', NULL, 90, 85, 24, 'Access-provisioning SRs resolved within SLA'),
 ('AM.10', 'SR Resolution (Other)', 'SLA', NULL, 85, 80, 48, 'Other service requests resolved within SLA'),
 ('AM.17', 'First Time Fix Rate', 'KPI', NULL, 55, 45, NULL, '% incidents resolved without reassignment or reopen'),
 ('AM.18', 'Ticket Aging ≤30 days', 'KPI', NULL, 95, 90, 720, '% tickets resolved or active within 30 days')),
scoped AS (
  SELECT d.*, i.* EXCLUDE (priority) FROM defs d JOIN inc i ON
    (d.prio IS NULL OR d.prio = i.priority) AND (d.id <> 'AM.09' OR i.category ILIKE '%access%')
    AND (d.id <> 'AM.10' OR i.category NOT ILIKE '%access%')),
score AS (
  SELECT id, name, type, target, threshold, description, total, met, total - met AS not_met, """ + pct0("met", "total") + f""" AS actual FROM (
    SELECT id, name, type, target, threshold, description,
      CASE WHEN id IN ('AM.17', 'AM.18') OR count(mttr_hours) = 0 THEN count(*) ELSE count(mttr_hours) END AS total,
      CASE WHEN id = 'AM.17' THEN {FTF}
           WHEN id = 'AM.18' THEN count(*) FILTER (WHERE mttr_hours <= 720 OR (mttr_hours IS NULL AND date_diff('second', created, {AS_OF}) / 3600.0 <= 720))
           WHEN count(mttr_hours) > 0 THEN count(*) FILTER (WHERE mttr_hours <= win)
           ELSE {MET} END AS met
    FROM scoped GROUP BY id, name, type, target, threshold, description, win)),
rag AS (SELECT *, CASE WHEN actual >= target THEN 'green' WHEN actual >= threshold THEN 'amber' ELSE 'red' END AS rag FROM score)"""

TOP = "top15 AS (SELECT assigned_to AS agent, count(*) AS n FROM inc WHERE trim(assigned_to) <> '' GROUP BY 1 ORDER BY n DESC, agent LIMIT 15)"

SQL = {
    "score_summary": inc("SELECT * FROM rag", DEFS),
    "score_rag_counts": inc("SELECT rag, count(*) AS count FROM rag GROUP BY 1", DEFS),
    "score_by_agent": inc(f"""SELECT assigned_to AS agent, count(*) AS total, {pct(MET, 'count(*)')} AS sla_pct,
        {pct(FTF, 'count(*)')} AS ftf_pct, {r(avgh())} AS avg_mttr FROM inc WHERE trim(assigned_to) <> ''
        GROUP BY 1 ORDER BY total DESC, agent LIMIT 15"""),
    "score_by_agent_priority": inc(f"""SELECT agent, priority, count(*) AS total, {MET} AS met, {pct(MET, 'count(*)')} AS pct
        FROM inc JOIN top15 ON assigned_to = agent GROUP BY 1, 2""", TOP),
    "score_monthly": inc(f"""SELECT month AS period, count(*) AS total, {pct(MET, 'count(*)')} AS sla_pct,
        {pct(FTF, 'count(*)')} AS ftf_pct, {r(avgh())} AS avg_mttr FROM inc GROUP BY 1"""),
    "group_stats": inc(f"""SELECT assignment_group AS "group", count(*) AS total_incidents,
        count(*) FILTER (WHERE state IN ('Open', 'In Progress', 'On Hold')) AS active_incidents, {r(avgh())} AS avg_mttr_hours,
        {r(f'CAST({MET} AS DOUBLE) / count(*)', 3)} AS sla_compliance,
        {r('CAST(sum(reassignment_count) AS DOUBLE) / count(*)', 2)} AS avg_reassignments FROM inc GROUP BY 1"""),
}
