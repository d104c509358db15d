"""Insights and severity bands in SQL."""

from .base import avgh, inc


def f(x: str, d: int = 1, sign: str = "") -> str:
    return f"printf('%{sign}.{d}f', round_even({x}, {d}))"


def band(x, a, b, reverse=False):
    op = ">=" if reverse else "<"
    return f"CASE WHEN {x} {op} {a} THEN 'positive' WHEN {x} {op} {b} THEN 'warning' ELSE 'critical' END"


M = """m AS (SELECT count(*) AS n, CAST(100 AS DOUBLE) * count(*) FILTER (WHERE made_sla_bool) / count(*) AS sla,
  count(*) FILTER (WHERE state IN ('Open','In Progress','On Hold')) AS live,
  count(*) FILTER (WHERE state IN ('Open','In Progress','On Hold') AND priority <= 2) AS crit,
  CAST(sum(reassignment_count) AS DOUBLE) / count(*) AS mv, count(*) FILTER (WHERE reassignment_count >= 3) AS many,
  count(*) FILTER (WHERE state = 'On Hold') AS hn, CAST(100 AS DOUBLE) * count(*) FILTER (WHERE state = 'On Hold') / count(*) AS held FROM inc),
g AS (SELECT assignment_group AS tg, count(*) AS tc, count(*) OVER () AS ng FROM inc
      WHERE state IN ('Open','In Progress','On Hold') GROUP BY 1 ORDER BY tc DESC, tg LIMIT 1),
c AS (SELECT category AS tcat, count(*) AS tn FROM inc GROUP BY 1 ORDER BY tn DESC, tcat LIMIT 1),
a AS (SELECT *, CAST(tc AS DOUBLE) / (CAST(live AS DOUBLE) / ng) AS load, CAST(100 AS DOUBLE) * tn / n AS cp FROM m, g, c)"""

T = f"""mm AS (SELECT month, count(*) AS n, CAST(100 AS DOUBLE) * count(*) FILTER (WHERE made_sla_bool) / count(*) AS sla FROM inc GROUP BY 1),
mt AS (SELECT month, {avgh()} AS v FROM inc WHERE mttr_hours IS NOT NULL GROUP BY 1),
mx AS (SELECT *, row_number() OVER (ORDER BY month) - 1 AS x, lag(n) OVER (ORDER BY month) AS np, lag(sla) OVER (ORDER BY month) AS sp FROM mm),
lastm AS (SELECT n, np, sla, sp FROM mx ORDER BY month DESC LIMIT 1),
lastt AS (SELECT v, vp FROM (SELECT *, lag(v) OVER (ORDER BY month) AS vp FROM mt) ORDER BY month DESC LIMIT 1),
w AS (SELECT category AS wc, {avgh()} AS wm FROM inc WHERE mttr_hours IS NOT NULL GROUP BY 1 ORDER BY wm DESC, wc LIMIT 1),
sl AS (SELECT regr_slope(n, x) AS slope FROM mx),
a AS (SELECT *, CAST(n - np AS DOUBLE) / greatest(np, 1) * 100 AS d, v - vp AS sh FROM lastm, lastt, w, sl)"""

SQL = {
    "insights_monitoring": inc(f"""
SELECT 'sla_compliance' AS id, 'SLA Compliance' AS title, 'Overall SLA compliance is ' || {f('sla')} || '%. ' ||
  CASE WHEN sla >= 90 THEN 'Performance is strong — maintain current response times.'
       ELSE 'Below 90% target. ' || CAST(trunc(n * (CAST(1 AS DOUBLE) - sla / 100)) AS BIGINT) || ' incidents breached SLA this period.' END AS message,
  {band('sla', 90, 80, True)} AS severity, {f('sla')} || '%' AS metric, 'sla_gauge' AS chart FROM a
UNION ALL SELECT 'critical_backlog', 'Critical & High Priority Backlog', crit || ' P1/P2 incidents are currently unresolved. ' ||
  CASE WHEN crit > 10 THEN 'Immediate escalation review recommended.' ELSE 'Critical backlog is within acceptable limits.' END,
  {band('crit', 5, 10)}, CAST(crit AS VARCHAR), 'priority_heatmap' FROM a
UNION ALL SELECT 'group_load', 'Assignment Group Workload', tg || ' carries the highest active load (' || tc || ' tickets, ' || {f('load')} ||
  'x the average). Consider load balancing.', {band('load', 1.3, 1.7)}, tc || ' active', 'by_group' FROM a
UNION ALL SELECT 'reassignment', 'Reassignment Rate', 'Average reassignment count is ' || {f('mv', 2)} || ' per incident. ' ||
  CASE WHEN many > 5 THEN many || ' tickets reassigned 3+ times — review routing rules.' ELSE 'Reassignment rate is within normal bounds.' END,
  {band('mv', 0.8, 1.5)}, {f('mv', 2)} || ' avg', 'by_group' FROM a
UNION ALL SELECT 'on_hold', 'On-Hold Incidents', hn || ' incidents (' || {f('held')} || '%) are on hold. ' ||
  CASE WHEN held > 10 THEN 'High hold rate may indicate supplier dependency or approval bottlenecks.' ELSE 'Hold queue is within acceptable levels.' END,
  {band('held', 8, 15)}, {f('held')} || '%', 'reopen_tracker' FROM a
UNION ALL SELECT 'top_category', 'Dominant Incident Category', '''' || tcat || ''' accounts for ' || {f('cp')} || '% of all incidents. ' ||
  CASE WHEN cp > 25 THEN 'High concentration suggests a systemic issue or process gap worth investigating.' ELSE 'Incident distribution across categories is balanced.' END,
  {band('cp', 25, 35)}, {f('cp')} || '%', 'by_category' FROM a""", M),
    "insights_trends": inc(f"""
SELECT 'volume_trend' AS id, 'Monthly Volume Trend' AS title, 'Incident volume ' || CASE WHEN d > 0 THEN 'increased' ELSE 'decreased' END || ' by ' ||
  {f('abs(d)')} || '% vs the prior period (' || np || ' → ' || n || '). ' || CASE WHEN d > 15 THEN 'Investigate root cause of surge.'
  WHEN abs(d) < 5 THEN 'Stable trend — no immediate concern.' ELSE 'Monitor closely over next period.' END AS message,
  {band('abs(d)', 10, 20)} AS severity, {f('d', 1, '+')} || '%' AS metric, 'volume' AS chart FROM a
UNION ALL SELECT 'mttr_trend', 'MTTR Trajectory', 'Mean Time to Resolve is ' || {f('v')} || ' hrs (prev period: ' || {f('vp')} || ' hrs). ' ||
  CASE WHEN sh < -1 THEN 'Resolution times are improving — positive trend.' WHEN abs(sh) < 1 THEN 'MTTR is stable.'
  ELSE 'MTTR deteriorating — review resolver capacity and ticket complexity.' END, {band('sh', 0, 5)}, {f('v')} || 'h', 'mttr' FROM a
UNION ALL SELECT 'worst_category_mttr', 'Slowest Category to Resolve', '''' || wc || ''' has the highest average MTTR at ' || {f('wm')} ||
  ' hours. Consider dedicated knowledge articles, automation, or routing optimisation.', {band('wm', 24, 72)}, {f('wm')} || 'h', 'category_distribution' FROM a
UNION ALL SELECT 'sla_trend', 'SLA Compliance Trend', 'SLA compliance this period: ' || {f('sla')} || '% (prev: ' || {f('sp')} || '%). ' ||
  CASE WHEN sla > sp THEN 'Compliance improving — good operational progress.' ELSE 'Compliance declining — prioritise P1/P2 response times.' END,
  {band('sla', 90, 80, True)}, {f('sla')} || '%', 'sla_compliance' FROM a
UNION ALL SELECT 'forecast', 'Volume Forecast Signal', 'Linear trend slope: ' || {f('slope', 1, '+')} || ' incidents/period. ' ||
  CASE WHEN slope > 5 THEN 'Upward trend detected. Infrastructure capacity planning recommended.'
  WHEN slope < -5 THEN 'Downward trend. Potential improvement from recent initiatives.' ELSE 'Volume is stable with no significant directional drift.' END,
  {band('abs(slope)', 5, 15)}, {f('slope', 1, '+')} || '/period', 'forecast' FROM a""", T),
    "severity_band": inc(f"""SELECT assignment_group AS "group", sla, {band('sla', 60, 50, True)} AS sla_band, n, {band('n', 110, 130)} AS load_band
        FROM (SELECT assignment_group, round_even(CAST(100 AS DOUBLE) * count(*) FILTER (WHERE made_sla_bool) / count(*), 1) AS sla, count(*) AS n FROM inc GROUP BY 1)"""),
}
