"""Fact sections, question routing and the history window in SQL."""

from .base import avgh, inc

LIVE = "state IN ('Open', 'In Progress', 'On Hold')"


def n0(x):
    return f"format('{{:,}}', {x})"


def f(x, d=1):
    return f"printf('%.{d}f', round_even({x}, {d}))"


FACTS = f"""
wh AS (SELECT count(*) AS n, count(*) FILTER (WHERE {LIVE}) AS live, count(*) FILTER (WHERE state IN ('Resolved', 'Closed')) AS done,
  CAST(100 AS DOUBLE) * count(*) FILTER (WHERE made_sla_bool) / count(*) AS sla, {avgh()} AS mttr, min(created) AS a, max(created) AS b,
  CAST(sum(reassignment_count) AS DOUBLE) / count(*) AS mv, count(*) FILTER (WHERE reassignment_count >= 3) AS many FROM inc),
gr AS (SELECT assignment_group AS g, count(*) FILTER (WHERE {LIVE}) AS live, {avgh()} AS mttr,
  CAST(100 AS DOUBLE) * count(*) FILTER (WHERE made_sla_bool) / count(*) AS sla FROM inc GROUP BY 1),
facts AS (
 SELECT 'overview' AS section, 1 AS rank, 'total' AS label, CAST(n AS DOUBLE) AS value, '**Platform Overview** (' || {n0('n')} || ' total incidents)' AS line FROM wh
 UNION ALL SELECT 'overview', 2, 'active', live, '• Active: ' || {n0('live')} || '  |  Resolved/Closed: ' || {n0('done')} FROM wh
 UNION ALL SELECT 'overview', 3, 'sla_pct', round_even(sla, 1), '• Overall SLA compliance: ' || {f('sla')} || '%' FROM wh
 UNION ALL SELECT 'overview', 4, 'avg_mttr', round_even(mttr, 1), '• Overall avg MTTR: ' || {f('mttr')} || ' hours' FROM wh
 UNION ALL SELECT 'overview', 5, 'date_range', NULL, '• Data range: ' || strftime(a, '%d %b %Y') || ' → ' || strftime(b, '%d %b %Y') FROM wh
 UNION ALL SELECT 'reassignment', 1, 'avg_reassignments', round_even(mv, 2), '• Avg reassignments per incident: ' || {f('mv', 2)} FROM wh
 UNION ALL SELECT 'reassignment', 2, 'high_reassignments', many, '• Incidents with 3+ reassignments: ' || {n0('many')} FROM wh
 UNION ALL SELECT 'priority_breakdown', CAST(row_number() OVER (ORDER BY priority) AS INTEGER), any_value(priority_label), count(*),
   '• ' || any_value(priority_label) || ': ' || {n0('count(*)')} || ' total, ' || {n0(f'count(*) FILTER (WHERE {LIVE})')} || ' active' FROM inc GROUP BY priority
 UNION ALL (SELECT 'group_workload', CAST(row_number() OVER (ORDER BY live DESC, g) AS INTEGER), g, live, '• ' || g || ': ' || {n0('live')} || ' active'
   FROM gr WHERE live > 0 QUALIFY row_number() OVER (ORDER BY live DESC, g) <= 8)
 UNION ALL SELECT 'mttr_by_group', CAST(row_number() OVER (ORDER BY mttr, g) AS INTEGER), g, round_even(mttr, 1), '• ' || g || ': ' || {f('mttr')} || 'h' FROM gr WHERE mttr IS NOT NULL
 UNION ALL SELECT 'sla_compliance', CAST(row_number() OVER (ORDER BY sla DESC, g) AS INTEGER), g, round_even(sla, 1), '• ' || g || ': ' || {f('sla')} || '%' FROM gr
 UNION ALL (SELECT 'categories', CAST(row_number() OVER (ORDER BY n DESC, category) AS INTEGER), category, n, '• ' || category || ': ' || {n0('n')} || ' (' || {f('CAST(100 AS DOUBLE) * n / al', 0)} || '%)'
   FROM (SELECT category, count(*) AS n, sum(count(*)) OVER () AS al FROM inc GROUP BY 1) QUALIFY row_number() OVER (ORDER BY n DESC, category) <= 10)
 UNION ALL SELECT 'monthly_trend', CAST(row_number() OVER (ORDER BY month) AS INTEGER), month, n, '• ' || month || ': ' || {n0('n')}
   FROM (SELECT month, count(*) AS n FROM inc GROUP BY 1 ORDER BY month DESC LIMIT 6)
 UNION ALL SELECT 'top_active_incidents', CAST(row_number() OVER (ORDER BY priority, created, number) AS INTEGER), number, priority,
   '• [' || priority_label || '] ' || number || ' — ' || substr(short_description, 1, 80)
   FROM (SELECT * FROM inc WHERE {LIVE} ORDER BY priority, created, number LIMIT 5))"""

KEYS = {
    "priority_breakdown": ("Priority Breakdown:", ["priority", "p1", "p2", "p3", "p4", "critical", "urgent", "severe", "high"]),
    "group_workload": ("Active Incidents by Assignment Group:", ["group", "team", "assign", "backlog", "workload", "who", "queue", "which team"]),
    "categories": ("Category Distribution:", ["category", "type", "kind", "hardware", "network", "software", "access", "error", "application", "service", "infrastructure"]),
    "mttr_by_group": ("Average MTTR by Group (hours):", ["mttr", "resolution time", "how long", "duration", "resolve", "mean time", "time to"]),
    "sla_compliance": ("SLA Compliance by Group:", ["sla", "breach", "compliance", "target", "met", "missed", "service level"]),
    "monthly_trend": ("Monthly Incident Volume (last 6 periods):", ["trend", "week", "month", "recent", "last", "this month", "over time", "history", "timeline", "pattern"]),
    "reassignment": ("Reassignment Analysis:", ["reassign", "bounce", "routing", "wrong group", "escalat", "transfer"]),
    "top_active_incidents": ("Top 5 Active Incidents (by priority):", ["top", "worst", "highest", "most", "list", "show me", "what are the"]),
}


def hit(words):
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


RULES = ", ".join(f"({i}, '{k}', '{h}')" for i, (k, (h, _)) in enumerate(KEYS.items(), 1))
HITS = " UNION ALL ".join(f"SELECT conv_id, turn, '{k}' AS section FROM conversations WHERE {hit(w)}"
                          for k, (_, w) in KEYS.items())
ROUTE = f"""{FACTS},
heads(ord, section, head) AS (VALUES {RULES}),
texts AS (SELECT section, string_agg(line, chr(10) ORDER BY rank) AS body FROM facts GROUP BY section),
hits AS ({HITS}),
parts AS (SELECT conv_id, turn, string_agg(h.section, ',' ORDER BY ord) AS sections,
                 string_agg(chr(10) || '**' || head || '**' || chr(10) || body, chr(10) ORDER BY ord) AS body
          FROM hits JOIN heads h ON hits.section = h.section JOIN texts t ON t.section = h.section GROUP BY 1, 2),
ctx AS (SELECT c.conv_id, c.turn, coalesce(sections, '') AS sections,
               (SELECT body FROM texts WHERE section = 'overview') || coalesce(chr(10) || p.body, '') AS full_text
        FROM conversations c LEFT JOIN parts p ON p.conv_id = c.conv_id AND p.turn = c.turn)"""

SQL = {
    "context_facts": inc("SELECT * FROM facts", FACTS),
    "context_route": inc("""SELECT conv_id, turn, sections, CASE WHEN length(full_text) > 2800
        THEN substr(full_text, 1, 2800) || chr(10) || '…[context truncated]' ELSE full_text END AS context FROM ctx""", ROUTE),
    "history_window": """SELECT conv_id, turn, role, text FROM conversations
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 20""",
    "history_window_3": """SELECT conv_id, turn, role, text FROM conversations
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3""",
}
