"""Cleaning, derived columns, filters and quality reports in SQL."""

from .base import AS_OF, INC, ORG, br, inc, pct
from .breach import bins

TS = "'%Y-%m-%d %H:%M:%S'"

RAW = f"""
rawx AS (SELECT seq AS k, number, strftime(created, '%d-%m-%Y %H:%M') AS created, impact_user, first_assignment_group, assignment_group,
  tower, sdm, service_offering,
  CASE seq % 3 WHEN 0 THEN 'P' || priority WHEN 1 THEN CASE priority WHEN 1 THEN '1 - Critical' WHEN 2 THEN '2 - High' WHEN 3 THEN '3 - Moderate' ELSE '4 - Standard' END
    ELSE 'Prio ' || priority END AS priority,
  CAST(urgency AS VARCHAR) AS urgency,
  CASE state WHEN 'Closed' THEN 'close' WHEN 'Resolved' THEN 'completed' WHEN 'In Progress' THEN 'WIP' WHEN 'On Hold' THEN ' pending ' ELSE 'new' END AS state,
  assigned_to, short_description, category, subcategory, strftime(updated, {TS}) AS updated, updated_by,
  CASE WHEN made_sla_bool THEN CASE WHEN seq % 2 = 0 THEN 'yes' ELSE ' true ' END ELSE CASE WHEN seq % 2 = 0 THEN 'No' ELSE 'FALSE' END END AS made_sla,
  coalesce(strftime(resolved, {TS}), '') AS resolved,
  CASE WHEN seq % 13 = 0 THEN 'n/a' ELSE CAST(reopen_count AS VARCHAR) END AS reopen_count,
  CAST(reassignment_count AS VARCHAR) AS reassignment_count, resolution_code,
  'line one' || chr(10) || 'line two, "quoted"' AS resolution_notes, 'x' AS unknown_column, CAST(seq AS VARCHAR) AS file_row
  FROM inc),
messy AS (SELECT k, CASE WHEN k % 101 = 0 THEN ' ' ELSE number END AS number, CASE WHEN k % 53 = 7 THEN 'junk' ELSE created END AS created,
  CASE WHEN k % 7 = 3 THEN 'unknown' ELSE priority END AS priority, CASE WHEN k % 11 = 4 THEN 'none' ELSE urgency END AS urgency,
  CASE WHEN k % 9 = 2 THEN ' ' ELSE state END AS state, CASE WHEN k % 10 = 1 THEN 'maybe' ELSE made_sla END AS made_sla,
  first_assignment_group, reopen_count FROM rawx)"""

RAW_COLUMNS = """number, created, impact_user, first_assignment_group, assignment_group, tower, sdm, service_offering, priority, urgency, state,
 assigned_to, short_description, category, subcategory, updated, updated_by, made_sla, resolved, reopen_count, reassignment_count,
 resolution_code, resolution_notes, unknown_column, file_row"""

CLEAN_COLUMNS = """number, created, updated, resolved, impact_user, assignment_group, first_assignment_group, tower, sdm, priority, priority_label,
 urgency, urgency_label, state, made_sla, made_sla_bool, category, subcategory, service_offering, short_description, assigned_to,
 month, week, date, hour, dow, mttr_hours, CASE WHEN seq % 13 = 0 THEN 0 ELSE reopen_count END AS reopen_count, reassignment_count,
 'line one' || chr(10) || 'line two, "quoted"' AS resolution_notes, CAST(0 AS DOUBLE) AS business_duration"""


def raw(body):
    return inc(body, RAW)


def only(where):
    return inc(f"SELECT number, created FROM inc WHERE {where}")


EL = ['0–25% Healthy', '25–50% Caution', '50–75% Elevated', '75–90% At Risk', '90–100% Critical', '>100% Breached']
PRESET = [("all", "true"), ("active", "state IN ('Open','In Progress','On Hold')"), ("critical", "priority IN (1, 2)"),
          ("breached", "NOT made_sla_bool"), ("resolved", "state IN ('Resolved','Closed')")]

SQL = {
    "normalize_columns": raw(f"SELECT {RAW_COLUMNS} FROM rawx"),
    "fill_defaults": raw("""SELECT number, assigned_to, '0' AS business_duration, '0' AS duration, '' AS hold_reason, impact_user, '' AS internal_id,
        CAST(NULL AS VARCHAR) AS last_assignment_date, CAST(NULL AS VARCHAR) AS last_reopened_at, reassignment_count, reopen_count, resolution_code,
        resolution_notes, sdm, service_offering, CAST(NULL AS VARCHAR) AS sla_due, subcategory, '' AS tags, tower, updated, updated_by, urgency FROM rawx"""),
    "canonical_select": raw("""SELECT number, created, impact_user, first_assignment_group, assignment_group, service_offering, priority, urgency, state,
        '' AS hold_reason, assigned_to, short_description, category, subcategory, '' AS tags, updated, updated_by, made_sla, '' AS sla_due, resolution_code,
        resolved, reopen_count, reassignment_count, '0' AS business_duration, '' AS last_assignment_date, resolution_notes FROM rawx"""),
    "parse_date": inc(f"""SELECT number, CASE seq % 17 WHEN 0 THEN strftime(created, '%d-%m-%Y %H:%M') WHEN 1 THEN strftime(created, {TS})
          WHEN 2 THEN strftime(created, '%d/%m/%Y %H:%M') WHEN 3 THEN strftime(created, '%d-%m-%Y')
          WHEN 4 THEN strftime(created, '%-d-%-m-%Y %-H:%M') WHEN 5 THEN strftime(created, '%-d/%-m/%Y')
          WHEN 6 THEN strftime(created, '%d-%b-%Y %H:%M') WHEN 7 THEN strftime(created, '%d.%m.%Y')
          WHEN 8 THEN strftime(created, '%Y/%m/%d %H:%M') WHEN 9 THEN strftime(created, '%Y%m%d')
          WHEN 10 THEN strftime(created, '%b %-d, %Y') WHEN 11 THEN strftime(created, '%-d %B %Y %-I:%M %p')
          WHEN 12 THEN strftime(created, '%d-%m-%Y %H:%M:%S') WHEN 13 THEN strftime(created, '%Y-%m-%dT%H:%M:%S')
          WHEN 14 THEN 'junk' WHEN 15 THEN '  ' ELSE strftime(created, '%m/28/%Y') END AS raw,
        CASE WHEN seq % 17 IN (0, 1, 2, 4, 6, 8, 11, 12, 13) THEN created
          WHEN seq % 17 IN (3, 5, 7, 9, 10) THEN CAST(date_trunc('day', created) AS TIMESTAMP)
          WHEN seq % 17 = 16 THEN CAST(date_trunc('month', created) AS TIMESTAMP) + INTERVAL 27 DAY END AS parsed FROM inc"""),
    "format_date": inc("SELECT number, coalesce(strftime(resolved, '%d-%m-%Y %H:%M'), '') AS text FROM inc"),
    "parse_priority": raw("""SELECT k, m.priority AS raw, CASE WHEN k % 7 = 3 THEN 3 ELSE i.priority END AS priority, i.priority AS order_priority
        FROM messy m JOIN inc i ON i.seq = k"""),
    "parse_urgency": raw("SELECT k, m.urgency AS raw, CASE WHEN k % 11 = 4 THEN 3 ELSE i.urgency END AS urgency FROM messy m JOIN inc i ON i.seq = k"),
    "priority_to_label": raw("""SELECT k, m.priority AS raw, CASE WHEN k % 7 = 3 OR i.priority = 4 THEN '4 - Standard' WHEN i.priority = 1 THEN '1 - Critical'
        WHEN i.priority = 2 THEN '2 - High' ELSE '3 - Moderate' END AS label FROM messy m JOIN inc i ON i.seq = k"""),
    "parse_sla": raw("SELECT k, m.made_sla AS raw, k % 10 <> 1 AND made_sla_bool AS met FROM messy m JOIN inc i ON i.seq = k"),
    "normalize_state": raw("SELECT k, m.state AS raw, CASE WHEN k % 9 = 2 THEN 'Open' ELSE i.state END AS state FROM messy m JOIN inc i ON i.seq = k"),
    "clamp_numeric": """SELECT c_custkey, greatest(c_acctbal, 0) AS floored, c_acctbal AS kept, CAST(0 AS DOUBLE) AS from_text FROM customer""",
    "derive_time_parts": inc("SELECT number, created, month, week, date, hour, dow FROM inc"),
    "derive_mttr": inc("SELECT number, mttr_hours FROM inc"),
    "derive_breach_flags": br("SELECT task, already_breached, on_hold, has_bug_link FROM brx"),
    "derive_overdue_remaining": br("SELECT task, overdue_biz_hours, remaining_biz_hours FROM brx"),
    "derive_assignment_age": br("SELECT task, assignment_age_h FROM brx"),
    "derive_urgency": br("SELECT task, urgency FROM brx"),
    "derive_sla_severity": br("SELECT task, sla_severity FROM brx"),
    "agent_name": inc("""SELECT CASE WHEN contains(assigned_to, '(') THEN rtrim(split_part(assigned_to, '(', 1)) ELSE assigned_to END AS agent,
        count(*) AS tickets FROM inc GROUP BY 1"""),
    "bucketize": f"SELECT event_id, value, {bins('value', [0, 25, 50, 75, 90, 100, None], EL)} AS bucket FROM events",
    "null_to_none": """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS cleaned,
        CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN CAST(0 AS DOUBLE) ELSE round_even(o_totalprice, 1) END AS zeroed FROM orders""",
    "audit_required_blank": raw("""SELECT 'number' AS "column", count(*) FILTER (WHERE trim(number) = '') AS blanks FROM messy
        UNION ALL SELECT 'created', count(*) FILTER (WHERE trim(created) = '') FROM messy
        UNION ALL SELECT 'first_assignment_group', count(*) FILTER (WHERE trim(first_assignment_group) = '') FROM messy
        UNION ALL SELECT 'priority', count(*) FILTER (WHERE trim(priority) = '') FROM messy
        UNION ALL SELECT 'state', count(*) FILTER (WHERE trim(state) = '') FROM messy"""),
    "audit_value_fixes": raw("""SELECT count(*) FILTER (WHERE k % 7 = 3) AS priority_fixed, count(*) FILTER (WHERE k % 11 = 4) AS urgency_fixed,
        count(*) FILTER (WHERE k % 10 = 1) AS sla_fixed, count(*) AS state_fixed, count(*) FILTER (WHERE k % 53 = 7) AS date_failures FROM messy"""),
    "drop_blank_key": raw("SELECT number, state FROM messy WHERE trim(number) <> ''"),
    "f1_date_from": only("created >= TIMESTAMP '1998-01-01'"),
    "f2_date_to": only("created <= TIMESTAMP '1998-06-30' + INTERVAL 1 DAY"),
    "f3_towers": only("tower IN ('ASIA', 'EUROPE')"),
    "f4_sdms": only("sdm IN ('SDM_1', 'SDM_5')"),
    "f5_groups": only("assignment_group IN ('NATION_3-BUILDING', 'NATION_7-MACHINERY')"),
    "f6_priorities": only("priority IN (1, 2)"),
    "f7_categories": only("category IN ('Network', 'General')"),
    "f8_states": only("state IN ('Open', 'On Hold')"),
    "f9_sla": only("NOT made_sla_bool"),
    "filter_combined": inc("""SELECT number, created FROM inc WHERE created >= TIMESTAMP '1997-01-01' AND created <= TIMESTAMP '2000-01-01'
        AND tower = 'ASIA' AND priority IN (1, 3) AND state IN ('Resolved', 'Closed') AND made_sla_bool"""),
    "filter_month_set": only("month IN ('1996-02', '1998-11', '2001-07')"),
    "filter_org": br("""SELECT task, assignment_group FROM brx WHERE assignment_group IN
        (SELECT assignment_group FROM org WHERE tower = 'ASIA' OR sdm = 'SDM_3') AND created >= TIMESTAMP '1996-01-01'""", ORG),
    "filter_search": inc("""SELECT number, short_description, impact_user FROM inc WHERE regexp_matches(number, '(?i)^INC0000000[1-3]')
        OR regexp_matches(short_description, '(?i)^INC0000000[1-3]') OR regexp_matches(impact_user, '(?i)^INC0000000[1-3]')"""),
    "filter_options": inc("""SELECT 'towers' AS option, tower AS value FROM inc WHERE trim(tower) <> '' GROUP BY 2
        UNION ALL SELECT 'sdms', sdm FROM inc WHERE trim(sdm) <> '' GROUP BY 2
        UNION ALL SELECT 'groups', assignment_group FROM inc GROUP BY 2 UNION ALL SELECT 'categories', category FROM inc GROUP BY 2
        UNION ALL SELECT 'states', state FROM inc GROUP BY 2 UNION ALL SELECT 'date_min', strftime(min(created), '%Y-%m-%d') FROM inc
        UNION ALL SELECT 'date_max', strftime(max(created), '%Y-%m-%d') FROM inc"""),
    "register_presets": inc(" UNION ALL ".join(
        f"SELECT '{n}' AS tab, count(*) AS rows, max(created) AS newest FROM inc WHERE {c}" for n, c in PRESET)),
    "sla_lookup": inc("""SELECT number, i.priority, h AS resolution_hours, l AS resolution_label, rh AS response_hours, rl AS response_label, s AS support
        FROM inc i JOIN (VALUES (1, 4, '4 hours', CAST(0.25 AS DOUBLE), '15 min', '24×7'), (2, 8, '8 hours', 1, '1 hour', '24×7'),
        (3, 72, '72 business hours', 4, '4 hours', '24×5'), (4, 120, '120 business hours', 4, '4 hours', '24×5')) AS c(p, h, l, rh, rl, s) ON p = i.priority"""),
    "doc_filtered_of_total": inc("SELECT count(*) FILTER (WHERE tower = 'ASIA' AND priority IN (1, 2)) AS kept, count(*) AS total FROM inc"),
    "doc_quality_checks": inc("""SELECT 'missing_tower' AS rule, count(*) FILTER (WHERE trim(tower) = '') AS rows FROM bad
        UNION ALL SELECT 'missing_sdm', count(*) FILTER (WHERE coalesce(sdm, '') = '') FROM bad
        UNION ALL SELECT 'missing_priority', count(*) FILTER (WHERE priority IS NULL) FROM bad
        UNION ALL SELECT 'mttr_over_limit', count(*) FILTER (WHERE mttr_hours > 720) FROM bad
        UNION ALL SELECT 'sla_contradicts_mttr', count(*) FILTER (WHERE made_sla_bool <> (mttr_hours <= CASE priority WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 72 ELSE 120 END)) FROM bad""",
        """bad AS (SELECT * REPLACE (CASE WHEN seq % 29 = 0 THEN ' ' ELSE tower END AS tower, CASE WHEN seq % 31 = 0 THEN NULL ELSE sdm END AS sdm,
        CASE WHEN seq % 37 = 0 THEN NULL ELSE priority END AS priority, CASE WHEN seq % 23 = 0 THEN NOT made_sla_bool ELSE made_sla_bool END AS made_sla_bool,
        CASE WHEN seq % 41 = 0 THEN mttr_hours + 1000 ELSE mttr_hours END AS mttr_hours) FROM inc)"""),
    # sources
    "src_incidents_csv": raw(f"SELECT {CLEAN_COLUMNS} FROM inc"),
    "src_breach_csv": br("""SELECT task, priority, priority_num, state, created, breach_time, stop_time, last_assignment_date, business_elapsed_percentage,
        already_breached, on_hold, has_bug_link, overdue_biz_hours, remaining_biz_hours, assignment_age_h, breach_date, urgency, sla_severity,
        sla_resolution_hours, reassignment_count, reopen_count FROM brx"""),
    "src_org_map": f"WITH {ORG} SELECT * FROM org",
    "src_json": "SELECT event_id, user_id, event_type, value, props AS raw_props FROM events",
    "src_multi_file": inc("SELECT strftime(created, 'yr=%Y') AS file, number, state AS state FROM inc"),
    "src_encoding": "SELECT conv_id, turn, role, text FROM conversations",
    "audit_file_summary": inc("""SELECT strftime(i.created, 'yr=%Y') AS file, count(*) AS rows_in_file, CAST(0 AS BIGINT) AS internal_duplicates,
        count(*) FILTER (WHERE l.l_orderkey IS NOT NULL) AS existing_duplicates, count(*) FILTER (WHERE l.l_orderkey IS NULL) AS net_new_rows
        FROM inc i LEFT JOIN line l ON l.l_orderkey = i.seq GROUP BY 1"""),
    "canonical_audit": inc("""SELECT strftime(created, 'yr=%Y') AS file, count(*) AS rows_in_file,
        'number,created,impact_user,first_assignment_group,assignment_group,service_offering,priority,urgency,state,assigned_to,short_description,category,subcategory,updated,updated_by,made_sla,resolution_code,resolved,reopen_count,reassignment_count,resolution_notes' AS columns_kept,
        'hold_reason,tags,sla_due,business_duration,last_assignment_date' AS columns_added,
        'file_row,sdm,tower,unknown_column' AS columns_dropped FROM inc GROUP BY 1"""),
    "sink_clean": inc("SELECT number, month, state, priority, made_sla, category, created, mttr_hours, tower FROM inc"),
    "sink_append_new": inc("SELECT month, count(*) AS rows, count(DISTINCT number) AS tickets, CAST(0 AS BIGINT) AS old_rows FROM inc GROUP BY 1"),
    "sink_export_csv": inc("""SELECT number, strftime(created, '%d-%m-%Y %H:%M') AS created, CAST(priority AS VARCHAR) AS priority, state, first_assignment_group,
        assigned_to, category, short_description, made_sla, CAST(reassignment_count AS VARCHAR) AS reassignment_count,
        CAST(reopen_count AS VARCHAR) AS reopen_count, coalesce(strftime(resolved, '%d-%m-%Y %H:%M'), '') AS resolved, mttr_hours AS mttr_hours FROM inc"""),
    "source_inventory": inc("""SELECT 'export_' || substr(month, 1, 4) || '.csv' AS name, 'incidents' AS type, count(*) AS records,
        max(updated) AS last_updated, 'active' AS status FROM inc GROUP BY 1"""),
}
