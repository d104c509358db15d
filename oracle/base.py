"""Shared CTEs: incidents, SLA snapshot and organisation map from the test tables."""

AS_OF = "TIMESTAMP '2001-08-02 14:00:00'"

INC = """
line AS (
  SELECT l_orderkey, sum(l_quantity) AS q, count(DISTINCT l_suppkey) AS ns,
         count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'O') AS nr,
         min(l_partkey) AS pk
  FROM lineitem GROUP BY l_orderkey),
inc0 AS (
  SELECT o_orderkey AS seq,
         'INC' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS number,
         CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST((o_orderkey % 24) * 60 + o_orderkey % 60 AS INTEGER)) AS created,
         n_name || '-' || c_mktsegment AS assignment_group,
         CASE WHEN o_orderkey % 4 = 0 THEN n_name || '-BUILDING' ELSE n_name || '-' || c_mktsegment END AS first_assignment_group,
         r_name AS tower, 'SDM_' || (n_nationkey % 8) AS sdm,
         CASE WHEN substr(o_orderpriority, 1, 1) IN ('1','2','3','4') THEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) ELSE 3 END AS priority,
         CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'Closed' ELSE 'Resolved' END
              WHEN 'P' THEN 'In Progress'
              ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'On Hold' ELSE 'Open' END END AS state,
         CAST(CASE WHEN ns IS NULL THEN 0 ELSE greatest(ns - 1, 0) % 5 END AS INTEGER) AS reassignment_count,
         CAST(coalesce(nr, 0) AS INTEGER) AS reopen_count,
         CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'Agent ' || (o_custkey % 40) || ' (a' || (o_custkey % 40) || '@example.com)' END AS assigned_to,
         'user' || o_custkey AS impact_user, 'agent' || (o_orderkey % 15) AS updated_by,
         coalesce(p_type || ' ' || p_brand, '') AS service_offering,
         coalesce(p_name, '') AS short_description,
         CASE WHEN split_part(p_name, ' ', 2) IN ('ring', 'rod') THEN 'Network'
              WHEN split_part(p_name, ' ', 2) IN ('widget', 'gizmo') THEN 'Hardware'
              WHEN split_part(p_name, ' ', 2) IN ('gear', 'bolt') THEN 'Software & Tools'
              WHEN split_part(p_name, ' ', 2) = 'plate' THEN 'Application Access'
              ELSE 'General' END AS category,
         coalesce(p_type, 'General') AS subcategory, p_type, q
  FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       LEFT JOIN line ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = pk),
inc1 AS (
  SELECT *, least(priority, 3) AS urgency,
         CASE WHEN state IN ('Resolved', 'Closed') AND q IS NOT NULL
              THEN created + to_seconds(CAST(q * priority * 450 AS BIGINT)) END AS resolved,
         created + to_hours(CAST(seq % 48 AS INTEGER)) AS last_assignment_date
  FROM inc0),
inc2 AS (
  SELECT *, CASE WHEN resolved IS NOT NULL THEN CAST(date_diff('second', created, resolved) AS DOUBLE) / 3600.0 END AS mttr_hours,
         strftime(created, '%Y-%m') AS month, strftime(created, '%Y-%m-%d') AS date,
         strftime(date_trunc('week', created), '%Y-%m-%d') || '/' || strftime(CAST(date_trunc('week', created) AS TIMESTAMP) + INTERVAL 6 DAY, '%Y-%m-%d') AS week,
         CAST(hour(created) AS INTEGER) AS hour, dayname(created) AS dow,
         CASE priority WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 72 ELSE 120 END AS sla_h
  FROM inc1),
inc AS (
  SELECT *, CASE WHEN resolved IS NOT NULL THEN mttr_hours <= sla_h ELSE seq % 10 >= 3 END AS made_sla_bool,
         CASE WHEN (CASE WHEN resolved IS NOT NULL THEN mttr_hours <= sla_h ELSE seq % 10 >= 3 END) THEN 'TRUE' ELSE 'FALSE' END AS made_sla,
         coalesce(resolved, created + to_hours(CAST(seq % 120 AS INTEGER))) AS updated,
         created + to_hours(sla_h) AS sla_due,
         coalesce(mttr_hours * 3600.0, 0.0) AS business_duration,
         CASE WHEN resolved IS NOT NULL THEN p_type ELSE '' END AS resolution_code,
         '' AS resolution_notes, '' AS hold_reason, '' AS tags, '' AS internal_id,
         CASE priority WHEN 1 THEN 'P1-Critical' WHEN 2 THEN 'P2-High' WHEN 3 THEN 'P3-Moderate' ELSE 'P4-Standard' END AS priority_label,
         CASE urgency WHEN 1 THEN '1-High' WHEN 2 THEN '2-Medium' ELSE '3-Low' END AS urgency_label
  FROM inc2)
"""

BR = INC + f""",
br0 AS (
  SELECT number AS task, seq, created, assignment_group, service_offering, assigned_to,
         reassignment_count, reopen_count,
         CASE priority WHEN 1 THEN '1 - Critical' WHEN 2 THEN '2 - High' WHEN 3 THEN '3 - Moderate' ELSE '4 - Standard' END AS priority,
         priority AS priority_num, sla_h AS sla_resolution_hours,
         CASE WHEN state = 'On Hold' THEN 'On Hold' ELSE 'In Progress' END AS state,
         CAST((seq * 7919) % 17600 AS DOUBLE) / 100.0 AS pct,
         CASE WHEN state = 'On Hold' THEN {AS_OF} - to_days(CAST(seq % 45 AS INTEGER)) END AS stop_time,
         CASE WHEN seq % 11 <> 0 THEN {AS_OF} - to_hours(CAST((seq * 31) % 400 AS INTEGER)) END AS last_assignment_date,
         CASE WHEN seq % 5 = 0 THEN 'BUG ' || seq ELSE '' END AS internal_id
  FROM inc WHERE state NOT IN ('Resolved', 'Closed')),
br1 AS (
  SELECT *, pct AS business_elapsed_percentage,
         {AS_OF} + to_seconds(CAST(round((CAST(100 AS DOUBLE) - pct) * sla_resolution_hours * CAST(50.4 AS DOUBLE)) AS BIGINT)) AS breach_time,
         pct >= 100 AS already_breached, state = 'On Hold' AS on_hold, internal_id <> '' AS has_bug_link
  FROM br0),
br AS (
  SELECT *,
         CASE WHEN already_breached THEN round_even((pct - CAST(100 AS DOUBLE)) / CAST(100 AS DOUBLE) * sla_resolution_hours, 1) ELSE CAST(0 AS DOUBLE) END AS overdue_biz_hours,
         CASE WHEN NOT already_breached THEN round_even((CAST(100 AS DOUBLE) - pct) / CAST(100 AS DOUBLE) * sla_resolution_hours, 1) ELSE CAST(0 AS DOUBLE) END AS remaining_biz_hours,
         CASE WHEN last_assignment_date IS NOT NULL THEN round_even(greatest(CAST(date_diff('second', last_assignment_date, {AS_OF}) AS DOUBLE) / 3600.0, 0), 1) END AS assignment_age_h,
         strftime(breach_time, '%Y-%m-%d') AS breach_date,
         CASE WHEN pct >= 100 THEN 'Breached' WHEN pct >= 90 THEN 'Critical (90–100%)' WHEN pct >= 75 THEN 'At Risk (75–90%)'
              WHEN pct >= 50 THEN 'Caution (50–75%)' ELSE 'Healthy (<50%)' END AS sla_severity
  FROM br1),
brx AS (
  SELECT *, CASE WHEN already_breached THEN 'Already Breached' WHEN on_hold THEN 'On Hold (Paused)'
         WHEN remaining_biz_hours <= 4 THEN 'Breaching <4h' WHEN remaining_biz_hours <= 24 THEN 'Breaching Today'
         WHEN remaining_biz_hours <= 72 THEN 'Breaching This Week' ELSE 'Breaching Later' END AS urgency
  FROM br)
"""

ORG = """
org AS (
  SELECT DISTINCT n_name || '-' || c_mktsegment AS assignment_group, r_name AS tower, 'SDM_' || (n_nationkey % 8) AS sdm
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def avg4(x: str, where: str = "") -> str:
    """Mean in whole units of 1/10000."""
    f = f" FILTER (WHERE {where})" if where else ""
    return (f"(CAST(sum(CAST(round(({x}) * CAST(10000 AS DOUBLE)) AS BIGINT)){f} AS DOUBLE) / "
            f"nullif(CAST(count({x}){f} AS DOUBLE) * CAST(10000 AS DOUBLE), 0))")


def avgh(x: str = "mttr_hours", where: str = "") -> str:
    """Mean of hours in whole seconds."""
    f = f" FILTER (WHERE {where})" if where else ""
    return (f"(CAST(sum(CAST(round(({x}) * CAST(3600 AS DOUBLE)) AS BIGINT)){f} AS DOUBLE) / "
            f"nullif(CAST(count({x}){f} AS DOUBLE) * CAST(3600 AS DOUBLE), 0))")


def pct(part: str, whole: str, digits: int = 1) -> str:
    return f"round_even(CAST(100 AS DOUBLE) * ({part}) / nullif({whole}, 0), {digits})"


def pct0(part: str, whole: str, digits: int = 1) -> str:
    return f"coalesce({pct(part, whole, digits)}, CAST(0 AS DOUBLE))"


def r(x: str, digits: int = 1) -> str:
    return f"round_even({x}, {digits})"


def inc(body: str, extra: str = "") -> str:
    return f"WITH {INC}{',' + extra if extra else ''} {body}"


def br(body: str, extra: str = "") -> str:
    return f"WITH {BR}{',' + extra if extra else ''} {body}"


BIG = "CAST({} AS BIGINT)".format
