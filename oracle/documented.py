"""Documented measures in SQL."""

from .base import AS_OF, avg4, avgh, br, inc, pct, r
from .text import AUD, P12

MET = "count(*) FILTER (WHERE made_sla_bool)"
FAR = "count(*) FILTER (WHERE reassignment_count = 0)"
DONE = "count(*) FILTER (WHERE state IN ('Resolved', 'Closed'))"
SHARE = f"CAST(100 AS DOUBLE) * (CAST(date_diff('second', created, {AS_OF}) AS DOUBLE) / 3600.0) / sla_h"
AGENT = "CASE WHEN contains(assigned_to, '(') THEN rtrim(split_part(assigned_to, '(', 1)) ELSE assigned_to END"


def owners(aggs):
    return inc(f"SELECT 'tower' AS kind, tower AS owner, {aggs} FROM inc GROUP BY tower UNION ALL SELECT 'sdm', sdm, {aggs} FROM inc GROUP BY sdm")


def clip(x):
    return f"least(greatest({x}, CAST(0 AS DOUBLE)), CAST(100 AS DOUBLE))"


SQL = {
    "doc_rolling_7d": inc("""SELECT strftime(d, '%Y-%m-%d') AS date, c AS count,
        round_even(CAST(sum(c) OVER w AS DOUBLE) / count(*) OVER w, 2) AS moving_avg FROM
        (SELECT CAST(g AS DATE) AS d, coalesce(c, 0) AS c FROM (SELECT unnest(generate_series((SELECT min(CAST(created AS DATE)) FROM inc)::TIMESTAMP, (SELECT max(CAST(created AS DATE)) FROM inc)::TIMESTAMP, INTERVAL 1 DAY)) AS g)
         LEFT JOIN (SELECT CAST(created AS DATE) AS cd, count(*) AS c FROM inc GROUP BY 1) ON cd = CAST(g AS DATE))
        WINDOW w AS (ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""),
    "doc_growth": inc("""SELECT period, category, c AS count, g AS growth_pct, coalesce(g > 20, false) AS flag FROM (SELECT *,
        round_even(CAST(100 AS DOUBLE) * (c - lag(c) OVER w) / lag(c) OVER w, 1) AS g FROM (SELECT month AS period, category, count(*) AS c FROM inc GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY category ORDER BY period))"""),
    "doc_mttr_variance_slope": inc("""SELECT "group", CAST(sum(n) AS BIGINT) AS resolved,
        round_even(CASE WHEN sum(n) > 1 THEN sqrt(greatest((CAST(sum(ss) AS DOUBLE) - CAST(sum(s) AS DOUBLE) * CAST(sum(s) AS DOUBLE) / sum(n)) / (sum(n) - 1), 0)) / 3600.0 END, 2) AS mttr_stddev,
        round_even(regr_slope(CAST(s AS DOUBLE) / n / 3600.0, x), 3) AS mttr_slope
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "group" ORDER BY month) AS DOUBLE) AS x FROM
          (SELECT assignment_group AS "group", month, count(*) AS n, sum(CAST(round(mttr_hours * 3600) AS BIGINT)) AS s,
                  sum(CAST(round(mttr_hours * 3600) AS HUGEINT) * CAST(round(mttr_hours * 3600) AS HUGEINT)) AS ss FROM inc WHERE mttr_hours IS NOT NULL GROUP BY 1, 2))
        GROUP BY 1"""),
    "doc_category_share": inc(f"""SELECT month AS period, category, count(*) AS count,
        {pct('count(*)', 'sum(count(*)) OVER (PARTITION BY month)')} AS share_pct FROM inc GROUP BY 1, 2"""),
    "doc_reassign_rate_impact": inc(f"""SELECT {pct('count(*) FILTER (WHERE reassignment_count > 0)', 'count(*)')} AS reassigned_pct,
        {r('CAST(sum(reassignment_count) AS DOUBLE) / count(*)', 2)} AS avg_reassignments,
        {r(avgh(where='reassignment_count = 0'))} AS mttr_first_try, {r(avgh(where='reassignment_count > 0'))} AS mttr_reassigned FROM inc"""),
    "doc_first_assignment_right": owners(f"count(*) AS total, {pct(FAR, 'count(*)')} AS far_pct"),
    "doc_tower_sdm_compare": owners(f"""count(*) AS total, {pct(MET, 'count(*)')} AS sla_pct, {r(avgh())} AS avg_mttr,
        {pct('count(*) FILTER (WHERE reopen_count > 0)', 'count(*)')} AS reopen_pct, {pct(FAR, 'count(*)')} AS far_pct, {pct(DONE, 'count(*)')} AS resolved_pct"""),
    "doc_composite_score": inc(f"""SELECT tower, score, CASE WHEN score >= 80 THEN 'green' WHEN score >= 70 THEN 'amber' ELSE 'red' END AS band FROM (
        SELECT tower, round_even(CAST(0.4 AS DOUBLE) * (CAST(100 AS DOUBLE) * sum(met) / sum(n)) + CAST(0.3 AS DOUBLE) * (CAST(100 AS DOUBLE) - {clip('CAST(100 AS DOUBLE) * stddev_samp(mttr) / avg(mttr)')})
          + CAST(0.2 AS DOUBLE) * (CAST(100 AS DOUBLE) * sum(far) / sum(n))
          + CAST(0.1 AS DOUBLE) * {clip('CAST(100 AS DOUBLE) * (arg_max(n, month) - arg_max(prev, month)) / arg_max(prev, month)')}, 1) AS score
        FROM (SELECT *, lag(n) OVER (PARTITION BY tower ORDER BY month) AS prev FROM
          (SELECT tower, month, count(*) AS n, {MET} AS met, {FAR} AS far, {r(avgh(), 4)} AS mttr FROM inc GROUP BY 1, 2)) GROUP BY tower)"""),
    "doc_pareto_80": inc(f"""SELECT tower, c AS count, {pct('run', 'al')} AS cumulative_pct FROM (SELECT tower, c, sum(c) OVER (ORDER BY c DESC, tower) AS run, sum(c) OVER () AS al
        FROM (SELECT tower, count(*) AS c FROM inc GROUP BY 1)) WHERE CAST(100 AS DOUBLE) * (run - c) / al < 80"""),
    "doc_ownership_bands": br("""SELECT CASE WHEN assignment_age_h < 24 THEN 'green' WHEN assignment_age_h < 72 THEN 'amber' WHEN assignment_age_h < 168 THEN 'red' ELSE 'critical' END AS band,
        count(*) AS count FROM brx WHERE assignment_age_h IS NOT NULL GROUP BY 1"""),
    "doc_aging_bands": inc(f"""SELECT CASE WHEN sh < 25 THEN 'green' WHEN sh < 75 THEN 'yellow' WHEN sh <= 95 THEN 'red' ELSE 'critical' END AS band, count(*) AS count
        FROM (SELECT {SHARE} AS sh FROM inc WHERE state IN ('Open','In Progress','On Hold')) GROUP BY 1"""),
    "doc_class_metrics": inc("""SELECT class, CAST(sum(i) AS BIGINT) AS support, round_even(CAST(sum(tp) AS DOUBLE) / nullif(sum(sd), 0), 3) AS precision,
        round_even(CAST(sum(tp) AS DOUBLE) / nullif(sum(i), 0), 3) AS recall,
        round_even(coalesce(CAST(2 AS DOUBLE) * (CAST(sum(tp) AS DOUBLE) / nullif(sum(sd), 0)) * (CAST(sum(tp) AS DOUBLE) / nullif(sum(i), 0)) /
          nullif(CAST(sum(tp) AS DOUBLE) / nullif(sum(sd), 0) + CAST(sum(tp) AS DOUBLE) / nullif(sum(i), 0), 0), 0), 3) AS f1
        FROM (SELECT priority AS class, CASE WHEN priority = urgency THEN 1 ELSE 0 END AS tp, 1 AS i, 0 AS sd FROM inc
              UNION ALL SELECT urgency, 0, 0, 1 FROM inc) GROUP BY 1"""),
    "doc_burndown": inc("""SELECT tower, strftime(wk, '%Y-%m-%d') AS week, created, resolved, backlog, g AS growth_pct, coalesce(g > 10, false) AS flag FROM (
        SELECT *, round_even(CAST(100 AS DOUBLE) * (backlog - lag(backlog) OVER w) / nullif(lag(backlog) OVER w, 0), 1) AS g FROM (
          SELECT tower, wk, CAST(sum(c) AS BIGINT) AS created, CAST(sum(rr) AS BIGINT) AS resolved,
                 CAST(sum(sum(c) - sum(rr)) OVER (PARTITION BY tower ORDER BY wk) AS BIGINT) AS backlog
          FROM (SELECT tower, date_trunc('week', created) AS wk, 1 AS c, 0 AS rr FROM inc UNION ALL
                SELECT tower, date_trunc('week', resolved), 0, 1 FROM inc WHERE resolved IS NOT NULL) GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY tower ORDER BY wk))"""),
    "doc_affinity": inc(f"""SELECT service_offering, assignment_group AS "group", count(*) AS tickets, {pct(MET, 'count(*)')} AS success_pct,
        {r(avgh())} AS avg_mttr, {pct('count(*) FILTER (WHERE reopen_count > 0)', 'count(*)')} AS reopen_pct FROM inc WHERE service_offering <> '' GROUP BY 1, 2"""),
    "doc_agent_ownership": br(f"""SELECT "group", agent, load, avg_remaining_h, breached,
        round_even(load / (CAST(sum(load) OVER (PARTITION BY "group") AS DOUBLE) / count(*) OVER (PARTITION BY "group")), 2) AS vs_peers FROM
        (SELECT assignment_group AS "group", {AGENT} AS agent, count(*) AS load, {r(avg4('remaining_biz_hours'))} AS avg_remaining_h,
                count(*) FILTER (WHERE already_breached) AS breached FROM brx WHERE trim(assigned_to) <> '' GROUP BY 1, 2)"""),
    "doc_queue_alerts": br("""SELECT *, concat_ws(',', CASE WHEN queue > 20 THEN 'queue' END, CASE WHEN p1_breaches > 0 THEN 'p1_breach' END, CASE WHEN overdue > 0 THEN 'overdue' END) AS alerts FROM
        (SELECT assignment_group || '/' || CAST(least(seq % 13, 6) AS VARCHAR) AS "group", count(*) AS queue, count(*) FILTER (WHERE already_breached AND priority_num = 1) AS p1_breaches,
         count(*) FILTER (WHERE overdue_biz_hours > 0) AS overdue FROM brx GROUP BY 1) WHERE queue > 20 OR p1_breaches > 0 OR overdue > 0"""),
    "doc_sla_variance": inc(f"""SELECT period, priority, a AS actual_pct, CAST(90 AS DOUBLE) AS target_pct, round_even(a - 90, 1) AS variance FROM
        (SELECT month AS period, priority, {pct(MET, 'count(*)')} AS a FROM inc GROUP BY 1, 2)"""),
    "doc_cost": inc("""SELECT "group", priority, tickets, round_even(s / CAST(3600 AS DOUBLE), 1) AS hours, round_even(s / CAST(3600 AS DOUBLE) * rate, 0) AS cost,
        s / (CAST(tickets AS DOUBLE) * CAST(3600 AS DOUBLE)) * rate AS cost_per_ticket FROM
        (SELECT assignment_group AS "group", priority, count(*) AS tickets, CAST(sum(CAST(round(mttr_hours * 3600) AS BIGINT)) AS DOUBLE) AS s,
                CAST(CASE priority WHEN 1 THEN 120 WHEN 2 THEN 90 WHEN 3 THEN 60 ELSE 45 END AS DOUBLE) AS rate FROM inc WHERE mttr_hours IS NOT NULL GROUP BY 1, 2)"""),
    "doc_reassign_causes": inc("""SELECT assignment_group AS "group", count(*) AS tickets, CAST(sum(reassignment_count) AS BIGINT) AS reassignments,
        count(*) FILTER (WHERE reassignment_count > 0) AS reassigned,
        count(*) FILTER (WHERE reassignment_count > 0 AND (contains(lower(short_description), 'ring') OR contains(lower(short_description), 'bolt'))) AS parts,
        count(*) FILTER (WHERE reassignment_count > 0 AND contains(lower(short_description), 'red')) AS colour FROM inc GROUP BY 1"""),
    "doc_tower_card": inc(f"""SELECT tower, month AS period, count(*) AS tickets, {pct(MET, 'count(*)')} AS sla_pct, {pct(FAR, 'count(*)')} AS far_pct,
        {r(avgh())} AS avg_mttr, {pct(DONE, 'count(*)')} AS resolution_pct FROM inc GROUP BY 1, 2"""),
    "doc_mttr_band": inc(f"""SELECT *, CASE WHEN mttr <= 4 THEN 'green' WHEN mttr <= 8 THEN 'orange' ELSE 'red' END AS band FROM
        (SELECT tower AS name, {r(avgh())} AS mttr, count(*) AS count FROM scaled WHERE mttr_hours >= 0 GROUP BY 1 HAVING count(*) >= 2 ORDER BY mttr DESC, name LIMIT 10)""",
        """scaled AS (SELECT * REPLACE (floor(round(mttr_hours * 3600) / CASE tower WHEN 'AFRICA' THEN 10 WHEN 'AMERICA' THEN 5 ELSE 1 END) / CAST(3600 AS DOUBLE) AS mttr_hours) FROM inc)"""),
    "train_priority_planted": inc("""SELECT count(*) AS total_incidents, 'priority' AS label, count(*) AS trained_rows, count(DISTINCT priority) AS classes,
        CAST(1 AS DOUBLE) AS accuracy FROM inc"""),
    "train_group_planted": inc("""SELECT CAST(sum(n) AS BIGINT) AS total_incidents, 'assignment_group' AS label, CAST(sum(n) FILTER (WHERE n >= 5) AS BIGINT) AS trained_rows,
        count(*) FILTER (WHERE n >= 5) AS classes, CAST(1 AS DOUBLE) AS accuracy FROM (SELECT count(*) AS n FROM inc GROUP BY assignment_group)"""),
    "predict_priority_planted": inc("SELECT number, CAST(priority AS INTEGER) AS priority, priority_label FROM inc"),
    "predict_group_planted": inc('SELECT number, assignment_group AS "group" FROM inc'),
    "predict_category_known": inc("SELECT number, category FROM inc WHERE category <> 'General'"),
    "doc_priority_mismatch_planted": inc("""SELECT number, CAST(priority % 4 + 1 AS INTEGER) AS assigned, CAST(priority AS INTEGER) AS predicted
        FROM inc WHERE substr(md5(number), 1, 2) = '00'"""),
    "doc_mttr_quantiles": inc("""SELECT tower, priority, count(*) AS tickets, round_even(quantile_cont(mttr_hours, 0.5), 3) AS p50,
        round_even(quantile_cont(mttr_hours, 0.95), 3) AS p95 FROM inc WHERE mttr_hours IS NOT NULL GROUP BY 1, 2"""),
    "doc_confusion": inc("SELECT current_priority AS actual, suggested_priority AS predicted, count(*) AS count FROM aud GROUP BY 1, 2", f"{P12},{AUD}"),
}
