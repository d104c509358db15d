"""Trends in SQL."""

from .base import avgh, inc, pct, r


def forecast_ctes(source: str = "inc") -> str:
    return f"""
fm AS (SELECT month AS period, count(*) AS cnt FROM {source} WHERE month IS NOT NULL GROUP BY 1),
fx AS (SELECT period, cnt, CAST(cnt AS DOUBLE) AS y, CAST(row_number() OVER (ORDER BY period) - 1 AS DOUBLE) AS x, count(*) OVER () AS m FROM fm),
fw AS (SELECT *, power(CAST(0.5 AS DOUBLE) + x * (CAST(0.5 AS DOUBLE) / nullif(m - 1, 0)), 2) AS w FROM fx),
fc AS (SELECT *, sum(w * x) OVER () / sum(w) OVER () AS xm, sum(w * y) OVER () / sum(w) OVER () AS ym FROM fw),
ff AS (SELECT sum(w * (x - xm) * (y - ym)) / sum(w * (x - xm) * (x - xm)) AS slope, max(xm) AS xm, max(ym) AS ym, max(m) AS m,
              max(CAST(period || '-01' AS DATE)) AS last, avg(y) AS mean FROM fc WHERE m >= 3),
fs AS (SELECT CAST(substr(period, 6, 2) AS INTEGER) AS mon, avg(y) AS sm FROM fc GROUP BY 1),
fp AS (SELECT strftime(CAST(last + to_months(CAST(i AS INTEGER)) AS DATE), '%Y-%m') AS period,
              round_even(greatest(CAST(0 AS DOUBLE), ym + slope * (m + i - 1 - xm)) * coalesce(sm / mean, CAST(1 AS DOUBLE)), 0) AS pred
       FROM (SELECT ff.*, i FROM ff, range(1, 7) t(i)) q
       LEFT JOIN fs ON fs.mon = month(CAST(last + to_months(CAST(i AS INTEGER)) AS DATE)))"""


def series(n):
    return f"""SELECT period, CASE WHEN rk <= {n} THEN "group" ELSE 'Others' END AS "group", CAST(sum(c) AS BIGINT) AS count FROM (
        SELECT *, dense_rank() OVER (ORDER BY tot DESC, "group") AS rk FROM (
          SELECT month AS period, assignment_group AS "group", count(*) AS c, sum(count(*)) OVER (PARTITION BY assignment_group) AS tot
          FROM inc GROUP BY 1, 2)) GROUP BY 1, 2"""


SQL = {
    "trend_volume": inc("""SELECT month AS period, assignment_group AS "group", count(*) AS count,
        CAST(sum(count(*)) OVER (PARTITION BY month) AS BIGINT) AS total FROM inc GROUP BY 1, 2"""),
    "trend_volume_weekly": inc("""SELECT week AS period, assignment_group AS "group", count(*) AS count,
        CAST(sum(count(*)) OVER (PARTITION BY week) AS BIGINT) AS total FROM inc GROUP BY 1, 2"""),
    "trend_volume_wide": inc("""SELECT month AS period,
        count(*) FILTER (WHERE tower = 'AFRICA') AS "AFRICA", count(*) FILTER (WHERE tower = 'AMERICA') AS "AMERICA",
        count(*) FILTER (WHERE tower = 'ASIA') AS "ASIA", count(*) FILTER (WHERE tower = 'EUROPE') AS "EUROPE",
        count(*) FILTER (WHERE tower = 'MIDDLE EAST') AS "MIDDLE EAST" FROM inc GROUP BY 1"""),
    "trend_mttr": inc(f"""SELECT a.period, "group", avg_mttr, overall_avg FROM
        (SELECT month AS period, assignment_group AS "group", {r(avgh())} AS avg_mttr FROM inc WHERE mttr_hours > 0 GROUP BY 1, 2) a
        JOIN (SELECT month AS period, {r(avgh())} AS overall_avg FROM inc WHERE mttr_hours > 0 GROUP BY 1) b ON a.period = b.period"""),
    "trend_category": inc("SELECT month AS period, category, count(*) AS count FROM inc GROUP BY 1, 2"),
    "trend_sla": inc(f"""SELECT month AS period, count(*) AS total, count(*) FILTER (WHERE made_sla_bool) AS met,
        count(*) FILTER (WHERE NOT made_sla_bool) AS breached,
        {pct('count(*) FILTER (WHERE made_sla_bool)', 'count(*)')} AS compliance_pct FROM inc GROUP BY 1"""),
    "trend_priority": inc("""SELECT month AS period, count(*) FILTER (WHERE priority = 1) AS "P1", count(*) FILTER (WHERE priority = 2) AS "P2",
        count(*) FILTER (WHERE priority = 3) AS "P3", count(*) FILTER (WHERE priority = 4) AS "P4" FROM inc GROUP BY 1"""),
    "trend_heatmap_dow_hour": inc("""SELECT dow, hour, count(*) AS count, CAST(isodow(created) - 1 AS INTEGER) AS dow_order
        FROM inc GROUP BY dow, hour, isodow(created)"""),
    "trend_reassign_by_group": inc(f"""SELECT assignment_group AS "group",
        {r('CAST(sum(reassignment_count) AS DOUBLE) / count(*)', 2)} AS avg_reassignments, count(*) AS total_incidents,
        count(*) FILTER (WHERE reassignment_count >= 3) AS high_reassignment FROM inc GROUP BY 1"""),
    "trend_reassign_scatter": inc("""SELECT number, mttr_hours, reassignment_count, priority, assignment_group AS "group", category
        FROM inc WHERE mttr_hours < 500 ORDER BY md5(number), number LIMIT 500"""),
    "trend_reassign_bucket": inc(f"""SELECT CASE reassignment_count WHEN 0 THEN '0 (First Try)' WHEN 1 THEN '1 Reassign'
          WHEN 2 THEN '2 Reassigns' ELSE '3+ Reassigns' END AS label, count(*) AS total,
        CAST(floor(CAST(100 AS DOUBLE) * count(*) FILTER (WHERE NOT made_sla_bool) / count(*) + 0.5) AS BIGINT) AS breach_pct,
        coalesce(CAST(floor({avgh(where='mttr_hours > 0')} + 0.5) AS BIGINT), 0) AS avg_mttr FROM inc GROUP BY 1"""),
    "trend_forecast": inc("""SELECT period, cnt AS count, CAST(NULL AS DOUBLE) AS ci_lower, CAST(NULL AS DOUBLE) AS ci_upper, 'actual' AS type FROM fm
        UNION ALL SELECT period, CAST(pred AS BIGINT), greatest(CAST(0 AS DOUBLE), pred - round_even(pred * CAST(0.12 AS DOUBLE), 0)),
        pred + round_even(pred * CAST(0.12 AS DOUBLE), 0), 'forecast' FROM fp""", forecast_ctes()),
    "trend_root_cause": inc("""SELECT category, subcategory, c AS count, CAST(sum(c) OVER (PARTITION BY category) AS BIGINT) AS category_total,
        CAST(row_number() OVER (PARTITION BY category ORDER BY c DESC, subcategory) AS INTEGER) AS rank
        FROM (SELECT category, subcategory, count(*) AS c FROM inc GROUP BY 1, 2)"""),
    "trend_volume_by_group": inc("""SELECT CASE WHEN rn <= 10 THEN g ELSE 'Others' END AS name, CAST(sum(c) AS BIGINT) AS count,
        CASE WHEN rn <= 10 THEN 0 ELSE count(*) END AS folded
        FROM (SELECT assignment_group AS g, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, assignment_group) AS rn FROM inc GROUP BY 1)
        GROUP BY 1, rn <= 10"""),
    "trend_mttr_by_group": inc(f"""SELECT assignment_group AS name, {r(avgh())} AS mttr, count(*) AS count FROM inc
        WHERE mttr_hours >= 0 GROUP BY 1 HAVING count(*) >= 2 ORDER BY mttr DESC, name LIMIT 10"""),
    "trend_series_top_n": inc(series(10)),
}
