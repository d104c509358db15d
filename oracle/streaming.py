"""What the streams must arrive at, in SQL."""

from .base import inc
from .cleaning import RAW
from .documented import SHARE

SQL = {
    "stream_ingest": inc("SELECT number, month, state, priority, made_sla, category, created, mttr_hours, tower FROM inc", RAW),
    "stream_dedup": "SELECT event_id, user_id, event_type, value FROM events",
    "stream_kpis_tumbling": """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n,
        CAST(sum(CAST(round(value * CAST(10000 AS DOUBLE)) AS BIGINT)) AS DOUBLE) / 10000.0 AS total, max(value) AS max_value FROM events GROUP BY 1, 2""",
    "stream_volume_sliding": """SELECT d - to_days(CAST(o AS INTEGER)) AS start, d - to_days(CAST(o AS INTEGER)) + INTERVAL 7 DAY AS "end", count(*) AS n
        FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS d FROM events), range(0, 7) t(o) GROUP BY 1, 2""",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events
          WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
        e AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS events FROM s GROUP BY user_id, sid)
        SELECT * FROM e WHERE "end" <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "stream_aging_alerts": inc(f"""SELECT number, priority, round_even(sh, 1) AS elapsed_pct, CASE WHEN sh < 25 THEN 'green' WHEN sh < 75 THEN 'yellow' WHEN sh <= 95 THEN 'red' ELSE 'critical' END AS band
        FROM (SELECT *, {SHARE} AS sh FROM inc WHERE state IN ('Open','In Progress','On Hold'))"""),
    "stream_latest_state": """SELECT 'INC' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') AS number,
        arg_max(l_linestatus || l_returnflag, (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_linestatus || l_returnflag)) AS state,
        CAST(max(l_shipdate) AS TIMESTAMP) AS updated, count(*) AS updates FROM lineitem GROUP BY l_orderkey""",
}
