"""Dedup, merge, link, set operations and window kinds in SQL."""

from .base import BR, avgh, br, inc, pct

NUM = "'INC' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0')"
UPD = f"""upd AS (SELECT {NUM} AS number, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS file_rank, CAST(l_shipdate AS TIMESTAMP) AS updated,
  l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem)"""
DESC = "updated DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC"
COLS = "number, file_rank, updated, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
SURV = """surv AS (SELECT event_id, 'INC' || lpad(CAST(event_id * 2 AS VARCHAR), 9, '0') AS incident_number, value AS csat_score FROM events)"""


def link(rows, key, skipped=True):
    return f"""SELECT count(*) AS records_imported, count(i.number) AS records_merged,
        {'count(*) - count(i.number)' if skipped else 'CAST(0 AS BIGINT)'} AS duplicates_skipped, 0 AS validation_warnings
        FROM {rows} r LEFT JOIN (SELECT DISTINCT number FROM inc) i ON r.{key} = i.number"""


SAMPLE = """smp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY seq) AS rn FROM inc WHERE priority IN (1, 2))
  WHERE (priority = 1 AND rn <= 5) OR (priority = 2 AND rn <= 20 - (SELECT least(5, count(*)) FROM inc WHERE priority = 1)))"""

SQL = {
    "dedup_keep_last": f"WITH {UPD} SELECT {COLS} FROM upd QUALIFY row_number() OVER (PARTITION BY number ORDER BY {DESC}) = 1",
    "dedup_removed": f"WITH {UPD} SELECT number, count(*) - 1 AS removed FROM upd GROUP BY 1 HAVING count(*) > 1",
    "dedup_cross_file": f"WITH {UPD} SELECT {COLS} FROM upd QUALIFY row_number() OVER (PARTITION BY number ORDER BY file_rank DESC, {DESC}) = 1",
    "dedup_vs_existing": inc("SELECT number, state FROM inc LEFT JOIN line ON l_orderkey = seq WHERE l_orderkey IS NULL"),
    "dedup_existing_list": inc("SELECT number, state FROM inc JOIN line ON l_orderkey = seq"),
    "merge_incidents": inc("""SELECT count(*) FILTER (WHERE l_orderkey IS NULL) AS records_imported, count(l_orderkey) AS duplicates_skipped,
        (SELECT count(*) FROM line) + count(*) FILTER (WHERE l_orderkey IS NULL) AS total_in_system FROM inc LEFT JOIN line ON l_orderkey = seq"""),
    "union_existing": inc(f"""SELECT 'INC' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') AS number, CAST(NULL AS VARCHAR) AS state FROM line
        UNION ALL SELECT number, state FROM inc LEFT JOIN line ON l_orderkey = seq WHERE l_orderkey IS NULL"""),
    "union_files": f"""WITH {BR}, {SURV} SELECT number, state, CAST(NULL AS DOUBLE) AS business_elapsed_percentage, CAST(NULL AS DOUBLE) AS csat_score FROM inc
        UNION ALL SELECT task, state, pct, NULL FROM brx UNION ALL SELECT incident_number, NULL, NULL, csat_score FROM surv""",
    "union_sample": inc("SELECT number, priority FROM smp", SAMPLE),
    "except_by_key": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "intersect_by_key": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "link_surveys": inc(link("surv", "incident_number"), SURV),
    "link_sla_breach": br("""SELECT count(*) AS records_imported, count(*) FILTER (WHERE seq % 6 <> 0) AS records_merged,
        count(*) FILTER (WHERE seq % 6 = 0) AS duplicates_skipped, 0 AS validation_warnings FROM brx"""),
    "link_metrics": inc(link("lnk", "number", False), f"lnk AS (SELECT 'INC' || lpad(CAST(l_orderkey * 3 AS VARCHAR), 9, '0') AS number FROM lineitem)"),
    "link_scores": inc("""SELECT number, priority, score_count, score_max, score_min FROM inc LEFT JOIN (SELECT incident_number, CAST(count(*) AS DOUBLE) AS score_count,
        max(csat_score) AS score_max, min(csat_score) AS score_min FROM surv GROUP BY 1) s ON s.incident_number = number""", SURV),
    "top_k": inc("""SELECT number, priority, created FROM inc WHERE state IN ('Open','In Progress','On Hold') ORDER BY priority, created, number LIMIT 5"""),
    "cumulative_sum": inc("""SELECT category, count, CAST(sum(count) OVER (ORDER BY count DESC, category ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running
        FROM (SELECT category, count(*) AS count FROM inc GROUP BY 1)"""),
    "share_of_total": inc(f"SELECT tower, count(*) AS count, {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage FROM inc GROUP BY 1"),
    "lag_last_vs_previous": inc("""SELECT period, count, CAST(lag(count) OVER (ORDER BY period) AS DOUBLE) AS previous FROM (SELECT month AS period, count(*) AS count FROM inc GROUP BY 1)"""),
    "ranking": inc("""SELECT assignment_group AS "group", count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, assignment_group) AS rank FROM inc GROUP BY 1"""),
    "grouping_sets": inc("""SELECT coalesce(tower, 'ALL') AS tower, coalesce(category, 'ALL') AS category, count(*) AS count FROM inc GROUP BY ROLLUP (tower, category)"""),
    "distinct_count": inc("SELECT month, count(DISTINCT assignment_group) AS groups FROM inc GROUP BY 1"),
    "sample": inc("SELECT number FROM inc ORDER BY md5(number), number LIMIT 500"),
}
