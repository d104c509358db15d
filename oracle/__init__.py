"""The registered queries again, as plain SQL for another engine to check."""

from . import breach, cleaning, context, documented, ingest, insights, monitoring, scorecard, streaming, text, trends

ALL_SQL: dict[str, str] = {}
for _m in (monitoring, trends, breach, scorecard, insights, context, cleaning, ingest, text, documented, streaming):
    ALL_SQL |= _m.SQL
ALL_SQL["breach_group_join"] = ALL_SQL["breach_by_group"]
ALL_SQL["mttr_overall_join"] = ALL_SQL["trend_mttr"]
