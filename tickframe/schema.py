"""Column lists and contract tables of the incident data model."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Canonical upload columns, in file order: (name, required, default, description).
CANONICAL = [
    ("number", True, "", "Incident ID (e.g. INC012447639)"),
    ("created", True, "", "Created date — DD-MM-YYYY HH:MM"),
    ("impact_user", False, "", "Impacted user name (email or display)"),
    ("first_assignment_group", True, "", "Primary assignment group"),
    ("assignment_group", False, "", "L2 / escalation assignment group"),
    ("service_offering", False, "", "Application / service name"),
    ("priority", True, "4 - Standard", "1-Critical / 2-High / 3-Moderate / 4-Standard"),
    ("urgency", False, "3 - Low", "1-High / 2-Medium / 3-Low"),
    ("state", True, "Open", "Open / In Progress / On Hold / Resolved / Closed"),
    ("hold_reason", False, "", "Reason if On Hold"),
    ("assigned_to", False, "", "Agent name / email"),
    ("short_description", False, "", "Free-text incident description"),
    ("category", False, "", "Category (auto-derived if blank)"),
    ("subcategory", False, "", "Sub-category"),
    ("tags", False, "", "Comma-separated tags"),
    ("updated", False, "", "Last updated date"),
    ("updated_by", False, "", "Last updated by"),
    ("made_sla", False, "FALSE", "TRUE / FALSE — was SLA met?"),
    ("sla_due", False, "", "SLA due date"),
    ("resolution_code", False, "", "How the incident was resolved"),
    ("resolved", False, "", "Resolution date"),
    ("reopen_count", False, "0", "Times the ticket was reopened"),
    ("reassignment_count", False, "0", "Number of group reassignments"),
    ("business_duration", False, "0", "Business duration in seconds"),
    ("last_assignment_date", False, "", "Date of last reassignment"),
    ("resolution_notes", False, "", "Resolution / close notes"),
]
# Header aliases, in order; one applies only while its target column is absent.
HEADER_ALIASES = [
    ("impacted_user", "impact_user"), ("caller_id", "impact_user"), ("caller", "impact_user"),
    ("on_hold_reason", "hold_reason"),
    ("opened", "created"), ("opened_at", "created"), ("sys_created_on", "created"),
    ("close_notes", "resolution_notes"), ("close_code", "resolution_code"),
    ("resolved_at", "resolved"), ("closed_at", "resolved"),
    ("sys_updated_on", "updated"), ("last_updated", "updated"),
    ("business_service", "service_offering"), ("cmdb_ci", "service_offering"),
    ("assigned_to_name", "assigned_to"),
]
# Loader defaults for columns an export may lack.
LOADER_DEFAULTS = {
    "hold_reason": "", "tags": "", "reopen_count": "0", "reassignment_count": "0",
    "business_duration": "0", "resolution_notes": "", "resolution_code": "",
    "service_offering": "", "last_assignment_date": None, "urgency": "3",
    "subcategory": "", "updated": None, "updated_by": "", "sla_due": None,
    "assigned_to": "", "impact_user": "", "last_reopened_at": None, "duration": "0",
    "internal_id": "", "tower": "", "sdm": "",
}
EXPORT_COLUMNS = ["number", "created", "priority", "state", "first_assignment_group",
                  "assigned_to", "category", "short_description", "made_sla", "mttr_hours",
                  "reassignment_count", "reopen_count", "resolved"]
# Contract: (priority, response hours, response label, resolution hours, resolution label, support).
SLA_CONTRACT = [
    (1, 0.25, "15 min", 4, "4 hours", "24×7"),
    (2, 1.0, "1 hour", 8, "8 hours", "24×7"),
    (3, 4.0, "4 hours", 72, "72 business hours", "24×5"),
    (4, 4.0, "4 hours", 120, "120 business hours", "24×5"),
]
KPI_TARGETS = [
    ("first_time_right", "Reopen count ≤ 1% of closed incidents", 1.0),
    ("tickets_aging", "95% of incidents resolved within 30 calendar days", 95.0),
    ("csat", "CSAT score ≥ 4.5/5 for 95% of surveyed incidents", 95.0),
]
# Service metrics: (id, name, type, priority, target, threshold, window hours, description).
AM_METRICS = [
    ("AM.01", "P1 Incident Response", "SLA", 1, 97.0, 95.0, 1,
     "P1 acknowledged within 1 hour [24×7]"),
    ("AM.02", "P2 Incident Response", "SLA", 2, 95.0, 90.0, 4,
     "P2 acknowledged within 4 hours [24×7]"),
    ("AM.03", "P3 Incident Response", "SLA", 3, 90.0, 85.0, 4,
     "P3 acknowledged within 4 business hours [24×5]"),
    ("AM.04", "P4 Incident Response", "SLA", 4, 85.0, 80.0, 8,
     "P4 acknowledged within 8 business hours [24×5]"),
    ("AM.05", "P1 Incident Resolution", "SLA", 1, 95.0, 90.0, 24,
     "P1 resolved within 24 hours [24×7]"),
    ("AM.06", "P2 Incident Resolution", "SLA", 2, 95.0, 90.0, 8,
     "P2 resolved within 8 hours [24×7]"),
    ("AM.07", "P3 Incident Resolution", "SLA", 3, 95.0, 90.0, 12,
     "P3 resolved avg within 12 business hours"),
    ("AM.08", "P4 Incident Resolution", "SLA", 4, 95.0, 90.0, 120,
     "P4 resolved within 5 business days (120 h)"),
    ("AM.09", "SR Resolution (Access)", "SLA", None, 90.0, 85.0, 24,
     "Access-provisioning SRs resolved within SLA"),
    ("AM.10", "SR Resolution (Other)", "SLA", None, 85.0, 80.0, 48,
     "Other service requests resolved within SLA"),
    ("AM.17", "First Time Fix Rate", "KPI", None, 55.0, 45.0, None,
     "% incidents resolved without reassignment or reopen"),
    ("AM.18", "Ticket Aging ≤30 days", "KPI", None, 95.0, 90.0, 720,
     "% tickets resolved or active within 30 days"),
]
# End of fixed values.

CANONICAL_COLUMNS = [c[0] for c in CANONICAL]
REQUIRED_COLUMNS = [c[0] for c in CANONICAL if c[1]]
CANONICAL_DEFAULTS = {c[0]: c[2] for c in CANONICAL}
DATE_COLUMNS = ["created", "updated", "resolved", "sla_due", "last_assignment_date",
                "last_reopened_at"]

BREACH_DATE_COLUMNS = ["created", "breach_time", "stop_time", "last_assignment_date"]
BREACH_TEXT_COLUMNS = ["task", "assignment_group", "priority", "service", "service_offering",
                       "assigned_to", "state", "internal_id", "work_notes"]
BREACH_COUNT_COLUMNS = ["reassignment_count", "reopen_count", "actual_time_left"]

ORG_MAP_SCHEMA = T.StructType([T.StructField(c, T.StringType())
                               for c in ("assignment_group", "tower", "sdm")])


def literal_table(spark: SparkSession, columns: dict[str, pa.DataType], rows: list) -> DataFrame:
    """A table whose rows are written in the code: its size is fixed and tiny."""
    data = {name: pa.array([r[i] for r in rows], type=kind)
            for i, (name, kind) in enumerate(columns.items())}
    return spark.createDataFrame(pa.table(data))


def sla_contract(spark: SparkSession) -> DataFrame:
    return literal_table(spark, {
        "priority": pa.int32(), "response_hours": pa.float64(), "response_label": pa.string(),
        "resolution_hours": pa.int32(), "resolution_label": pa.string(), "support": pa.string(),
    }, SLA_CONTRACT)


def kpi_targets(spark: SparkSession) -> DataFrame:
    return literal_table(spark, {"kpi": pa.string(), "description": pa.string(),
                                 "threshold_pct": pa.float64()}, KPI_TARGETS)


def am_metrics(spark: SparkSession) -> DataFrame:
    return literal_table(spark, {
        "id": pa.string(), "name": pa.string(), "type": pa.string(), "priority": pa.int32(),
        "target": pa.float64(), "threshold": pa.float64(), "window_h": pa.int32(),
        "description": pa.string()}, AM_METRICS)


def column_catalog(spark: SparkSession) -> DataFrame:
    """The upload contract: one row per canonical column."""
    return literal_table(spark, {"name": pa.string(), "required": pa.bool_(),
                                 "default": pa.string(), "description": pa.string()}, CANONICAL)
