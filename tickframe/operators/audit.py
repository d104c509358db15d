"""Priority audit by contract keywords, its sample, its summary and prompt texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickframe.functions.numbers import ratio_pct_or_zero
from tickframe.functions.rules import (
    AUDIT_P1_KEYWORDS, AUDIT_P2_KEYWORDS, AUDIT_P4_KEYWORDS, hit_count, lowered,
)
from tickframe.schema import literal_table

# Contract criteria per priority ({org} is the contract's customer).
DEFINITIONS = {
    1: {
        "label": "Critical / P1", "support": "24 × 7",
        "response_sla": "Within 15 Minutes", "resolution_sla": "Within 4 Hours",
        "criteria": (
            "A complete failure of an In-Scope Application or supported process in Production Instance, "
            "with NO available workaround. This includes: (1) outages affecting MOST {org} end users; "
            "(2) an entire {org} division being impacted; (3) incidents occurring during critical business "
            "periods (e.g., month-end, year-end); or (4) any incident with a financial impact exceeding "
            "$500,000. Priority 1 Incidents shall take precedence over all other requests."),
        "key_indicators": [
            "Complete application/process failure — no workaround available",
            "Affects the majority of {org} end users or an entire {org} division",
            "Occurring during month-end, year-end, or critical business period",
            "Confirmed financial impact exceeding $500,000",
            "Production environment — not dev/test/staging"],
        "disqualifiers": [
            "A workaround exists (even partial) → consider P2",
            "Affects only a small number of users → P3 or P4",
            "Non-production environment (dev, test, UAT)",
            "Financial impact below $500,000",
            "Isolated, non-widespread issue"],
    },
    2: {
        "label": "High / P2", "support": "24 × 7",
        "response_sla": "Within 1 Hour", "resolution_sla": "Within 8 Hours",
        "criteria": (
            "Major issues within an In-Scope Application or supported process in Production Instance "
            "that impact a SIGNIFICANT PORTION of the user base. This includes: (1) high-visibility "
            "incidents involving senior management; (2) time-sensitive business processes impacted; "
            "or (3) any incident with a financial impact between $50,000 and $500,000. "
            "Example: inability to generate critical business reports."),
        "key_indicators": [
            "Significant portion of users affected (not just 1–2 people)",
            "Senior management or executive stakeholder directly impacted",
            "Time-sensitive business process impaired (e.g., payroll, reporting deadline)",
            "Financial impact confirmed between $50,000 and $500,000",
            "Critical report generation or data access failure",
            "Production environment with partial service degradation"],
        "disqualifiers": [
            "Only 1–2 users affected with no senior management involvement → P3",
            "Financial impact below $50,000 → P3 or P4",
            "Non-time-sensitive issue → P3",
            "Workaround is readily available → P3 or P4",
            "Isolated individual user access issue → P3 or P4"],
    },
    3: {
        "label": "Moderate / P3", "support": "24 × 5",
        "response_sla": "Within 4 Hours", "resolution_sla": "Within 72 Business Hours",
        "criteria": (
            "Issues affecting a limited number of users on a recurring basis, impeding their ability "
            "to complete work. Includes incidents with financial impact. "
            "Example: inability to access or properly use implemented functionality."),
        "key_indicators": [
            "Limited number of users affected on recurring basis",
            "Partial functionality loss — work is impeded but not fully blocked",
            "Recurring pattern of the same issue"],
        "disqualifiers": [],
    },
    4: {
        "label": "Standard / P4", "support": "24 × 5",
        "response_sla": "Within 4 Hours", "resolution_sla": "Within 120 Business Hours",
        "criteria": (
            "Informational inquiries or isolated, non-recurring incidents affecting non-critical users "
            "or processes. Work-arounds are readily available and business impact is minimal."),
        "key_indicators": [
            "Isolated, non-recurring incident",
            "Workaround is readily available",
            "Minimal business impact",
            "Non-critical users or processes",
            "Informational inquiry or access request"],
        "disqualifiers": [],
    },
}
REASONS = {
    "p1_ok": "Description contains P1 indicators (widespread impact, no workaround).",
    "p1_to_2": "Description lacks P1 breadth (no full-division outage, no $500K+ impact). Fits P2 better.",
    "p1_to_3": "Description appears to describe a limited-scope issue, not qualifying for P1.",
    "p2_ok": "Description contains P2 indicators (significant user impact, critical process).",
    "p2_to_4": "Description appears to be an isolated/informational request, not P2.",
    "p2_to_3": "Description describes a limited-scope issue. Consider P3 (limited users, recurring).",
    "other": "Insufficient keywords to determine reclassification.",
}
# End of fixed values.

DEFAULT_ORG = "company"


def definition(priority: int, org: str = DEFAULT_ORG) -> dict:
    return {k: ([x.replace("{org}", org) for x in v] if isinstance(v, list) else v.replace("{org}", org))
            for k, v in DEFINITIONS[priority].items()}


def priority_definitions(spark: SparkSession, org: str = DEFAULT_ORG) -> DataFrame:
    """The contract criteria as a dimension with array columns."""
    text = ["label", "support", "response_sla", "resolution_sla", "criteria"]
    lists = ["key_indicators", "disqualifiers"]
    kinds = {"priority": pa.int32(), **{c: pa.string() for c in text},
             **{c: pa.list_(pa.string()) for c in lists}}
    rows = [(p, *[definition(p, org)[c] for c in text + lists]) for p in DEFINITIONS]
    return literal_table(spark, kinds, rows)


def rule_audit(df: DataFrame) -> DataFrame:
    """Verdict for every P1 and P2 ticket from keyword scores of its whole text."""
    text = F.concat_ws(" ", F.coalesce("short_description", F.lit("")),
                       F.coalesce("service_offering", F.lit("")))
    scores = lowered(text, lambda low: F.struct(
        hit_count(low, AUDIT_P1_KEYWORDS).alias("p1"), hit_count(low, AUDIT_P2_KEYWORDS).alias("p2"),
        hit_count(low, AUDIT_P4_KEYWORDS).alias("p4")))
    s, p = F.col("_s"), F.col("priority")

    def verdict(suggested, confidence, reason):
        return F.struct(F.lit(suggested).alias("suggested"), F.lit(confidence).alias("confidence"),
                        F.lit(REASONS[reason]).alias("reasoning"))

    v = (F.when((p == 1) & (s["p1"] >= 2), verdict(1, 0.65, "p1_ok"))
         .when((p == 1) & (s["p2"] >= 1) & (s["p1"] == 0), verdict(2, 0.60, "p1_to_2"))
         .when(p == 1, verdict(3, 0.55, "p1_to_3"))
         .when((s["p2"] >= 2) | (s["p1"] >= 2), verdict(2, 0.65, "p2_ok"))
         .when(s["p4"] >= 2, verdict(4, 0.60, "p2_to_4"))
         .otherwise(verdict(3, 0.55, "p2_to_3")))
    return (df.where(p.isin(1, 2)).withColumn("_s", scores).withColumn("_v", v)
            .select("number", "short_description", "service_offering", p.alias("current_priority"),
                    F.when(F.col("_v.suggested") == p, "CORRECT").otherwise("RECLASSIFY").alias("verdict"),
                    F.col("_v.suggested").alias("suggested_priority"), "_v.confidence", "_v.reasoning",
                    (F.col("_v.suggested") - p).alias("delta")))


def sample(df: DataFrame, n: int = 20, n_p1: int = 5, order: str = "seq") -> DataFrame:
    """The first P1 tickets and, up to n in all, the first P2 tickets, in file order.

    At most n rows per priority leave a task (group limit before the shuffle); the
    window over the few rows that are left turns the P1 count into the P2 quota.
    """
    w = Window.partitionBy("priority").orderBy(order)
    first = (df.where(F.col("priority").isin(1, 2)).withColumn("_rn", F.row_number().over(w))
             .where(F.col("_rn") <= n))
    taken = F.count_if((F.col("priority") == 1) & (F.col("_rn") <= n_p1)).over(Window.partitionBy())
    quota = F.when(F.col("priority") == 1, F.lit(n_p1)).otherwise(F.lit(n) - F.col("_p1"))
    return (first.withColumn("_p1", taken).where(F.col("_rn") <= quota).drop("_rn", "_p1"))


def summary(audited: DataFrame) -> DataFrame:
    n, ok = F.count("*"), F.count_if(F.col("verdict") == "CORRECT")
    return audited.agg(
        n.alias("total_audited"), F.count_if(F.col("current_priority") == 1).alias("p1_count"),
        F.count_if(F.col("current_priority") == 2).alias("p2_count"), ok.alias("correctly_classified"),
        ratio_pct_or_zero(ok, n).alias("correctly_classified_pct"),
        F.count_if(F.col("delta") < 0).alias("should_escalate"),
        F.count_if(F.col("delta") > 0).alias("should_downgrade"))


def prompt_parts(org: str = DEFAULT_ORG) -> tuple[str, str]:
    """Text before "Is P<n>" that follows the ticket fields, and the closing text."""
    d = {p: definition(p, org) for p in DEFINITIONS}
    blocks = [f"P1 (Critical): {d[1]['criteria']}", f"P2 (High): {d[2]['criteria']}"]
    for i, p in enumerate((1, 2)):
        blocks[i] += (f"\n  Key indicators: {'; '.join(d[p]['key_indicators'])}"
                      f"\n  Disqualifiers: {'; '.join(d[p]['disqualifiers'])}")
    blocks += [f"P3 (Moderate): {d[3]['criteria']}", f"P4 (Standard): {d[4]['criteria']}"]
    # Wording of the prompt.
    criteria = f"\n\nCONTRACTUAL PRIORITY CRITERIA ({org} SOW):\n" + "\n\n".join(blocks)
    closing = (" the CORRECT classification based solely on the description and criteria above?\n\n"
               "Respond as JSON only:\n"
               '{"verdict":"CORRECT"|"RECLASSIFY","suggested_priority":1|2|3|4,"confidence":0.0-1.0,'
               '"reasoning":"one concise sentence explaining your decision"}')
    # End of fixed values.
    return criteria, closing


def prompts(df: DataFrame, org: str = DEFAULT_ORG) -> DataFrame:
    """One prompt per P1/P2 ticket, for scoring elsewhere; no model is called."""
    criteria, closing = prompt_parts(org)
    p = F.concat(F.lit("P"), F.col("priority").cast("string"))
    labels = F.create_map(*[F.lit(x) for k, d in DEFINITIONS.items() for x in (k, d["label"])])
    service = F.when(F.coalesce("service_offering", F.lit("")) == "", "Not specified") \
        .otherwise(F.col("service_offering"))
    text: Column = F.concat(
        F.lit("Evaluate this incident's priority classification:\n\nINCIDENT:\n  Number: "), F.col("number"),
        F.lit("\n  Short Description: "), F.coalesce("short_description", F.lit("")),
        F.lit("\n  Service/Application: "), service, F.lit("\n  Current Priority: "), p, F.lit(" ("),
        labels[F.col("priority")], F.lit(")"), F.lit(criteria), F.lit("\n\nIs "), p, F.lit(closing))
    return df.where(F.col("priority").isin(1, 2)).select("number", "priority", text.alias("prompt"))
