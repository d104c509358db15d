"""Literal rows for the scalar rules and their traps."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tickframe.functions import breach_columns as bc
from tickframe.functions import buckets as bk
from tickframe.functions import clean as cl
from tickframe.functions import numbers as nu
from tickframe.functions import rules as ru
from tickframe.functions import text as tx


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_parse_priority(spark):
    raw = ["1 - Critical", "P2", "medium", "low", "5-LOW", "9 then 2", None, " HIGH ", "", "x"]
    assert apply(spark, raw, cl.parse_priority) == [1, 2, 3, 4, 3, 2, 3, 2, 3, 3]
    assert apply(spark, ["zzz", "p1", None], cl.priority_to_label) == ["4 - Standard", "1 - Critical", "4 - Standard"]


def test_parse_urgency(spark):
    assert apply(spark, ["1 - High", "medium", "4", "u2", None], cl.parse_urgency) == [1, 2, 3, 2, 3]


def test_parse_date(spark):
    raw = ["30-04-2026 23:01", "2026-04-05 10:00:00", "05/04/2026 10:00", "05-04-2026", "", "junk", None,
           "2026-04-05T10:00:00", "31-02-2026 10:00", "4-6-2026 9:05", "4/6/2026", "04-Jun-2026 10:00", "04.06.2026",
           "2026/06/04 10:00", "20260604", "06/30/2026", "Jun 4, 2026", "4 june 2026 1:05 PM", "04-06-2026 10:00:07", "  ",
           "2026-06-04 10:00:00.5", "06/30/2026 12:30 am"]
    assert apply(spark, raw, cl.parse_date) == [
        datetime(2026, 4, 30, 23, 1), datetime(2026, 4, 5, 10), datetime(2026, 4, 5, 10), datetime(2026, 4, 5),
        None, None, None, datetime(2026, 4, 5, 10), None, datetime(2026, 6, 4, 9, 5), datetime(2026, 6, 4), datetime(2026, 6, 4, 10),
        datetime(2026, 6, 4), datetime(2026, 6, 4, 10), datetime(2026, 6, 4), datetime(2026, 6, 30), datetime(2026, 6, 4),
        datetime(2026, 6, 4, 13, 5), datetime(2026, 6, 4, 10, 0, 7), None, datetime(2026, 6, 4, 10, 0, 0, 500000),
        datetime(2026, 6, 30, 0, 30)]


def test_format_date(spark):
    assert apply(spark, ["2026-04-05 10:00:30", None], lambda c: cl.format_date(c.cast("timestamp"))) == \
        ["05-04-2026 10:00", ""]


def test_parse_sla(spark):
    assert apply(spark, ["yes", "Y", "1", " true ", None, "no", ""], cl.parse_sla) == [True] * 4 + [False] * 3


def test_normalize_state(spark):
    assert apply(spark, ["Closed", "wip", " Pending", "closed", None, "On Hold"], cl.normalize_state) == \
        ["Closed", "In Progress", "On Hold", "Open", "Open", "On Hold"]


def test_numbers(spark):
    assert apply(spark, ["3", "-2", "x", None, " 4.5 ", "NaN"], cl.clamp_numeric) == [3, 0, 0, 0, 4.5, 0]
    assert apply(spark, ["3", "-2", "x"], cl.to_number) == [3, -2, 0]
    assert apply(spark, [1.25, float("nan"), float("inf"), None], nu.clean_nan, "double") == [1.25, None, None, None]
    assert apply(spark, [1.25, float("nan"), float("-inf"), None], nu.clean_nan_zero, "double") == [1.2, 0, 0, 0]


def test_agent_name(spark):
    assert apply(spark, ["Ann Lee (al@example.com)", "Bob", "", None], cl.agent_name) == ["Ann Lee", "Bob", "", None]


def test_headers():
    names = ["  Opened At ", "On-hold reason", "Business/Service", "Made SLA", "a(b)c"]
    assert [cl.normal_header(n) for n in names] == ["opened_at", "on_hold_reason", "business_service", "made_sla", "abc"]
    assert cl.import_header(" A-b ") == "_a_b_"


def test_category(spark):
    raw = ["login error", "vpn wifi error", "", None, "report validation export failed", "hello"]
    assert apply(spark, raw, ru.classify_category) == [
        "Application Access", "Network", "General", "General", "Data & Reporting", "General"]


def test_rules_from_a_table(spark):
    own = spark.createDataFrame([("Parts", " Ring"), ("Network", "uplink"), ("Network", "vpn"), (None, "x")], "category string, keyword string")
    rules = ru.rules_from_table(own)
    assert rules["Parts"] == ["ring"] and rules["Network"].count("vpn") == 1 and list(rules)[-1] == "Parts"
    assert apply(spark, ["the ring", "uplink"], lambda c: ru.classify_category(c, rules)) == ["Parts", "Network"]


def test_subcategory(spark):
    rows = [("Application Access", "SSO and badge"), ("Application Error", "very slow page"),
            ("Network", "vpn"), ("Software & Tools", "please install")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, t string")
    got = df.select("i", ru.classify_subcategory("c", "t").alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == ["Login/SSO", "Performance Issue", "General", "Installation"]


def test_bucketize(spark):
    values = [0.0, 25.0, 25.01, 95.0, 100.0, 100.5, 200.0, 201.0, None]
    got = apply(spark, values, lambda c: bk.bucketize(c, bk.ELAPSED_EDGES, bk.ELAPSED_LABELS), "double")
    labels = bk.ELAPSED_LABELS
    assert got == [None, labels[0], labels[1], labels[4], labels[4], labels[5], labels[5], labels[5], None]


def test_breach_derivation(spark):
    rows = [("1 - Critical", "On Hold", 120.0, "BUG 1", None), ("2 - High", "On Hold", 99.0, "", "2026-06-04 04:00:00"),
            ("1 - Critical", "In Progress", 0.0, None, "2026-06-05 14:00:00"), ("3 - Moderate", "In Progress", 0.0, " ", None),
            ("4 - Standard", "In Progress", 40.0, "", None), ("odd", "In Progress", 80.0, "", None)]
    df = spark.createDataFrame(
        rows, "priority string, state string, business_elapsed_percentage double, internal_id string, last string")
    df = df.withColumns({"last_assignment_date": F.col("last").cast("timestamp"),
                         "breach_time": F.lit("2026-06-04 00:00:00").cast("timestamp")})
    got = bc.derive_breach(df, "2026-06-04 14:00:00").collect()
    assert [r["urgency"] for r in got] == ["Already Breached", "On Hold (Paused)", "Breaching <4h",
                                           "Breaching This Week", "Breaching This Week", "Breaching Today"]
    assert [r["sla_severity"] for r in got] == ["Breached", "Critical (90–100%)", "Healthy (<50%)", "Healthy (<50%)",
                                                "Healthy (<50%)", "At Risk (75–90%)"]
    assert [r["priority_num"] for r in got] == [1, 2, 1, 3, 4, 4]
    assert [r["overdue_biz_hours"] for r in got] == [0.8, 0, 0, 0, 0, 0]
    assert [r["remaining_biz_hours"] for r in got] == [0.0, 0.1, 4.0, 72.0, 72.0, 24.0]
    assert [r["assignment_age_h"] for r in got] == [None, 10.0, 0.0, None, None, None]
    assert [r["has_bug_link"] for r in got] == [True, False, False, False, False, False]


def test_tokens(spark):
    got = apply(spark, ["Élan vital, a_b c", "x", None], lambda c: tx.unigrams_bigrams(tx.tokens(c, accents=False)))
    assert got == [["elan", "vital", "a_b", "elan vital", "vital a_b"], [], []]
    assert apply(spark, ["Élan"], tx.tokens) == [["élan"]]


@pytest.mark.parametrize("value,first,second,reverse,want", [
    (95, 90, 80, True, "positive"), (85, 90, 80, True, "warning"), (10, 90, 80, True, "critical"),
    (1, 5, 10, False, "positive"), (5, 5, 10, False, "warning"), (10, 5, 10, False, "critical")])
def test_severity(spark, value, first, second, reverse, want):
    from tickframe.operators.insights import severity_band

    assert apply(spark, [value], lambda c: severity_band(c, first, second, reverse), "int") == [want]
